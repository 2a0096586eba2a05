"""Errors of the API, named by what went wrong with a request."""


class LogError(ValueError):
    """A log or a request that the fold does not accept."""


class InvalidRequest(LogError):
    """An empty key, a batch that mixes reads and writes, or a conditional set within a batch."""


class BadPayload(LogError):
    """A payload whose checksum or form is wrong; its transaction aborts and keeps its seq."""


class SequenceGap(LogError):
    """A log whose seqs are not dense where they have to be."""


class TooManySubscribers(LogError):
    """More subscriptions than a change feed holds."""
