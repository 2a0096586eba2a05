"""Token ids of whole texts by the `tokenizers` library, with a cache of what stands between spaces.

The byte-level pre-tokenizer always begins a new piece at a single space that does not stand between two white
space characters, and merges never cross pieces. So a text cut before such spaces has the ids of its cuts, one
after another; each distinct cut is encoded once by the library and then looked up. A cut of letters, or of letters
and one closing run of ASCII punctuation, is one or two pieces, whose ids the library's BPE model gives without
pre-tokenizing. Texts with a space between two white space characters, or with the text of an added token, go
through the library as a whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

_ODD = re.compile(r"\s \s")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
KEEP_CHARS = 48


def _byte_level() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*plain}))}


_LETTERS = _byte_level()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """encode() gives, for each text, its ids as little-endian unsigned integers of `width` bytes."""

    def __init__(self, path: str, max_entries: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_entries = max_entries
        self.tails: dict[str, bytes] = {"": b""}
        self.fast = self.tokenizer.normalizer is None and '"ByteLevel"' in str(self.tokenizer.pre_tokenizer) + '"ByteLevel"' * (type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel")
        self.pack = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size(True))]
        self.cache: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        pack = self.pack.__getitem__
        return [b"".join(map(pack, e.ids)) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_space(self, cuts: list[str]) -> None:
        """Puts the ids of each cut, with the space before it, into the cache."""
        rest, pack, tokenize, cache, space = [], self.pack, self.tokenizer.model.tokenize, self.cache, chr(_LETTERS[32])
        for cut in cuts:
            core = cut if cut.isalpha() else cut.rstrip(_PUNCTUATION)
            if not (self.fast and core.isalpha()):
                rest.append(cut)
                continue
            ids = cache.get(core)
            if ids is None:
                piece = space + (core if core.isascii() else core.encode().decode("latin-1").translate(_LETTERS))
                cache[core] = ids = b"".join([pack[t.id] for t in tokenize(piece)])
            if len(core) < len(cut):
                tail = cut[len(core) :]
                if tail not in self.tails:
                    self.tails[tail] = self._library([tail])[0]
                cache[cut] = ids + self.tails[tail]
        self.cache.update(zip(rest, self._library([f" {c}" for c in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.max_entries:
            self.cache.clear()
        if len(self.tails) > 10_000:
            self.tails = {"": b""}
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if _ODD.search(t) or any(a in t for a in self.added)]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        odd, cut = set(whole), {}
        need: set[str] = set()
        for i, t in enumerate(texts):
            if i not in odd and t:
                cut[i] = t.split(" ")
                need.update(cut[i][1:])
        cache = self.cache
        new = [w for w in need if w not in cache]
        self._after_space(new)
        heads = self._library([parts[0] for parts in cut.values()])
        look = self.cache.__getitem__
        for (i, parts), head in zip(cut.items(), heads, strict=True):
            parts[0] = ""
            out[i] = head + b"".join(map(look, parts[1:]))
        for w in new:
            if len(w) > KEEP_CHARS:
                self.cache.pop(w, None)
                self.cache.pop(w.rstrip(_PUNCTUATION), None)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
