"""Helpers shared by the corpus operators: stored tables, Arrow chunks, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import discard, new_folder, stored  # noqa: F401  the operators take these from here

#: Byte classes of the word rule `[^\x20\x09-\x0D]+`.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Texts are large rows, so Arrow batches get 1,000 of them, unless the session has a number other than Spark's own:
    batches lie both in the executor's and in the Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch at row borders into slices of about max_bytes of text, so that arrays made for a slice stay small. No row is cut."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    sizes = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(sizes, sizes[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield batch.slice(first, last - first)
        first = last


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more than there are texts). Nulls are empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes, equal values wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_P_INV, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def words_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """spans_hash of spans that do not overlap and stand in order, made in pieces of `step` spans, so that arrays stay small."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), step):
        s, e = starts[a : a + step], ends[a : a + step]
        out[a : a + step] = spans_hash(data[s[0] : e[-1]], s - s[0], e - s[0])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words begin before each text (one more than there are texts)."""
    inside = _IS_WORD[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(before):
        before[0] = False
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    after[borders - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]
