"""Predicates on keys and seqs; all of them push down to Parquet scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_key(value: bytes | str | None) -> bytes | None:
    return value.encode() if isinstance(value, str) else value


def in_range(key: Column, start: bytes | str | None = None, end: bytes | str | None = None, start_inclusive: bool = True) -> Column:
    """Half-open key range in byte order. None is unbounded; an empty end matches nothing."""
    where = F.lit(True)
    if start is not None:
        low = F.lit(bytearray(as_key(start)))
        where = where & (key >= low if start_inclusive else key > low)
    if end is not None:
        where = where & (key < F.lit(bytearray(as_key(end))))
    return where


def visible(seq: Column, at_seq: int | None = None) -> Column:
    """Versions up to at_seq; None is the latest, 0 sees nothing."""
    return F.lit(True) if at_seq is None else seq <= at_seq


def hash_partition(key: Column, partitions: int) -> Column:
    """The data partition of a key, 0 for a single one."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int") if partitions > 1 else F.lit(0)
