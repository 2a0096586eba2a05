"""Integrity, segments, truncation, compaction and merges of snapshots with a tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import KEY, newest

SEGMENT = 10_000


def checksum(*columns: Column) -> Column:
    """IEEE CRC-32 of the bytes of the columns, one after another; nulls are empty."""
    return F.crc32(F.concat(*[F.coalesce(c.cast("binary"), F.lit(bytearray())) for c in columns]))


def valid_prefix(log: DataFrame, ok: str = "ok") -> DataFrame:
    """Entries before the first broken one. The place of that one is a single row, so it is the only thing broadcast."""
    first_bad = log.agg(F.min(F.when(~F.col(ok), F.col("seq"))).alias("bad"))
    return log.join(F.broadcast(first_bad), F.col("bad").isNull() | (F.col("seq") < F.col("bad"))).drop("bad")


def verified(log: DataFrame, stored_checksum: str, *columns: str) -> DataFrame:
    """log with `ok`: whether the checksum of the columns is the stored one."""
    return log.withColumn("ok", F.coalesce(checksum(*map(F.col, columns)) == F.col(stored_checksum), F.lit(False)))


def segment_of(seq: Column, size: int = SEGMENT) -> Column:
    return F.floor((seq - 1) / size)


def segments(log: DataFrame, size: int = SEGMENT) -> DataFrame:
    return log.groupBy(segment_of(F.col("seq"), size).alias("segment")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("entries"))


def truncate_prefix(log: DataFrame, before: int, snapshot_seq: int | None = None, min_cursor: int | None = None, size: int = SEGMENT) -> DataFrame:
    """Drops whole segments that end before the safe seq: nothing that a snapshot does not hold or a subscriber has
    not seen goes. Without a snapshot nothing is safe."""
    if snapshot_seq is None:
        return log
    safe = min(x for x in (before, snapshot_seq, min_cursor) if x is not None)
    gone = segments(log, size).filter(F.col("last_seq") < safe).select("segment")
    return log.withColumn("segment", segment_of(F.col("seq"), size)).join(gone, "segment", "left_anti").drop("segment")


def truncate_suffix(log: DataFrame, from_seq: int) -> DataFrame:
    return log.filter(F.col("seq") < from_seq)


def compact(versions: DataFrame, retain_from: int | None = None) -> DataFrame:
    """Newest versions only, tombstones kept; with retain_from, also every version at or after it and, of older ones,
    the newest of each key, so that reads at retain_from and later are the same as before."""
    if retain_from is None:
        return newest(versions)
    old = newest(versions, retain_from)
    return old.unionByName(versions.filter(F.col("seq") > retain_from).select(*KEY, "seq", "value", "is_tombstone"))


def drop_tombstones(compacted: DataFrame) -> DataFrame:
    """The last level: a tombstone with nothing below it can go."""
    return compacted.filter("NOT is_tombstone")


def replayed(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """Versions of a snapshot and of what was folded after it."""
    return snapshot.select(*KEY, "seq", "value", "is_tombstone").unionByName(tail.select(*KEY, "seq", "value", "is_tombstone"))
