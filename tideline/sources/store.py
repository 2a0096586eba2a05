"""Versions, logs and snapshots as Parquet on any Hadoop file system.

A snapshot is a folder of versions with a manifest beside it; the manifest is written last, so a snapshot without one
does not exist. Paths go through Spark and Hadoop alone, never through local file calls.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import visible
from ..operators import fold
from ..operators.fold import KEY
from ..operators.maintenance import compact, replayed
from ..schemas import LOG, VERSIONS, struct
from ..session import file_system


def write_versions(versions: DataFrame, path: str, files: int | None = None, mode: str = "append") -> None:
    """Sorted by key, newest first, within range partitions of the keys: reads of a key or a range skip row groups by their
    statistics. Without a number of files, Spark's target size decides."""
    rows = versions.select(*KEY, "seq", "value", "is_tombstone")
    dealt = rows.repartitionByRange(files, *KEY, "seq") if files else rows.repartitionByRange(*KEY, "seq")
    dealt.sortWithinPartitions(*KEY, F.desc("seq")).write.mode(mode).partitionBy("ns").parquet(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(struct(VERSIONS)).parquet(path).select(*KEY, "seq", "value", "is_tombstone")


def write_log(log: DataFrame, path: str, segment: int = 10_000) -> None:
    """A log in segments of so many seqs, in seq order within each file."""
    cut = log.withColumn("segment", F.floor((F.col("seq") - 1) / segment))
    cut.repartition("segment").sortWithinPartitions("segment", "seq").write.mode("append").partitionBy("segment").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(struct(LOG + ", segment long")).parquet(path).drop("segment")


def snapshot(versions: DataFrame, root: str, seq: int, partition_id: int = 0, retain_history: bool = False) -> str:
    """Writes versions up to seq below root and returns the folder."""
    spark, folder = versions.sparkSession, f"{root}/{partition_id}/{seq:020d}"
    kept = versions.filter(visible(F.col("seq"), seq))
    write_versions(kept if retain_history else compact(kept), f"{folder}/data", mode="overwrite")
    spark.createDataFrame([(json.dumps({"seq": seq, "partition_id": partition_id, "data": "data"}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return folder


def snapshots(spark: SparkSession, root: str, partition_id: int = 0) -> list[int]:
    """The seqs of whole snapshots."""
    fs, top = file_system(spark, f"{root}/{partition_id}")
    if not fs.exists(top):
        return []
    found = (s.getPath() for s in fs.listStatus(top) if s.isDirectory())
    return sorted(int(p.getName()) for p in found if fs.exists(file_system(spark, f"{p}/manifest/_SUCCESS")[1]))


def restore(spark: SparkSession, root: str, seq: int, partition_id: int = 0) -> DataFrame:
    folder = f"{root}/{partition_id}/{seq:020d}"
    told = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    return read_versions(spark, f"{folder}/{told['data']}")


def snapshot_due(last_seq: int, applied_seq: int, interval: int) -> bool:
    """The policy: a snapshot every `interval` applied seqs; 0 never."""
    return interval > 0 and applied_seq - last_seq >= interval


def expire(spark: SparkSession, root: str, keep: int, partition_id: int = 0) -> list[int]:
    """Deletes all whole snapshots but the newest `keep`, at least one, and returns the seqs that went. A manifest goes first,
    so a snapshot that is half deleted does not exist."""
    gone = snapshots(spark, root, partition_id)[: -max(keep, 1)]
    for seq in gone:
        for part in ("/manifest", ""):
            fs, p = file_system(spark, f"{root}/{partition_id}/{seq:020d}{part}")
            fs.delete(p, True)
    return gone


def recover(spark: SparkSession, root: str, folded: DataFrame, partition_id: int = 0) -> DataFrame:
    """Versions from the latest whole snapshot and, of `folded` versions, those after it; all of them without a snapshot."""
    known = snapshots(spark, root, partition_id)
    if not known:
        return folded
    return replayed(restore(spark, root, known[-1], partition_id), folded.filter(F.col("seq") > known[-1]))


def recover_from_log(spark: SparkSession, root: str, log: DataFrame, partition_id: int = 0) -> DataFrame:
    """Versions from the latest whole snapshot and from the entries of the log after it, which alone are folded: conditional sets
    meet the snapshot's state. Without a snapshot the whole log is folded."""
    known = snapshots(spark, root, partition_id)
    if not known:
        return fold.versions(fold.judged(fold.operations(log)))
    kept = restore(spark, root, known[-1], partition_id)
    tail = fold.operations(log.filter(F.col("seq") > known[-1]))
    return replayed(kept, fold.versions(fold.judged(tail, initial=fold.state(kept))))


def compact_store(spark: SparkSession, path: str, to: str, retain_from: int | None = None) -> None:
    """Rewrites a store into a new folder, so readers of the old one are not disturbed."""
    write_versions(compact(read_versions(spark, path), retain_from), to, mode="overwrite")
