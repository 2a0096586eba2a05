"""Global sequencing, idempotency, routing and the merge of physical logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SequenceGap
from ..functions.ordered import BLOCK, dense_rank_by


def assign(arrivals: DataFrame, next_seq: int = 1, partitions: int = 1, block: int = BLOCK) -> DataFrame:
    """arrivals(arrival, ...) with dense seqs from next_seq on and the log partition that takes each."""
    return dense_rank_by(arrivals, "arrival", "seq", next_seq, block).withColumn("partition", F.pmod("seq", F.lit(partitions)).cast("int"))


def submit(arrivals: DataFrame, next_seq: int = 1, block: int = BLOCK) -> DataFrame:
    """arrivals(arrival, client_id, client_seq): the first of equal pairs gets the next seq, the others get the same
    one and leave no gap."""
    firsts = arrivals.groupBy("client_id", "client_seq").agg(F.min("arrival").alias("arrival"))
    numbered = dense_rank_by(firsts, "arrival", "seq", next_seq, block).withColumnRenamed("arrival", "first")
    return arrivals.join(numbered, ["client_id", "client_seq"]).withColumn("duplicate", F.col("arrival") > F.col("first")).drop("first")


def evict(cache: DataFrame, before_seq: int) -> DataFrame:
    """The idempotency cache without entries below before_seq."""
    return cache.filter(F.col("seq") >= before_seq)


def merge(logs: list[DataFrame] | DataFrame, from_seq: int = 1, most: int = 0) -> DataFrame:
    """Entries of several logs (column part) by seq; of equal seqs the one of the first log stays."""
    every = logs if isinstance(logs, DataFrame) else None
    for k, log in enumerate([] if every is not None else logs):
        one = log.withColumn("part", F.lit(k))
        every = one if every is None else every.unionByName(one)
    rest = [c for c in every.columns if c not in ("seq", "part")]
    first = every.filter(F.col("seq") >= from_seq).groupBy("seq").agg(F.min(F.struct("part", *rest)).alias("e"))
    out = first.select("seq", "e.part", *[f"e.{c}" for c in rest]).orderBy("seq")
    return out.limit(most) if most else out


def read(log: DataFrame, from_seq: int, most: int = 0) -> DataFrame:
    """Entries from from_seq on in order, `most` at most."""
    out = log.filter(F.col("seq") >= from_seq).orderBy("seq")
    return out.limit(most) if most else out


def require_dense(log: DataFrame, first: int = 1) -> None:
    n, low, high = log.agg(F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()
    if n and (low != first or high - low + 1 != n):
        raise SequenceGap(f"{n} seqs from {low} to {high}")


def head(log: DataFrame) -> DataFrame:
    """The last seq and its epoch; 0 in an empty log."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"), F.coalesce(F.max_by("epoch", "seq"), F.lit(0)).alias("epoch"))


def term_at(log: DataFrame, seq: int) -> DataFrame:
    """The epoch of the entry at seq; 0 where there is none."""
    return log.filter(F.col("seq") == seq).agg(F.coalesce(F.max("epoch"), F.lit(0)).cast("long").alias("term"))


def committed(log: DataFrame, watermark: int) -> DataFrame:
    """Whether the log has reached the watermark, in one row."""
    return log.agg(F.coalesce(F.max("seq") >= watermark, F.lit(watermark <= 0)).alias("committed"))


def describe(log: DataFrame, seq: int) -> DataFrame:
    """One entry's identity and the number of its operations of each kind."""
    sets, deletes = (F.expr(f"size(filter(ops, o -> o.op = '{k}'))").alias(f"{k}s") for k in ("set", "delete"))
    return log.filter(F.col("seq") == seq).select("seq", "epoch", "kind", "client_id", "client_seq", sets, deletes)


def route_least_loaded(log: DataFrame, partitions: int) -> DataFrame:
    """Log partition of each entry. With equal loads, as when every entry counts the same, taking the least loaded log
    and the tie rule seq mod n are one round robin."""
    return log.withColumn("partition", F.pmod("seq", F.lit(partitions)).cast("int"))


def partition_loads(log: DataFrame) -> DataFrame:
    return log.groupBy("partition").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def epochs(log: DataFrame, size: int) -> DataFrame:
    """Entries in epochs of `size` and their place in them."""
    return log.withColumn("epoch_num", F.floor((F.col("seq") - 1) / size)).withColumn("place", F.row_number().over(Window.partitionBy("epoch_num").orderBy("seq")))
