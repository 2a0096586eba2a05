"""Counters, gauges and the fixed-bucket latency histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 15 upper bounds in nanoseconds, doubling from 1 us to 16.384 ms, then infinity (the largest long).
BOUNDS = tuple(1000 * 2**i for i in range(15))
INFINITE = (1 << 63) - 1


def counter(*deltas: Column) -> Column:
    return F.coalesce(F.sum(sum(deltas[1:], deltas[0])), F.lit(0))


def gauge(value: Column, seq: Column) -> Column:
    """The last value."""
    return F.max_by(value, seq)


def fold_metrics(outcomes: DataFrame, head: int) -> DataFrame:
    """What a fold has done, in one row: transactions applied and aborted, no-ops, rows written, the seq it has reached, and
    how far that is behind the log's head."""
    n = {k: F.count(F.when(F.col("status") == s, 1)).alias(k) for k, s in (("applied", "ok"), ("aborted", "abort"), ("noops", "noop"))}
    reached = F.coalesce(F.max("seq"), F.lit(0)).cast("long")
    return outcomes.agg(*n.values(), counter(F.col("rows_affected")).alias("rows_affected"), reached.alias("current_seq"), (F.lit(head) - reached).cast("long").alias("lag"))


def bucket_of(ns: Column) -> Column:
    """Index of the bucket whose upper bound is the first at or above ns."""
    out = F.lit(len(BOUNDS))
    for i in reversed(range(len(BOUNDS))):
        out = F.when(ns <= BOUNDS[i], i).otherwise(out)
    return out.cast("int")


def histogram(samples: DataFrame, ns: str = "ns") -> DataFrame:
    """bucket, upper, count for every bucket, empty ones included."""
    uppers = samples.sparkSession.createDataFrame(list(enumerate((*BOUNDS, INFINITE))), "bucket int, upper long")
    counts = samples.groupBy(bucket_of(F.col(ns)).alias("bucket")).agg(F.count("*").alias("count"))
    return F.broadcast(uppers).join(counts, "bucket", "left").select("bucket", "upper", F.coalesce("count", F.lit(0)).alias("count"))


def summary(samples: DataFrame, ns: str = "ns") -> DataFrame:
    """count, sum, min, max and the integer mean; zeros where there is no sample."""
    total, n = F.coalesce(F.sum(ns), F.lit(0)), F.count("*")
    return samples.agg(n.alias("count"), total.alias("sum"), F.coalesce(F.min(ns), F.lit(0)).alias("min"), F.coalesce(F.max(ns), F.lit(0)).alias("max")).withColumn("mean", F.when(F.col("count") > 0, F.expr("sum DIV count")).otherwise(F.lit(0)).cast("long"))


def percentile(samples: DataFrame, ps: list[int], ns: str = "ns") -> DataFrame:
    """For each p the upper bound of the first bucket that has floor((p * count + 99) / 100) samples up to it; 0 without samples."""
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = histogram(samples, ns).withColumn("upto", F.sum("count").over(upto)).withColumn("n", F.sum("count").over(Window.partitionBy()))
    each = h.withColumn("p", F.explode(F.array(*[F.lit(p) for p in ps])))
    hit = F.col("upto") >= F.floor((F.col("p") * F.col("n") + 99) / 100)
    return each.groupBy("p").agg(F.coalesce(F.min(F.when(hit & (F.col("n") > 0), F.col("upper"))), F.lit(0).cast("long")).alias("upper"))
