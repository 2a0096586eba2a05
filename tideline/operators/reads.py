"""Point, as-of, range and batch reads of VERSIONS."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import as_key, hash_partition, in_range
from ..functions.ordered import BLOCK, carry
from .fold import KEY, newest, state

#: Up to so many range requests are broadcast (two keys each); more are joined by intervals between their borders.
BROADCAST_RANGES = 10_000


def get(versions: DataFrame, key: bytes | str, at_seq: int | None = None, ns: int = 1) -> DataFrame:
    """One row: value and committed_seq. Missing, deleted and empty values read as null; the seq is the version's, 0 without one."""
    own = versions.filter((F.col("ns") == ns) & (F.col("key") == F.lit(bytearray(as_key(key)))))
    top = newest(own, at_seq).agg(F.first(F.struct("seq", "value", "is_tombstone")).alias("v"))
    live = F.col("v").isNotNull() & ~F.col("v.is_tombstone")
    shown = F.when(live & (F.octet_length("v.value") > 0), F.col("v.value"))
    return top.select(shown.alias("value"), F.when(live, F.col("v.seq")).otherwise(0).cast("long").alias("committed_seq"))


def multi_get(versions: DataFrame, requests: DataFrame, at_seq: int | None = None) -> DataFrame:
    """requests(req_idx, ns, key) with found, value, committed_seq in one state."""
    live = state(versions, at_seq).withColumnRenamed("seq", "committed_seq")
    out = requests.join(live, KEY, "left")
    return out.select("req_idx", *KEY, F.col("committed_seq").isNotNull().alias("found"), "value", F.coalesce("committed_seq", F.lit(0)).alias("committed_seq"))


def multi_get_as_of(versions: DataFrame, requests: DataFrame, block: int = BLOCK) -> DataFrame:
    """requests(req_idx, ns, key, at_seq), each at its own seq. Requests and versions are ordered together, so no
    request meets all versions of its key."""
    rows = versions.select(*KEY, "seq", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("req_idx"), F.struct("seq", "value", "is_tombstone").alias("v"))
    asks = requests.select(*KEY, F.col("at_seq").alias("seq"), F.lit(1).alias("turn"), F.col("req_idx").cast("long").alias("req_idx"), F.lit(None).cast("struct<seq:bigint,value:binary,is_tombstone:boolean>").alias("v"))
    seen = carry(rows.unionByName(asks), KEY, "seq", ["turn", "req_idx"], F.col("v"), "at", block).filter("turn = 1")
    live = F.col("at").isNotNull() & ~F.col("at.is_tombstone")
    return seen.select("req_idx", *KEY, F.col("seq").alias("at_seq"), F.coalesce(live, F.lit(False)).alias("found"), F.when(live, F.col("at.value")).alias("value"), F.when(live, F.col("at.seq")).otherwise(0).cast("long").alias("committed_seq"))


def range_scan(versions: DataFrame, start: bytes | str | None, end: bytes | str | None, limit: int = 0, at_seq: int | None = None, ns: int = 1, start_inclusive: bool = True) -> DataFrame:
    """Live rows of [start, end) in key order; limit 0 is no limit. Empty values are rows."""
    found = state(versions.filter((F.col("ns") == ns) & in_range(F.col("key"), start, end, start_inclusive)), at_seq).orderBy("key")
    return found.limit(limit) if limit else found


def range_batch(versions: DataFrame, requests: DataFrame, at_seq: int | None = None) -> DataFrame:
    """requests(req_idx, ns, start, end, lim), each a half-open range with its own limit, as rows in key order."""
    live = state(versions, at_seq)
    if requests.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        r = F.broadcast(requests).alias("r")
        hit = live.alias("s").join(r, (F.col("s.ns") == F.col("r.ns")) & (F.col("s.key") >= F.col("r.start")) & (F.col("s.key") < F.col("r.end")))
        found = hit.select("r.req_idx", "s.ns", "s.key", "s.value", "s.seq", "r.lim")
    else:
        found = _by_borders(live, requests)
    place = F.row_number().over(Window.partitionBy("req_idx").orderBy("key"))
    return found.withColumn("place", place).filter("lim = 0 OR place <= lim").drop("lim")


def _by_borders(live: DataFrame, requests: DataFrame) -> DataFrame:
    """Joins by the intervals between neighbouring borders of requests: each row has one, each request those it spans."""
    borders = requests.select("ns", F.col("start").alias("key")).union(requests.select("ns", "end")).distinct()
    numbered = borders.withColumn("interval", F.row_number().over(Window.partitionBy("ns").orderBy("key")))
    ends = numbered.select("ns", "key", F.lead("key").over(Window.partitionBy("ns").orderBy("key")).alias("next"), "interval")
    spans = requests.join(numbered.select("ns", F.col("key").alias("start"), F.col("interval").alias("a")), ["ns", "start"]).join(numbered.select("ns", F.col("key").alias("end"), F.col("interval").alias("b")), ["ns", "end"])
    each = spans.filter("a < b").select("req_idx", "ns", "lim", F.explode(F.sequence("a", F.col("b") - 1)).alias("interval"))
    marks = ends.select("ns", "key", F.lit(0).alias("turn"), "interval", F.lit(None).cast("binary").alias("value"), F.lit(None).cast("long").alias("seq"))
    rows = marks.unionByName(live.select("ns", "key", F.lit(1).alias("turn"), F.lit(None).cast("int").alias("interval"), "value", "seq"))
    upto = Window.partitionBy("ns").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("interval", F.last("interval", True).over(upto)).filter("turn = 1")
    return placed.join(each, ["ns", "interval"]).select("req_idx", "ns", "key", "value", "seq", "lim")


def read_batch(versions: DataFrame, gets: DataFrame, ranges: DataFrame) -> DataFrame:
    """A read-only batch with a result for each request: a get gives one row, found or not, as of its at_seq where gets have
    that column; a range its rows in key order, or, if it has none, one row with found false and place 0. `seq` is 0 where nothing was found."""
    one = multi_get_as_of(versions, gets) if "at_seq" in gets.columns else multi_get(versions, gets)
    one = one.select("req_idx", F.lit("get").alias("kind"), *KEY, "found", "value", F.col("committed_seq").alias("seq"), F.lit(1).alias("place"))
    many = range_batch(versions, ranges)
    every = ranges.select("req_idx", F.col("ns").alias("r_ns")).join(many, "req_idx", "left")
    rows = every.select("req_idx", F.lit("range").alias("kind"), F.col("r_ns").alias("ns"), "key", F.col("key").isNotNull().alias("found"), "value", F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("place", F.lit(0)).alias("place"))
    return one.unionByName(rows)


def scatter_scan(versions: DataFrame, partitions: int, at_seq: int | None = None) -> DataFrame:
    """State dealt over hash partitions of the keys and put in key order again; only newest versions are dealt."""
    live = state(versions, at_seq).withColumn("data_partition", hash_partition(F.col("key"), partitions))
    return live.repartition(partitions, "data_partition").drop("data_partition").orderBy(*KEY)


def history(versions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every version with the seq and value of the one before it."""
    return carry(versions, KEY, "seq", [], F.struct("seq", "value", "is_tombstone"), "before", block)
