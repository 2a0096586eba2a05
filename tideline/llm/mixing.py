"""Operator 5: mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; a source's budget falls into one bucket, and only that bucket is
refined, twice, by further bits of the hash. What remains is a threshold on the hash for each source, so documents
are chosen by a filter, without sorting, and every rerun chooses the same ones. Rows in the last border bucket, as good
as always equal ones, are numbered, and as many of them are taken as come nearest to the budget.

Defined cases: a null text has size 0; documents without a source form one source, weighed last; repeated rows have
the same hash and fall on one side of the threshold but for those of the border bucket, which is cut between them; sources whose
documents have no words get the target 0; an empty table gives no rows; other columns are not read by `shares`, and `mix` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, stored, table

BITS, LEVELS, HASH_BITS = 12, 3, 60


def _targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row for each source: its size, target, whole copies and what remains of the target for the threshold.

    Filling by weight until none is above its cap has a closed form: with sources in order of cap / weight, the
    first k are capped for the least k at which the next one's share is within its cap. Only integers are summed."""
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(by_name) - 1
    named = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = named.withColumns(
        {
            "words_left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # the rest goes by weight from the first source on whose share is within its cap
    fits = F.when(F.col("weight") * F.col("words_left") <= F.col("cap") * F.col("weight_left"), F.struct(F.col("cap") / F.col("weight"), F.col("words_left").alias("w"), F.col("weight_left").alias("v")))
    level = F.min(fits).over(every)
    share = F.col("weight") * level["w"] / level["v"]
    target = F.when(level.isNull() | (F.col("source_size") == 0), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return left.withColumn("target", target).withColumn("copies", copies).select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with `border` and `most`: documents whose leading hash bits are below the border are taken once more,
    and so are `most` of the rows that have these bits."""
    at = targets.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    for k in range(LEVELS):
        rows = sized.select("source", "size", _leading(BITS * (k + 1)).alias("bucket"))
        if k:
            here = at.select(F.col("source").alias("s"), "prefix")
            rows = rows.join(here, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", BITS) == F.col("prefix")), "left_semi")
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = sums.select(F.col("source").alias("s"), "bucket", "words", "rows", F.sum("words").over(upto).alias("upto"))
        budget = at.select("source", "budget", "below")
        joined = budget.join(found, budget["source"].eqNullSafe(found["s"]))
        edge = joined.filter((F.col("below") + F.col("upto") > F.col("budget")) & (F.col("below") + F.col("upto") - F.col("words") <= F.col("budget")))
        # of empty buckets at the edge, the one with words is the border
        at = edge.select("source", "budget", F.col("bucket").alias("prefix"), (F.col("below") + F.col("upto") - F.col("words")).alias("below"), "words", "rows")
        at = stored(at, f"mix-level-{k}")
    most = F.floor((F.col("budget") - F.col("below")) * F.col("rows") / F.col("words") + 0.5)
    limits = at.select(F.col("source").alias("s"), F.col("prefix").alias("border"), most.alias("most"))
    # without an edge the budget is all of the source, but for rounding, or nothing
    whole = F.when(F.col("budget") * 2 > F.col("source_size"), F.lit(1 << BITS * LEVELS)).otherwise(F.lit(-1))
    return targets.join(limits, targets["source"].eqNullSafe(limits["s"]), "left").drop("s").withColumns({"border": F.coalesce("border", whole), "most": F.coalesce("most", F.lit(0))})


def thresholds(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    return _thresholds(sized, stored(_targets(sized, weights, most), "mix-targets"))


def _copies(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """sized with its source's limits and `times`. The border rows are stored and numbered by the tasks that read them:
    a row for each task tells how many come before its own, so no source's border has to be in one task."""
    limits = limits.withColumnRenamed("source", "s")
    joined = sized.join(limits, sized["source"].eqNullSafe(limits["s"]))
    at = _leading(BITS * LEVELS)
    rest = joined.filter(at != F.col("border")).withColumn("times", F.col("copies") + (at < F.col("border")).cast("long"))
    border = stored(joined.filter(at == F.col("border")), "mix-border").withColumn("__task", F.spark_partition_id())
    before = Window.partitionBy("border", "s").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = border.groupBy("border", "s", "__task").count().withColumn("__first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    firsts = stored(firsts.select(F.col("s").alias("__s"), F.col("__task").alias("__t"), "__first"), "mix-border-tasks")
    own = Window.partitionBy("s", "__task").orderBy("hash")
    placed = border.withColumn("__row", F.row_number().over(own)).join(firsts, F.col("s").eqNullSafe(F.col("__s")) & (F.col("__task") == F.col("__t")))
    numbered = placed.withColumn("times", F.col("copies") + (F.col("__first") + F.col("__row") <= F.col("most")).cast("long"))
    return rest.unionByName(numbered.drop("__task", "__row", "__s", "__t", "__first"))


def _leading(bits: int) -> Column:
    return F.shiftright("hash", HASH_BITS - bits)


def _sized(docs: DataFrame) -> list:
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).cast("long"), F.lit(0).cast("long"))
    size = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(size)
    key = F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    return [size.alias("size"), F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash")]


def shares(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs(doc_id, text, source)."""
    sized = stored(docs.select("doc_id", "source", *_sized(docs)), "mix-sizes")
    out = _copies(sized, thresholds(sized, weights, most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    size, key = _sized(docs)
    names = docs.columns
    sized = stored(docs.select("source", size, key), "mix-sizes")
    every = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["source"].alias("source"), key)
    limits = stored(thresholds(sized, weights, most), "mix-limits")
    discard(sized)
    out = _copies(every, limits)
    return out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.greatest("times", F.lit(1))))).filter(F.col("times") > 0).select("row.*")


def oracle_sql(weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(concat_ws(' ', doc_id::VARCHAR, text)), 1, {HASH_BITS // 4}))::BIGINT >> {HASH_BITS - BITS * LEVELS} AS bucket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * {most} AS cap, [{", ".join(map(str, weights))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER before, 0)::BIGINT AS words_left, (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_left
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT words_left AS lw, weight_left AS lv FROM l WHERE weight * words_left <= cap * weight_left ORDER BY cap / weight, words_left, weight_left LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN lw IS NULL OR source_size = 0 THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * lw / lv) END AS target FROM l LEFT JOIN level ON TRUE),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
r AS (SELECT d.*, source_size, target, copies, target - copies * source_size AS budget, sum(size) OVER (PARTITION BY d.source, bucket) AS words, count(*) OVER (PARTITION BY d.source, bucket) AS n,
  row_number() OVER (PARTITION BY d.source, bucket) AS place, sum(size) OVER (PARTITION BY d.source ORDER BY bucket RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN upto <= budget THEN 1
  WHEN upto - words <= budget AND place <= floor((budget - (upto - words)) * n / words + 0.5) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"))
