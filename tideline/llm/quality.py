"""Operator 1: quality rules with risk-controlled thresholds, by DataFrame functions alone.

Base measures are arrays within a row (no document is taken apart over rows). On top, each stratum (language) and
each measure gets a cutoff from labelled holdouts: going from the laxest of a fixed grid to the strictest, a cutoff
stays while an exact binomial test at level delta / (strata x measures) shows that it rejects at most
alpha / measures of good documents. So with probability 1 - delta no stratum loses more than alpha of its good
documents by the method. A stratum with too few labels gets no cutoff, and nothing of it is rejected.

Defined cases: a null text has no words and fails the base rules; a null language is a stratum of its own; labels
that repeat count once, good only if all say so; labels without a document count for nothing; without labels only
the base rules hold; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WINDOW = 8
#: Cutoffs from lax to strict; a document is rejected if its measure is above.
GRIDS = {
    "symbols": (60.0, 40.0, 30.0, 20.0, 15.0, 10.0, 8.0, 6.0, 4.0, 3.0, 2.0, 1.0),
    "same_lines": (90.0, 80.0, 70.0, 60.0, 50.0, 40.0, 30.0, 20.0, 15.0, 10.0, 5.0),
    "capitals": (95.0, 90.0, 80.0, 70.0, 60.0, 50.0, 40.0, 30.0, 25.0, 20.0),
    "word_length": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0),
}


def _let(value: str, name: str, body: str) -> str:
    """body with `name` bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_WORDS = r"split(trim(translate(text, '\t\n\u000B\u000C\r', '     ')), ' +')"
_HASHES = f"transform(sequence(0, size(ws) - {WINDOW}), i -> xxhash64(slice(ws, i + 1, {WINDOW})))"
# of all windows, sorted by hash, the places of those with an equal neighbour; then how many words they cover
_SORTED = "array_sort(transform(hs, (h, i) -> struct(h, i)))"
_PLACES = "array_sort(transform(filter(st, (x, k) -> (k > 0 AND st[k - 1].h = x.h) OR (k < size(st) - 1 AND st[k + 1].h = x.h)), x -> x.i))"
_COVER = f"CAST({WINDOW} AS BIGINT) + IF(size(ps) < 2, 0L, aggregate(sequence(0, size(ps) - 2), 0L, (a, k) -> a + least({WINDOW}, ps[k + 1] - ps[k])))"
_REPEATS = f"IF(size(ws) < {WINDOW}, 0L, {_let(_HASHES, 'hs', f'IF(size(array_distinct(hs)) = size(hs), 0L, {_let(_SORTED, "st", _let(_PLACES, "ps", _COVER))})')})"
_LINES = r"filter(split(text, '\n'), l -> trim(translate(l, '\t\u000B\u000C\r', '    ')) <> '')"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of each row of docs(doc_id, text, lang)."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("stratum"))
    split = text.select("doc_id", "stratum", "text", F.expr(_WORDS).alias("ws"), F.expr(_LINES).alias("ls"))
    some = F.col("ws")[0] != ""
    bare = F.translate("text", " \t\n\x0b\f\r", "")
    return split.select(
        "doc_id",
        "stratum",
        F.when(some, F.size("ws")).otherwise(0).cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.when(some, F.expr(_REPEATS)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
    )


def _ratio(top: str, bottom: str, scale: float) -> Column:
    return F.when(F.col(bottom) > 0, F.lit(scale) * F.col(top) / F.col(bottom)).otherwise(0.0)


def _scores() -> dict[str, Column]:
    return {"symbols": _ratio("n_symbols", "n_words", 100.0), "same_lines": _ratio("n_dup_lines", "n_lines", 100.0), "capitals": _ratio("n_capitals", "word_chars", 100.0), "word_length": _ratio("word_chars", "n_words", 1.0)}


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed in logarithms term by term; 1 if k is at or above the mean."""
    start = n * math.log1p(-p)
    step = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")),
        F.struct(start.alias("t"), F.lit(1.0).alias("m")),
        lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))).alias("t"), (a["m"] + F.exp(a["t"] + F.log((n - i + 1) / i) + math.log(p / (1 - p)) - start)).alias("m")),
        lambda a: F.exp(start + F.log(a["m"])),
    )
    return F.when(k >= n * p, F.lit(1.0)).when(k < 1, F.exp(start)).otherwise(step)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum and one cutoff per measure (null: none is safe), from labels(doc_id, quality)."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    # repeated rows are one trial
    held = measured.filter(~_base_failed()).join(good, "doc_id").select("stratum", "doc_id", *[c.alias(m) for m, c in _scores().items()]).distinct()
    over = [F.count(F.when(F.col(m) > c, 1)).alias(f"{m}_{i}") for m, grid in GRIDS.items() for i, c in enumerate(grid)]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *over)
    strata = counts.agg(F.count("*").alias("strata"))
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{m}_{i}").alias("k")) for m, g in GRIDS.items() for i, c in enumerate(g)]))
    tests = counts.join(F.broadcast(strata)).select("stratum", "n", "strata", grid.alias("g")).select("stratum", "n", "strata", "g.*")
    level = F.lit(delta) / (F.col("strata") * len(GRIDS))
    failed = (binomial_tail(F.col("n"), F.col("k"), alpha / len(GRIDS)) > level).cast("int")
    order = Window.partitionBy("stratum", "measure").orderBy("step")
    passed = tests.withColumn("failures", F.sum(failed).over(order)).filter("failures = 0")
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"{m}_cutoff") for m in GRIDS])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Counts, base_failed and kept for each row of docs(doc_id, text, lang)."""
    measured = stored(measures(docs), "quality")
    limits = stored(cutoffs(measured, labels.select("doc_id", "quality"), alpha, delta), "quality-cutoffs").withColumnRenamed("stratum", "s")
    out = measured.join(limits, measured["stratum"].eqNullSafe(limits["s"]), "left")
    safe = F.lit(True)
    for m, c in _scores().items():
        safe = safe & F.coalesce(c <= F.col(f"{m}_cutoff"), F.lit(True))
    out = out.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & safe)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    grid = ", ".join(f"('{m}', {i}, {c})" for m, g in GRIDS.items() for i, c in enumerate(g))
    p = alpha / len(GRIDS)
    per = "CASE WHEN {1} > 0 THEN {2} * {0} / {1} ELSE 0.0 END"
    scores = {m: per.format(*a) for m, a in {"symbols": ("n_symbols", "n_words", "100.0::DOUBLE"), "same_lines": ("n_dup_lines", "n_lines", "100.0::DOUBLE"), "capitals": ("n_capitals", "word_chars", "100.0::DOUBLE"), "word_length": ("word_chars", "n_words", "1.0::DOUBLE")}.items()}
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, [l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win),
gaps AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS g FROM twice WHERE c > 1),
rep AS (SELECT doc_id, sum(g) AS n FROM gaps GROUP BY doc_id),
m AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM w LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{c} AS {k}" for k, c in scores.items())} FROM m),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT DISTINCT doc_id, stratum, symbols, same_lines, capitals, word_length FROM s JOIN good USING (doc_id) WHERE NOT base_failed),
long AS (SELECT stratum, unnest(['symbols', 'same_lines', 'capitals', 'word_length']) AS measure, unnest([symbols, same_lines, capitals, word_length]) AS score FROM held),
grid(measure, step, cutoff) AS (VALUES {grid}),
k AS (SELECT stratum, measure, step, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS k FROM long JOIN grid USING (measure) GROUP BY ALL),
tail AS (SELECT stratum, measure, step, any_value(cutoff) AS cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) AS p, any_value(k >= n * {p}) AS above
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM k) GROUP BY stratum, measure, step),
steps AS (SELECT *, sum(CASE WHEN above OR p > {delta} / ((SELECT count(DISTINCT coalesce(stratum, chr(0))) FROM held) * {len(GRIDS)}) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, measure ORDER BY step) AS failures FROM tail),
cut AS (SELECT stratum, {", ".join(f"min(cutoff) FILTER (measure = '{m}') AS {m}_cutoff" for m in GRIDS)} FROM steps WHERE failures = 0 GROUP BY stratum)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"coalesce({m} <= {m}_cutoff, true)" for m in GRIDS)} AS kept
FROM s LEFT JOIN cut ON s.stratum IS NOT DISTINCT FROM cut.stratum"""
