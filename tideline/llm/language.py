"""Operator 2: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all learning documents. The regression is fitted on the driver, by
follow-the-regularised-leader with elastic-net penalties, on a sample of labelled documents: about MAX_DOCS rows, at
most twice as many, and one for each language that has none among them (dealt evenly over languages; each row is at most BUCKETS feature counts). A fifth of the sample is left out of the
fit and sets the temperature by which scores are calibrated. Prediction reads the whole of every text, and only the text.

Defined cases: a null text or one without letters is `und` with score 0, and so is every text if nothing could be
learned; documents without a language, or with a null doc_id, are not learned from; repeated rows are learned from
as often as they stand there; an empty table gives no rows; every language with letters in a learning text is learned; other columns are kept by `reject_unclear`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table, utf8

BITS = 15
BUCKETS = 1 << BITS
MAX_DOCS = 4000
UNKNOWN = "und"
COUNTED = "lang string, key long, at array<int>, counts array<int>"


def _fold() -> np.ndarray:
    """Code points to lower-case letters; all that is no letter to the space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_fold_table: np.ndarray | None = None


def grams(texts: pa.Array) -> Iterator[np.ndarray | None]:
    """For each text the hashed counts of its character 1-, 2- and 3-grams, or None if it has no letter."""
    global _fold_table
    if _fold_table is None:
        _fold_table = _fold()
    data, offsets = utf8(texts)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    folded = _fold_table[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        folded[i] = points[i] if chr(points[i]).isalpha() else 32
    letter = np.concatenate([[0], np.cumsum(folded != 32)])
    shift = np.uint32(32 - BITS)
    one = (folded * np.uint32(0x9E3779B1)) ^ (folded >> np.uint32(7))
    hashes = [one * np.uint32(0x85EBCA6B) >> shift]
    roll = one
    for k in (1, 2):
        roll = (roll[:-1] * np.uint32(0xC2B2AE35)) ^ one[k:] if len(roll) else roll
        roll = roll ^ (roll >> np.uint32(15))
        hashes.append((roll * np.uint32(0x27D4EB2F) + np.uint32(k * 0x165667B1)) >> shift)
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if letter[a] == letter[b]:
            yield None
        else:
            yield np.bincount(np.concatenate([h[a : max(a, b - k)] for k, h in enumerate(hashes)]), minlength=BUCKETS)


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for part in slices(batch, "text"):
            for counts in grams(part.column(0)):
                if counts is not None:
                    seen[:-1] += counts > 0
                    n += 1
    seen[-1] = n
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["feature", "n"])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [(i, np.flatnonzero(c), c[c > 0]) for i, c in enumerate(grams(part.column(0))) if c is not None]
            if rows:
                own, ends = pa.array([r[0] for r in rows]), pa.array(np.cumsum([0, *(len(r[1]) for r in rows)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in rows]).astype(np.int32))) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(1).take(own), part.column(2).take(own), *lists], names=["lang", "key", "at", "counts"])


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt((x * x).sum())


def _rows(found: pa.Table, idf: np.ndarray) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """Language, key, features and their values of each row."""
    out = []
    for batch in found.to_batches():
        at, counts = batch.column(2), batch.column(3)
        ends = at.offsets.to_numpy()
        all_at, all_counts = at.values.to_numpy(), counts.values.to_numpy()
        for lang, key, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out.append((lang, key, all_at[a:b], tfidf(all_at[a:b], all_counts[a:b], idf).astype(np.float32)))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (BUCKETS x classes) of a softmax regression over sparse rows (features, values, class)."""
    z, n, random = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes)), np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, x, y = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            miss = _softmax(x @ w)
            miss[y] -= 1
            g = x[:, None] * miss
            after = ni + g * g
            z[at] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / alpha * w
            n[at] = after
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights, heat

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for counts in grams(texts):
            if counts is None or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.flatnonzero(counts)
            p = _softmax(tfidf(at, counts[at], self.idf) @ self.weights[at] / self.heat)
            names.append(self.languages[int(p.argmax())])
            scores.append(float(min(p.max(), 1.0)))
        return names, scores


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fits on docs(doc_id, text, lang) that are not held out and have a language."""
    small_batches(docs.sparkSession)
    learning = docs.select(F.col("text").cast("string").alias("text"), "lang", F.xxhash64("doc_id", "text").alias("key"), held_out().alias("h")).filter("NOT h AND lang IS NOT NULL AND text IS NOT NULL").drop("h")
    sizes = {r["lang"]: r["count"] for r in learning.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    seen = np.zeros(BUCKETS + 1, np.int64)
    for r in learning.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        seen[r["feature"]] = r["n"]
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    languages, each = sorted(sizes), max_docs / len(sizes)
    number = {lang: i for i, lang in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, each / sizes[lang]))])
    chosen = learning.filter(F.pmod(F.shiftright("key", 11), F.lit(1 << 52)) < share[F.col("lang")] * (1 << 52)).limit(2 * max_docs)
    rows = _rows(chosen.mapInArrow(_counted, COUNTED).toArrow(), idf)
    there, lone = {r[0] for r in rows if r[1] % 5}, []
    if lacking := [lang for lang in languages if lang not in there]:
        first = learning.join(F.broadcast(docs.sparkSession.createDataFrame([(lang,) for lang in lacking], "lang string")), "lang").select("text", "lang", "key")
        first = first.mapInArrow(_counted, COUNTED).groupBy("lang").agg(F.min_by(F.struct("lang", "key", "at", "counts"), "key").alias("r"))
        lone = _rows(first.select("r.*").toArrow(), idf)
    taken = {r[:2] for r in lone}
    rows = sorted([r for r in rows if r[:2] not in taken] + lone, key=lambda r: (r[1], r[0]))
    fit = [(at, x, number[lang]) for lang, key, at, x in rows if key % 5 or (lang, key) in taken]
    rest = [(at, x, number[lang]) for lang, key, at, x in rows if not (key % 5 or (lang, key) in taken)]
    weights = ftrl(fit, len(languages))
    heat = temperature(np.stack([x @ weights[at] for at, x, _ in rest]), np.array([y for _, _, y in rest])) if rest else 1.0
    return Model(languages, idf, weights, heat)


def predictor(spark: SparkSession, model: Model):
    """A column function from text to struct(lang_pred, score)."""
    small_batches(spark)
    kept = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for part in slices(batch, "text"):
            found = kept.value.predict(part.column(0))
            names += found[0]
            scores += found[1]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict


def reject_unclear(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has letters and a language with a calibrated score of at least `least`."""
    predict = predictor(docs.sparkSession, learn(docs))
    return docs.filter(predict(docs["text"].cast("string"))["score"] >= least)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predict = predictor(spark, learn(docs))
    return docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
