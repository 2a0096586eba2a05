"""Operator 10: document scores by masked pseudo-likelihood.

A network with one hidden layer predicts a word from the WINDOW words on each side, never from the word itself. A
document's score is the sum of the log-probabilities of all its words, each from both sides. A lower-cased word's probability
is that of its class, by the network, times its share of the class's occurrences in all documents; the most frequent words are classes
of their own. The vocabulary is every word of the corpus, kept as a stored table of 64-bit hashes and counts.

The HOT most frequent words' counts are broadcast, which only spares joins; all other words are joined with the table.

Training reads every document in each round: each partition starts from the parameters of the round before and
learns the round's words (a hash of word and place deals all words to the rounds, each to one); the parameters, weighed by words,
are then averaged.
What is gathered is a set of parameters and of hash counts per partition, so it grows with the input; sums are taken
in groups, and the driver gets GROUPS rows.

Defined cases: a null, empty or white text has no words, the sum 0 and a null mean; a single word is predicted from the
borders alone; repeated rows count as often as they stand there; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower, mix, slices, spans_hash, stored, table, utf8, words

WINDOW, CLASSES, FREQUENT, HIDDEN = 3, 256, 215, 24
BORDER, GROUPS, ROUNDS = CLASSES - 1, 8, 2
SHARED = BORDER - FREQUENT
HOT, MERGE = 1 << 18, 1 << 20
SHAPES = ((2 * WINDOW, CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
AROUND = np.array([*range(-WINDOW, 0), *range(1, WINDOW + 1)])
_ONES, _TABLES = np.ones(CLASSES, np.float32), np.arange(2 * WINDOW)[:, None] * CLASSES
#: The places of the hidden values of each row of the tables, which are added in pairs, as complex numbers.
_PAIRS = np.arange(2 * WINDOW * CLASSES)[:, None] * (HIDDEN // 2) + np.arange(HIDDEN // 2)


def first_parameters(seed: int = 11) -> np.ndarray:
    random = np.random.default_rng(seed)
    return np.concatenate([(random.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).ravel() for s in SHAPES]).astype(np.float32)


def _split(flat: np.ndarray) -> list[np.ndarray]:
    cuts = np.cumsum([int(np.prod(s)) for s in SHAPES])[:-1]
    return [p.reshape(s) for p, s in zip(np.split(flat, cuts), SHAPES, strict=True)]


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and how many words begin before each text."""
    data, offsets = utf8(texts)
    data = lower(data)
    s, e, first = words(data, offsets)
    return spans_hash(data, s, e).view(np.int64), first


class Places:
    """The places of hashes in sorted keys, sought from the first key of the same leading bits on."""

    def __init__(self, keys: np.ndarray):
        bits = max(len(keys).bit_length(), 1)
        self.n, self.keys, self.shift = len(keys), np.append(keys, np.iinfo(np.int64).max), 64 - bits
        self.first = np.searchsorted(self._lead(keys), np.arange(1 << bits)).astype(np.int32)

    def _lead(self, h: np.ndarray) -> np.ndarray:
        return (h >> self.shift) + (1 << (63 - self.shift))

    def __getitem__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of those of h that are among the keys, and which of h they are."""
        at = self.first.take(self._lead(h))
        key = self.keys.take(at)
        less = np.flatnonzero(key < h)
        while len(less):
            at[less] += 1
            key[less] = self.keys.take(at[less])
            less = less[key[less] < h[less]]
        own = np.flatnonzero((key == h) & (at < self.n))
        return at[own], own


class Classes:
    """The class of each word by its hash: a class of their own for frequent words, one of SHARED classes for others."""

    def __init__(self, frequent: np.ndarray):
        order = np.argsort(frequent)
        self.places, self.numbers = Places(frequent[order]), order

    def __getitem__(self, h: np.ndarray) -> np.ndarray:
        out = FREQUENT + h % SHARED
        at, own = self.places[h]
        out[own] = self.numbers[at]
        return out.astype(np.uint8)


def padded(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes with WINDOW borders before, between and behind texts, and the places of the words."""
    n = len(first) - 1
    place = np.arange(len(classes)) + np.repeat(np.arange(n) + 1, np.diff(first)) * WINDOW
    out = np.full(len(classes) + (n + 1) * WINDOW, BORDER, np.uint8)
    out[place] = classes
    return out, place


def _hidden(tables: np.ndarray, bias: np.ndarray, near: np.ndarray, out: np.ndarray) -> None:
    total = tables.reshape(-1, HIDDEN).take(near, axis=0).sum(0)
    total += bias
    np.tanh(total, out=out[:, :HIDDEN])


def _near(line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each of AROUND, the rows of the words there in the tables, which stand one below the other."""
    return line.take(place + AROUND[:, None]) + _TABLES


def _large(out_w: np.ndarray, out_b: np.ndarray) -> bool:
    """Whether exponents could leave the range of floats; hidden values are within 1."""
    return bool((np.abs(out_w).sum(0) + np.abs(out_b)).max() > 60)


def _room(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays, filled anew by each step, for n words' hidden values, with a 1 for the bias, and for their logits."""
    return np.ones((n, HIDDEN + 1), np.float32), np.empty((n, CLASSES), np.float32)


def log_probabilities(flat: np.ndarray, line: np.ndarray, place: np.ndarray, step: int = 256) -> np.ndarray:
    tables, bias, out_w, out_b = _split(flat)
    both, out, large = flat[-(HIDDEN + 1) * CLASSES :].reshape(HIDDEN + 1, CLASSES), np.empty(len(place), np.float64), _large(out_w, out_b)
    room = _room(min(step, len(place)))
    for a in range(0, len(place), step):
        at = place[a : a + step]
        h, logits = (r[: len(at)] for r in room)
        _hidden(tables, bias, _near(line, at), h)
        np.matmul(h, both, out=logits)
        if large:
            logits -= logits.max(1, keepdims=True)
        own = logits[np.arange(len(at)), line.take(at)].astype(np.float64)
        np.exp(logits, out=logits)
        out[a : a + step] = own - np.log((logits @ _ONES).astype(np.float64))
    return out


class Learner:
    """Adaptive gradient steps on the words at given places."""

    def __init__(self, flat: np.ndarray, rate: float = 0.1):
        self.flat, self.rate = flat.copy(), rate
        self.squares = [np.full(s, 1e-7, np.float32) for s in SHAPES]
        self.parts, self.both = _split(self.flat), self.flat[-(HIDDEN + 1) * CLASSES :].reshape(HIDDEN + 1, CLASSES)
        self.room, self.row, self.gradient = _room(0), np.arange(0), np.empty(SHAPES[0], np.float32)

    def _step(self, i: int, g: np.ndarray, rows=slice(None)) -> None:
        squares, part = self.squares[i][rows], self.parts[i][rows]
        squares += g * g
        step = np.sqrt(squares)
        np.divide(g, step, out=step)
        step *= self.rate
        part -= step

    def learn(self, line: np.ndarray, place: np.ndarray) -> None:
        tables, bias, out_w, out_b = self.parts
        n, near = len(place), _near(line, place)
        if len(self.room[0]) < n:
            self.room, self.row = _room(n), np.arange(n) * CLASSES
        h, p = (r[:n] for r in self.room)
        h[:, HIDDEN] = 1
        _hidden(tables, bias, near, h)
        np.matmul(h, self.both, out=p)
        if _large(out_w, out_b):
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        total = p @ _ONES
        p.reshape(-1)[self.row[:n] + line.take(place)] -= total
        scale = (1 / (total * n))[:, None]  # of the rows of p, put to the other factor of each product
        back = p @ out_w.T
        back *= scale
        back *= 1 - h[:, :HIDDEN] ** 2
        self._step(1, h[:, HIDDEN] @ back)
        h *= scale
        g = h.T @ p
        self._step(2, g[:HIDDEN])
        self._step(3, g[HIDDEN])
        self.gradient.fill(0)
        every = self.gradient.view(np.complex64).reshape(-1)
        pairs, at = back.view(np.complex64).reshape(-1), _PAIRS.take(near, axis=0).reshape(len(near), -1)
        for k, g in enumerate(self.gradient):
            np.add.at(every, at[k], pairs)
            self._step(0, g, k)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merged() -> pa.RecordBatch:
        h, back = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([k[1] for k in kept]), minlength=len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["hash", "n"])

    kept, size = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            kept.append(np.unique(hashes(part.column(0))[0], return_counts=True))
            size += len(kept[-1][0])
            if size > MERGE:
                yield merged()
                kept, size = [], 0
    if size:
        yield merged()


def dealt(h: np.ndarray) -> np.ndarray:
    """The round in which each word of a slice is learned."""
    return (mix((h + np.arange(len(h)) * 65536).astype(np.uint64)) % np.uint64(ROUNDS)).astype(np.int64)


def _trained(start, classes, turn: int, batch_words: int = 256):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, n = Learner(start.value), 0
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = hashes(part.column(0))
                line, place = padded(classes.value[h], first)
                place = place[dealt(h) == turn]
                for a in range(0, len(place), batch_words):
                    learner.learn(line, place[a : a + batch_words])
                n += len(place)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([learner.flat.tobytes()], pa.binary())], names=["n", "flat"])

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for k, flat in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(flat.as_py(), np.float32).astype(np.float64) * k
            total, n = x if total is None else total + x, n + k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "flat"])


def _scored(flat, classes, hot):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = hashes(part.column(1))
                own = classes.value[h]
                each = log_probabilities(flat.value, *padded(own, first))
                shared = np.flatnonzero(own >= FREQUENT)
                at, known = hot.value[0][h[shared]]
                each[shared[known]] += hot.value[1][at]
                rare = np.delete(shared, known)
                total = np.concatenate([[0], np.cumsum(each)])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, first), pa.int32()), pa.array(h[rare], pa.int64()))
                rows = pa.array(np.arange(row, row + len(part)))
                row += len(part)
                yield pa.RecordBatch.from_arrays([rows, part.column(0), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]]), lists], names=["row", "doc_id", "n_words", "part", "rare"])

    return run


def vocabulary(docs: DataFrame) -> DataFrame:
    """The hash of each word of docs(text) and how often it occurs."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return stored(texts.mapInArrow(_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "vocabulary")


def most_frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of words with at least so many occurrences that they are no more than HOT, most frequent first, and that number."""
    sizes = sorted(((r["n"], r["count"]) for r in counted.groupBy("n").count().collect()), reverse=True)
    fit = int(np.searchsorted(np.cumsum([c for _, c in sizes]), HOT, "right")) if sizes else 0
    least = sizes[fit - 1][0] if fit else (sizes[0][0] if sizes else 0) + 1
    hot = counted.filter(F.col("n") >= least).select("hash", "n").toArrow()
    h, n = (hot.column(c).to_numpy().astype(np.int64) for c in ("hash", "n"))
    order = np.lexsort((h, -n))
    return h[order], n[order], least


def train(docs: DataFrame, frequent: np.ndarray | None = None) -> tuple[Classes, np.ndarray]:
    """The classes of words and the parameters, from all of docs(text)."""
    spark, texts = docs.sparkSession, docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    classes = Classes((most_frequent(vocabulary(docs))[0] if frequent is None else frequent)[:FREQUENT])
    flat, kept = first_parameters(), spark.sparkContext.broadcast(classes)
    for turn in range(ROUNDS):
        each = texts.mapInArrow(_trained(spark.sparkContext.broadcast(flat), kept, turn), "n long, flat binary")
        sums = stored(each.repartition(GROUPS).mapInArrow(_summed, "n long, flat binary"), "parameters").collect()
        if sums:
            weight = np.array([r["n"] for r in sums], np.float64)
            flat = np.average([np.frombuffer(r["flat"], np.float32) for r in sums], axis=0, weights=weight).astype(np.float32)
    return classes, flat


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum) and score (mean) for each row of docs(doc_id, text)."""
    share, counted = docs.sparkSession.sparkContext.broadcast, vocabulary(docs)
    h, n, least = most_frequent(counted)
    classes, flat = train(docs, h)
    sizes = np.zeros(SHARED)
    for r in counted.groupBy(F.pmod("hash", F.lit(SHARED)).alias("class")).agg(F.sum("n").alias("n")).collect():
        sizes[r["class"]] = r["n"]
    sizes -= np.bincount(h[:FREQUENT] % SHARED, weights=n[:FREQUENT], minlength=SHARED)
    rest, order = h[FREQUENT:], np.argsort(h[FREQUENT:])
    inside = np.log(n[FREQUENT:]) - np.log(sizes[rest % SHARED])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = texts.mapInArrow(_scored(share(flat), share(classes), share((Places(rest[order]), inside[order]))), "row long, doc_id long, n_words long, part double, rare array<long>")
    parts = stored(parts, "scored-parts")
    size = F.element_at(F.array(*[F.lit(float(x)) for x in sizes]), (F.pmod("hash", F.lit(SHARED)) + 1).cast("int"))
    rare = parts.select("row", F.explode("rare").alias("hash")).join(counted.filter(F.col("n") < least), "hash")
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"), (F.log("n") - F.log(size)).alias("part"))
    whole = parts.drop("rare").unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("part").alias("log_likelihood"))
    return whole.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("score"))


def op10_masked_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
