"""Operator 7: n-gram Jaccard join by prefixes under several global token orders.

A document's tokens are its distinct word shingles. In any global order of tokens, two sets whose Jaccard similarity
is at least t share a token among the first n - ceil(t n) + 1 of each. Three orders are used: by length of the whole
shingle, by its longest word (long ones are rare in any corpus), and by hash alone; tokens known to be frequent
stand last in each, the more frequent the later. The first order makes candidates; those that do not also share a
prefix token in the second and third go before their texts are compared; the rest are verified on whole texts. A pair is
also dropped at a token if too few tokens of either are left from its place on, which cannot hold for the first
token that near documents share.

Equal sets (by two independent 64-bit hashes) are one class from the start. Of tokens that stand in the same classes one is enough. Within the classes of a prefix token, candidates are first pairs with
one hub (the one with the fewest tokens of its own), a row for each member, so a large group of near copies never becomes all its pairs. Components of the links
found are then taken, and only classes of a common token that are still in different components are paired. Classes of
a token that still has more than CROWD of those are paired by their prefix tokens in the second order instead, those of
crowds there in the third, and where more than CROWD squared share one even there, by two tokens: near classes share tokens in all orders.
Every link that could join two components is thus tried.

Defined cases: null, empty or white texts have no shingles and no links; fewer words than a shingle make one token;
repeated rows are one class; a null doc_id never names a component of others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lower, mix, slices, small_batches, stored, table, utf8, words, words_hash
from .components import components

#: Tokens that partitions have seen more than COMMON times stand last, MOST_COMMON of them at most (9 bytes each are
#: broadcast). Any set of tokens here gives the same results; a good one gives fewer candidates.
COMMON, MOST_COMMON, COUNTED = 1, 1 << 20, 1 << 19
CROWD = 64
BLOOM_BITS = (1 << 20, 1 << 27)
NULL_ID = -(1 << 63)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(texts: pa.Array, k: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its distinct shingles' hashes, their lengths in bytes, and the lengths of their longest words."""
    data, offsets = utf8(texts)
    data = lower(data)
    s, e, first = words(data, offsets)
    h, size = words_hash(data, s, e), (e - s).astype(np.int32)
    del data, s, e
    n = max(len(h) - k + 1, 0)
    roll, total, longest = np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(k):
        roll = roll * _B + h[i : i + n] * _A
        total += size[i : i + n]
        np.maximum(longest, size[i : i + n], out=longest)
    roll = mix(roll)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            found, at = np.unique(roll[a : b - k + 1], return_index=True)
            yield found, total[a + at], longest[a + at]
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for x in h[a:b]:
                whole = whole * _C + x
            yield mix(whole + np.uint64(b - a)), size[a:b].sum(keepdims=True), size[a:b].max(keepdims=True)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)


def set_hashes(tokens: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two independent hashes of a set; (0, 0) for the empty one."""
    if not len(tokens):
        return np.uint64(0), np.uint64(0)
    both = np.array([tokens.sum(dtype=np.uint64) + np.uint64(len(tokens)), mix(tokens ^ _C).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)
    return tuple(mix(both))


class Late:
    """Frequent tokens, sorted, and the binary order of magnitude of each one's frequency."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.level = tokens[order], np.log2(np.maximum(counts[order], 1)).astype(np.uint8)

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of frequent ones among tokens, and their levels."""
        if not len(self.tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        own = np.flatnonzero(self.tokens[at] == tokens)
        return own, self.level[at[own]].astype(np.uint64)


def _first(tokens: np.ndarray, lead: np.ndarray | None, order: int, late: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The first n tokens in an order: late ones last, by level, then long ones first where a lead is given, then by a hash of the
    order. It is a function of the token alone, so it is the same everywhere."""
    rank = mix(tokens ^ np.uint64(0xD6E8FEB86659FD93 * (order + 1) & (1 << 64) - 1)) >> np.uint64(9)
    if lead is not None:
        rank |= (255 - np.minimum(lead, 255)).astype(np.uint64) << np.uint64(55)
    own, level = late
    if len(own):
        rank[own] = (rank[own] >> np.uint64(8)) | level << np.uint64(55) | np.uint64(1 << 63)
    at = np.argpartition(rank, n - 1)[:n] if n < len(tokens) else np.arange(len(tokens))
    return tokens[at[np.argsort(rank[at])]]


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _short(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _frequent(k: int):
    """Tokens seen more than once in a partition, with their counts: what is seen once is forgotten when COUNTED tokens
    have gathered, so memory stays bounded and only frequent tokens are sent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, new, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            each = np.concatenate([known, *new])
            found, back = np.unique(each, return_inverse=True)
            n = np.bincount(back[: len(known)], weights=counts, minlength=len(found)) + np.bincount(back[len(known) :], minlength=len(found))
            keep = n > 1
            return found[keep], n[keep].astype(np.int64)

        for batch in batches:
            for part in slices(batch, "text"):
                for tokens, _, _ in shingles(part.column(0), k):
                    new.append(tokens)
                    size += len(tokens)
                if size > COUNTED:
                    known, counts = merged()
                    new, size = [], 0
        if size:
            known, counts = merged()
        for a in range(0, len(known), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(known[a : a + (1 << 16)].view(np.int64)), pa.array(counts[a : a + (1 << 16)])], names=["token", "n"])

    return run


def late_tokens(texts: DataFrame, k: int) -> Late:
    """Of tokens of texts(text) seen more than COMMON times the most frequent, MOST_COMMON or, as steps of frequency are taken whole, fewer."""
    seen = texts.mapInArrow(_frequent(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > COMMON)
    seen = stored(seen.withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "frequent-tokens")
    fit, steps = 0, sorted(seen.groupBy("step").count().collect(), reverse=True)
    while fit < len(steps) and sum(r["count"] for r in steps[: fit + 1]) <= MOST_COMMON:
        fit += 1
    found = seen.filter(F.col("step") >= (steps[fit - 1]["step"] if fit else 1 << 20)).select("token", "n").toArrow()
    discard(seen)
    return Late(found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy())


def _lists(found: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else [], kind))


def _hashes(found: list[tuple[np.uint64, np.uint64]]) -> list[pa.Array]:
    both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in range(2)]


def _sets(late, k: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, row = late.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                n, h, prefix = [], [], []
                for tokens, size, _ in shingles(part.column(2), k):
                    n.append(len(tokens))
                    h.append(set_hashes(tokens))
                    prefix.append(_first(tokens, size, 0, common(tokens), _prefix_size(len(tokens), percent)).view(np.int64) if len(tokens) else tokens.view(np.int64))
                rows = pa.array(np.arange(row, row + len(n)))
                row += len(n)
                yield pa.RecordBatch.from_arrays([rows, part.column(0), part.column(1), pa.array(n, pa.int64()), *_hashes(h), _lists(prefix, pa.int64())], names=["row", "doc_id", "t", "n", "h", "g", "p1"])

    return run


def _bits(doc: np.ndarray, bits: int) -> np.ndarray:
    x = mix(doc.view(np.uint64) ^ _A)
    return np.stack([x & np.uint64(bits - 1), (x >> np.uint64(32)) & np.uint64(bits - 1)])


def _bloom(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits).ravel()
            np.bitwise_or.at(filled, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(filled)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(filled[at].view(np.int64))], names=["place", "bits"])

    return run


def _filter(keys: DataFrame) -> np.ndarray:
    """A filter of keys, one column of longs, sized by their number."""
    bits = min(max(BLOOM_BITS[0], 1 << (keys.count() * 16).bit_length()), BLOOM_BITS[1])
    filled = np.zeros(bits // 64, np.uint64)
    for batch in keys.mapInArrow(_bloom(bits), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        filled[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return filled


def _let_through(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits(keys, len(filled) * 64)
    return ((filled[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)


def _may_be_in(bloom):
    @F.pandas_udf("boolean")
    def held(keys: pd.Series) -> pd.Series:
        return pd.Series(_let_through(bloom.value, keys.to_numpy(np.int64)))

    return held


def _signed(bloom, late, k: int, percent: int, with_text: bool):
    """Of rows whose doc_id the filter does not rule out: the set's hashes, its prefixes in the second and third order, and
    the compressed text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, common, press = bloom.value, late.value, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            doc = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for part in slices(batch.filter(pa.array(_let_through(filled, doc))), "text"):
                h, orders, z = [], ([], []), []
                for text, (tokens, _, longest) in zip(part.column(1), shingles(part.column(1), k), strict=True):
                    if len(tokens):
                        h.append(set_hashes(tokens))
                        last, p = common(tokens), _prefix_size(len(tokens), percent)
                        for i, lead in enumerate((longest, None)):
                            orders[i].append(_short(_first(tokens, lead, i + 1, last, p)))
                        z.append(press.compress(text.as_py().encode()) if with_text else b"")
                if h:
                    yield pa.RecordBatch.from_arrays([*_hashes(h), _lists(orders[0], pa.int32()), _lists(orders[1], pa.int32()), pa.array(z, pa.binary())], names=["h", "g", "p2", "p3", "z"])

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        hub, hub_set = None, None

        def tokens(z: bytes) -> np.ndarray:
            return next(shingles(pa.array([press.decompress(z).decode()], pa.string()), k))[0]

        for batch in batches:
            u, v = [], []
            for a, b, za, zb in zip(*(batch.column(i) for i in range(4)), strict=True):
                if a.as_py() != hub:
                    hub, hub_set = a.as_py(), tokens(za.as_py())
                other = tokens(zb.as_py())
                both = len(np.intersect1d(hub_set, other, assume_unique=True))
                if 100 * both >= percent * (len(hub_set) + len(other) - both):
                    u.append(hub)
                    v.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


class _Join:
    """rows: row, doc_id, t, n, h and g of every row with tokens; classes: one row for each different set, named by its least row."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        small_batches(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.late = self.spark.sparkContext.broadcast(late_tokens(self.docs.select("text"), k))
        marked = self.docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
        self.rows = stored(marked.mapInArrow(_sets(self.late, k, percent), "row long, doc_id long, t long, n long, h long, g long, p1 array<long>"), "shingle-sets")
        self.classes = stored(self.rows.filter("n > 0").groupBy("h", "g").agg(F.min("row").alias("c"), F.min("doc_id").alias("rep"), F.first("n").alias("n")), "shingle-classes")
        first = self.rows.select("row", "n", "p1").join(self.classes.select(F.col("c").alias("row")).hint("merge"), "row", "left_semi")
        one = stored(first, "class-prefixes")
        lists = one.select(F.col("row").alias("c"), F.col("n").cast("int").alias("n"), F.posexplode("p1").alias("at", "token"))
        shared = lists.groupBy("token").count().filter("count > 1").select("token")
        # here and below, what grows with the input is merged at every size
        every = stored(lists.join(shared.hint("merge"), "token", "left_semi").select("token", "c", "n", "at"), "shared-tokens")
        members = every.groupBy("token").agg(*self._members())
        self.lists = stored(every.join(self._first_of_same(members, ["token"]).hint("merge"), "token", "left_semi"), "shingle-lists")
        discard(every, one)

    @staticmethod
    def _members() -> list[Column]:
        """Columns that tell which classes stand at a token, and where the least of them has it."""
        return [F.count("*").alias("size"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("y"), F.min_by("at", "c").alias("lead")]

    @staticmethod
    def _first_of_same(members: DataFrame, keys: list[str]) -> DataFrame:
        """Of keys at which the same classes stand one: they make the same pairs, and the first in the order is first in each class."""
        return members.groupBy("size", "x", "y").agg(F.min(F.struct("lead", *keys)).alias("first")).select(*[f"first.{k}" for k in keys], "size")

    def _may(self, a: str, b: str) -> Column:
        """Whether two classes whose first common token is this one can be near: by their sizes, and by how many
        tokens of each are left from its place on."""
        na, nb = F.col(f"{a}n").cast("long"), F.col(f"{b}n").cast("long")
        left = F.least(na - F.col(f"{a}at"), nb - F.col(f"{b}at"))
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * self.percent) & (left * (100 + self.percent) >= (na + nb) * self.percent)

    def signed(self, used: DataFrame, name: str, with_text: bool) -> DataFrame:
        """c, p2, p3 and z of used(c) classes, read from texts that a filter of their doc_ids lets through."""
        own = stored(self.classes.join(used.hint("merge"), "c", "left_semi").select("c", "h", "g", F.coalesce("rep", F.lit(NULL_ID)).alias("rep")), f"{name}-used")
        share = self.spark.sparkContext.broadcast(_filter(own.select("rep")))
        texts = self.docs.filter("text IS NOT NULL").mapInArrow(_signed(share, self.late, self.k, self.percent, with_text), "h long, g long, p2 array<int>, p3 array<int>, z binary")
        one = texts.dropDuplicates(["h", "g"]).join(own.select("c", "h", "g").hint("merge"), ["h", "g"]).drop("h", "g")
        out = stored(one, f"{name}-signed")
        discard(own)
        return out

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs(a, b) of classes, those that all orders allow and their texts confirm."""
        pairs = stored(pairs, f"{name}-pairs")
        if pairs.isEmpty():
            discard(pairs)
            return self.spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))
        sign = self.signed(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct(), name, True)
        one = pairs.join(sign.select(F.col("c").alias("b"), F.col("p2").alias("q2"), F.col("p3").alias("q3")).hint("merge"), "b")
        two = one.join(sign.select(F.col("c").alias("a"), "p2", "p3").hint("merge"), "a")
        left = stored(two.filter(F.arrays_overlap("p2", "q2") & F.arrays_overlap("p3", "q3")).select("a", "b"), f"{name}-candidates")
        hubs = sign.select(F.col("c").alias("a"), F.col("z").alias("za")).join(left.select("a").distinct().hint("merge"), "a", "left_semi")
        other = left.join(sign.select(F.col("c").alias("b"), F.col("z").alias("zb")).hint("merge"), "b")
        full = other.join(hubs.hint("merge"), "a").select("a", "b", "za", "zb")
        out = stored(full.mapInArrow(_verified(self.k, self.percent), "u long, v long"), f"{name}-links")
        discard(pairs, sign, left)
        return out

    def _pairs(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Pairs of classes in different components that share the keys."""
        a, b = rows.alias("a"), rows.alias("b")
        apart = (F.col("a.c") < F.col("b.c")) & (F.col("a.root") != F.col("b.root")) & self._may("a.", "b.")
        for k in keys:
            apart = apart & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        return a.join(b.hint("merge"), apart).select(F.col("a.c").alias("a"), F.col("b.c").alias("b"))

    def _crowds(self, rows: DataFrame, keys: list[str], most: int, name: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose keys have several components: those of keys with `most` classes or less, and those with more."""
        each = rows.groupBy(*keys).agg(*self._members(), F.min("root").alias("least"), F.max("root").alias("greatest")).filter("least <> greatest")
        first = self._first_of_same(each, keys).select(*keys, (F.col("size") > most).alias("crowd"))
        placed = stored(rows.join(first.hint("merge"), keys), name)
        return placed.filter("NOT crowd").drop("crowd"), placed.filter("crowd").drop("crowd")

    def rest(self, roots: DataFrame) -> DataFrame:
        """Pairs of classes of a common token that are in different components."""
        placed = self.lists.join(roots.select(F.col("node").alias("c"), "root").hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        few, many = self._crowds(placed, ["token"], CROWD, "rest-lists")
        pairs, sign = self._pairs(few, ["token"]), None
        for order, most in (("p2", CROWD), ("p3", CROWD**2)):
            if not many.limit(1).count():
                return pairs.distinct()
            crowd = many.select("c", "n", "root").distinct()
            sign = sign or self.signed(crowd.select("c"), "crowd", False)
            few, many = self._crowds(crowd.join(sign.select("c", F.posexplode(order).alias("at", "token")).hint("merge"), "c"), ["token"], most, f"rest-{order}")
            pairs = pairs.unionByName(self._pairs(few, ["token"]))
        both = many.join(sign.select("c", F.explode("p2").alias("two")).hint("merge"), "c")
        return pairs.unionByName(self._pairs(both, ["token", "two"])).distinct()

    def run(self) -> DataFrame:
        """c and root of each class that has links."""
        place = F.struct((F.col("at") / F.col("n")).alias("share"), "c", "n", "at")  # the hub has the token earliest, so it has the fewest tokens of its own
        hubs = self.lists.groupBy("token").agg(F.min(place).alias("hub"))
        star = self.lists.join(hubs.hint("merge"), "token").filter(F.col("hub.c") != F.col("c")).filter(self._may("hub.", "")).select(F.col("hub.c").alias("a"), F.col("c").alias("b")).distinct()
        edges = self.links(star, "star")
        roots = components(edges)
        more = self.links(self.rest(roots), "rest")
        discard(self.lists)
        if not more.isEmpty():
            discard(roots)
            roots = components(edges.unionByName(more))
        discard(edges, more)
        return roots


def _joined(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, t (the text's hash), n, c (null without tokens) and component_id of each row."""
    work = _Join(docs, k, percent)
    roots = work.run()
    named = work.classes.join(roots.select(F.col("node").alias("c"), "root").hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stored(named.join(least.hint("merge"), "root").select("h", "g", "root", "component_id"), "class-components")
    rows = stored(work.rows.select("doc_id", "t", "n", "h", "g"), "shingle-rows")
    discard(work.rows, work.classes, roots)
    return rows.join(named.hint("merge"), ["h", "g"], "left").select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("root")).alias("c"), F.when(F.col("n") > 0, F.col("component_id")).alias("component_id"))


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text)."""
    return _joined(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row of docs for each component: the one with the least doc_id (none last), and of those with the least hash of
    the text. Documents are told by doc_id and text, so another text under the same doc_id is judged by itself. Rows with
    equal doc_id and text are one document, of which the row with the least hash of all its columns stays. Texts without
    words are no one's copies and all stay."""
    found = stored(_joined(docs, k, percent).filter("n > 0").groupBy("c", "doc_id", "t").agg(F.count("*").alias("rows")), "component-members")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    best = found.groupBy("c").agg(F.min(place).alias("best"))
    judged = found.join(best.hint("merge"), "c").select("doc_id", "t", "rows", (place == F.col("best")).alias("stays"))
    marks = stored(judged.filter("NOT stays OR rows > 1").select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t"), "stays"), "copies")
    discard(found)
    doc, t = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    same = doc.eqNullSafe(F.col("__doc")) & (t == F.col("__t"))
    # rows that a filter of the marks rules out stay where they are, so only the others are shuffled with their texts
    may = _may_be_in(docs.sparkSession.sparkContext.broadcast(_filter(marks.select(F.xxhash64("__doc", "__t")))))(F.xxhash64(doc, t))
    some = docs.filter(may)
    left = docs.filter(~may).union(some.join(marks.drop("stays").hint("merge"), same, "left_anti"))
    if not marks.filter("stays").limit(1).count():
        return left
    names = docs.columns
    again = some.join(marks.filter("stays").hint("merge"), same).select("__doc", "__t", F.struct(*[some[c] for c in names]).alias("__row"))
    once = again.groupBy("__doc", "__t").agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row"))
    return left.unionByName(once.select("__row.*"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
