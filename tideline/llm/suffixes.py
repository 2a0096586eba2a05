"""Operator 6: removal of repeated 100-byte strings by merged Burrows-Wheeler transforms.

1. Anchors. Every window of `length` bytes has as its anchor the 32-byte gram of least hash in it. Equal windows
   have equal anchors at equal places, so a window can only repeat if its anchor's hash is found twice. Anchors are
   counted over the corpus; what lies around an anchor found once is settled without being read again.
2. Segments. A run of windows with one anchor is a segment. Of equal segments the first in (doc_id, start) is the
   one to look at; all windows of the others are repeats.
3. Merging. First segments that share an anchor go to one bucket. A bucket is cut into shards, each shard's suffixes are
   sorted and give its Burrows-Wheeler transform, and the transforms are merged by iterative interleave refinement:
   each round passes the interleave through the merged transform and so sorts all suffixes by one more byte,
   without comparing suffixes of different shards; those that stand alone by then are passed over. The round in which a border between neighbours appears is their
   common prefix; the intervals without borders after all rounds are the repeated strings. The first place of each stays.
   All windows of a segment hold its anchor, so the anchor's gram is one symbol there and rounds are fewer.
   Segments of an anchor with very many are dealt out further, by ranges of the anchor's place in the window and by the
   bytes that all windows of a range share; what is still too large is taken window by window, in parts by their hashes.
4. Ranges are united per document and cut out of the text.

Defined cases: a null text is empty; texts below `length` bytes lose nothing; a null doc_id comes before all others;
rows with equal doc_id and text are one document and get equal results, rows with equal doc_id and other text stand
in order of their texts' hashes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, _P, _P_INV, _power, mix, slices, spans_hash, stored, table, utf8

GRAM = 32
BLOOM_BITS = 1 << 25
BUCKET_BYTES, SHARD_SYMBOLS, MANY, MOST_SYMBOLS = 1 << 17, 1 << 15, 4000, 1 << 21
RANGES = 4
NULL_ID = -(1 << 63)


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash and place, first window, last window and text number of each run of windows with one anchor."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    if len(data) < length:
        return none
    n = len(data) - GRAM + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, len(data)), out=total[1:])
    gram = mix((total[GRAM:] - total[:n]) * _power(_P_INV, n))
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    window = np.flatnonzero(text[: len(anchor)] == text[length - 1 : length - 1 + len(anchor)])
    if not len(window):
        return none
    at = anchor[window]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return gram[at[new]], at[new], window[new], window[last], text[window[new]]


def _sorted(high: np.ndarray, low: np.ndarray, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """`last` in the order of high, low and itself, which are all below n, and where high or low change."""
    bits = n.bit_length()
    if 3 * bits < 64:
        key = np.sort((high << 2 * bits) | (low << bits) | last)
        last, pair = key & ((1 << bits) - 1), key >> bits
    else:
        order = np.lexsort((last, low, high))
        last, pair = last[order], high[order] * n + low[order]
    return last, np.concatenate([[True], pair[1:] != pair[:-1]])


def shard_transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and Burrows-Wheeler transform of strings that each end in 0; ends are told apart by place."""
    n, ends, every = len(text), np.flatnonzero(text == 0), np.arange(len(text))
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    new = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    step = 1
    while True:
        number = np.cumsum(new) - 1
        rank = np.empty(n, np.int64)
        rank[order] = number
        if number[-1] == n - 1:
            break
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:]
        order, new = _sorted(rank, ahead, every, n)
        step *= 2
    before = np.concatenate([[0], text[:-1]])
    return order, before[order]


def merge(transforms: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms by interleave refinement. Gives the place in the concatenated transforms of each merged
    suffix, and the common prefix of each with the one before it, `length` standing for that or more. A suffix alone
    between two borders is settled; a round passes only the others through the transforms, and sorts where they differ."""
    n, bwt, begin = sum(map(len, transforms)), np.concatenate(transforms), 0
    ahead = np.empty(n, np.int64)  # the place of the suffix that is one symbol shorter
    for t in transforms:
        ahead[begin : begin + len(t)] = np.argsort(t, kind="stable") + begin
        begin += len(t)
    symbol, common = bwt[ahead], np.full(n, length, np.int32)
    source = np.argsort(symbol, kind="stable")
    symbol = symbol[source]
    new = np.concatenate([[True], symbol[1:] != symbol[:-1]])
    new[: np.count_nonzero(bwt == 0) + 1] = True
    common[new] = 0
    block, split, at = np.empty(n, np.int64), np.empty(n, bool), np.arange(n)
    start = np.maximum.accumulate(np.where(new, at, 0))
    block[source] = start
    uneven = at
    for depth in range(1, length):
        if len(uneven):
            open_ = ~(new & np.append(new[1:], True))
            at, start, new = at[open_], start[open_], new[open_]
        if not len(at):
            break
        low = block[ahead[source[at]]]
        uneven = np.flatnonzero((low[1:] != low[:-1]) & ~new[1:])
        if len(uneven):
            split[start] = False
            split[start[uneven]] = True
            which = np.flatnonzero(split[start])
            there = at[which]
            source[there], border = _sorted(start[which], low[which], source[there], n)
            common[there[border & ~new[which]]] = depth
            new[which] = border
            start[which] = np.maximum.accumulate(np.where(border, there, 0))
            block[source[there]] = start[which]
    return source, common


def repeated(strings: list[bytes], anchors: np.ndarray, leads: np.ndarray, keys: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, np.ndarray]:
    """String number and offset of each window that is not the first of its kind. Each string has its anchor's gram
    at its lead, and all its windows hold it. keys: doc, text hash and start of each."""
    total = sum(map(len, strings)) - (GRAM - 2) * len(strings)
    if total > MOST_SYMBOLS and any(len(s) > length for s in strings):
        found, parts = ([], []), np.uint64(-(-total // MOST_SYMBOLS) * length)
        for part in range(int(parts)):
            which, at = [], []
            for i, s in enumerate(strings):
                begin = np.arange(len(s) - length + 1)
                mine = begin[spans_hash(np.frombuffer(s, np.uint8), begin, begin + length) % parts == np.uint64(part)]
                which.append(np.full(len(mine), i))
                at.append(mine)
            w, o = np.concatenate(which), np.concatenate(at)
            if len(w) > 1:
                k, _ = repeated([strings[i][j : j + length] for i, j in zip(w, o, strict=True)], anchors[w], leads[w] - o, (keys[0][w], keys[1][w], keys[2][w] + o), length)
                found[0].append(w[k])
                found[1].append(o[k])
        return (np.concatenate(found[0]), np.concatenate(found[1])) if found[0] else (np.zeros(0, np.int64),) * 2
    _, name = np.unique(anchors, return_inverse=True)
    text, starts, shards, begin, size = [], [], [], 0, 0
    for i, (s, a, lead) in enumerate(zip(strings, name.tolist(), leads.tolist(), strict=True)):
        starts.append(size)
        raw = np.frombuffer(s, np.uint8)
        text += [raw[:lead].astype(np.uint16) + 1, np.array([257 + a], np.uint16), raw[lead + GRAM :].astype(np.uint16) + 1, np.zeros(1, np.uint16)]
        size += len(s) - GRAM + 2
        if size - begin >= SHARD_SYMBOLS or i == len(strings) - 1:
            shards.append((begin, size))
            begin = size
    whole, starts, window = np.concatenate(text), np.array(starts), length - GRAM + 1
    sorted_ = [shard_transform(whole[a:b]) for a, b in shards]
    place = np.concatenate([o + a for (o, _), (a, _) in zip(sorted_, shards, strict=True)])
    source, common = merge([t for _, t in sorted_], window)
    group = np.cumsum(common < window)
    many = np.bincount(group)[group] > 1
    at, group = place[source[many]], group[many]
    string = np.searchsorted(starts, at, "right") - 1
    offset = at - starts[string]
    doc, hashed, start = (k[string] for k in keys)
    order = np.lexsort((start + offset, hashed, doc, group))
    later = order[1:][group[order[1:]] == group[order[:-1]]]
    return string[later], offset[later]


def _unite(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unites ranges that overlap or touch within each key; sorted by key and start."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    if not len(key):
        return key, start, end
    span = int(end.max()) + 2
    reach = np.maximum.accumulate(end + key * span)
    new = np.concatenate([[True], start[1:] + key[1:] * span > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(key)]]) - 1
    return key[first], start[first], reach[last] - key[first] * span


def _anchors(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                gram, _, _, _, text = segments(*utf8(part.column(1)), length)
                order = np.lexsort((gram, text))
                gram, text = gram[order], text[order]
                same = (gram[1:] == gram[:-1]) & (text[1:] == text[:-1])
                first = np.concatenate([[True], ~same]) if len(gram) else np.zeros(0, bool)
                twice = np.concatenate([same, [False]]) if len(gram) else np.zeros(0, bool)
                hashed = part.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), pa.array(hashed[text[first]]), pa.array(twice[first])], names=["anchor", "th", "twice"])

    return run


def _bits(anchor: np.ndarray) -> np.ndarray:
    x = anchor.view(np.uint64)
    return np.stack([x & np.uint64(BLOOM_BITS - 1), (x >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)])


def _bloom(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BLOOM_BITS // 64, np.uint64)
    for batch in batches:
        at = _bits(batch.column(0).to_numpy()).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["place", "bits"])


def _segments(bloom, length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = bloom.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column(1))
                gram, anchor, first, last, text = segments(data, offsets, length)
                at = _bits(gram.view(np.int64))
                keep = ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)
                gram, anchor, first, last, text = gram[keep], anchor[keep], first[keep], last[keep], text[keep]
                end = last + length
                content = spans_hash(data, first, end)
                doc = part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                hashed = part.column(2).to_numpy(zero_copy_only=False)
                raw, strings = data.tobytes(), []
                for c, a, b in zip(content.tolist(), first.tolist(), end.tolist(), strict=True):
                    strings.append(None if c in sent else raw[a:b])
                    sent.add(c)
                if len(sent) > 500_000:
                    sent.clear()
                columns = [gram.view(np.int64), content.view(np.int64), doc[text], hashed[text], first - offsets[text], end - first, anchor - first]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32 if k == 6 else np.int64)) for k, c in enumerate(columns)), pa.array(strings, pa.binary())], names=["anchor", "content", "doc", "th", "start", "size", "lead", "bytes"])

    return run


def _dealt(length: int, buckets: int):
    """Gives each segment its bucket; those of an anchor with many are cut by ranges of the anchor's place in a window."""
    width = length - GRAM
    edges = [width * k // RANGES for k in range(RANGES)] + [width + 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(7)]
            for anchor, n, doc, th, start, lead, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n <= MANY:
                    rows = [(anchor % buckets, anchor, doc, th, start, lead, raw)]
                else:
                    rows = []
                    least = lead - (len(raw) - length)
                    for low, high in zip(edges[:-1], edges[1:], strict=True):
                        a, b = max(low, least), min(high - 1, lead)
                        if a <= b:
                            shared = raw[lead - low : lead + length - (high - 1)]
                            key = zlib.crc32(shared) << 20 ^ zlib.crc32(shared[::-1]) + low
                            rows.append((key % buckets, anchor, doc, th, start + lead - b, b, raw[lead - b : lead - a + length]))
                for column, values in zip(out, zip(*rows, strict=True), strict=True):
                    column.extend(values)
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["bucket", "anchor", "doc", "th", "start", "lead", "bytes"])

    return run


def _merged(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["doc"].to_numpy(), pdf["th"].to_numpy(), pdf["start"].to_numpy()
        string, offset = repeated(list(pdf["bytes"]), pdf["anchor"].to_numpy(), pdf["lead"].to_numpy(), keys, length)
        string, start, end = _unite(string, offset, offset + length)
        base = keys[2][string]
        return pd.DataFrame({"doc": keys[0][string], "th": keys[1][string], "start": base + start, "end": base + end})

    return run


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for d, text, copy, ranges in zip(*batch.columns, strict=True):
            raw = (text.as_py() or "").encode()
            if copy.as_py():
                at = np.array([[0, len(raw)]])
            else:
                at = np.array([(r["start"], r["end"]) for r in ranges.as_py() or ()], np.int64).reshape(-1, 2)
            _, start, end = _unite(np.zeros(len(at), np.int64), at[:, 0], at[:, 1])
            kept, done = hashlib.sha256(), 0
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                kept.update(raw[done:a])
                done = b
            kept.update(raw[done:])
            rows.append((d.as_py(), len(raw), int((end - start).sum()), len(start), kept.hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def ranges(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc, th (the text's hash), start, end: repeated ranges of docs(doc_id, text, th); they may overlap. Whole copies
    of an earlier text are not among them."""
    spark = docs.sparkSession
    found = docs.filter(F.octet_length("text") >= length).mapInArrow(_anchors(length), "anchor long, th long, twice boolean")
    again = stored(found.groupBy("anchor").agg(F.min("th").alias("a"), F.max("th").alias("b"), F.max("twice").alias("twice")).filter("a <> b OR twice").select("anchor"), "anchors")
    bits = np.zeros(BLOOM_BITS // 64, np.uint64)
    for batch in again.mapInArrow(_bloom, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    bloom = spark.sparkContext.broadcast(bits)
    rows = docs.filter(F.octet_length("text") >= length).mapInArrow(_segments(bloom, length), "anchor long, content long, doc long, th long, start long, size long, lead int, bytes binary")
    rows = stored(rows, "segments")
    place = F.struct("doc", "th", "start")
    firsts = rows.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.first("lead").alias("lead"))
    firsts = stored(firsts, "first-segments")
    copies = rows.select("anchor", "content", "doc", "th", "start", "size").join(firsts.filter("n > 1").select("anchor", "content", "first"), ["anchor", "content"])
    copies = copies.filter(place != F.col("first")).select("doc", "th", "start", (F.col("start") + F.col("size")).alias("end"))
    many = firsts.groupBy("anchor").agg(F.count("*").alias("segments"), F.sum(F.octet_length("bytes")).alias("size")).filter("segments > 1")
    many = stored(many, "shared-anchors")
    buckets = max(1, -(-(many.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))
    several = firsts.join(many.select("anchor", "segments"), "anchor").select("anchor", "segments", "first.doc", "first.th", "first.start", "lead", "bytes")
    dealt = several.mapInArrow(_dealt(length, buckets), "bucket long, anchor long, doc long, th long, start long, lead int, bytes binary")
    merged = dealt.groupBy("bucket").applyInPandas(_merged(length), "doc long, th long, start long, end long")
    return copies.unionByName(merged)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    found = stored(ranges(docs, length), "ranges")
    lists = found.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    first = docs.select(key.alias("doc"), "th").groupBy("th").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).filter("first_doc < last_doc").select(F.col("th").alias("t"), "first_doc")
    marks = docs.select(key.alias("doc"), "th", F.octet_length("text").alias("size"))
    copies = marks.join(first, F.col("th") == F.col("t")).filter((F.col("doc") > F.col("first_doc")) & (F.col("size") >= length)).select("doc", "th", F.lit(True).alias("copy")).distinct()
    known = lists.join(copies, ["doc", "th"], "full_outer").select(F.col("doc").alias("d"), F.col("th").alias("t"), "copy", F.when(F.col("copy").isNull(), F.col("ranges")).alias("ranges"))
    out = docs.join(known, (key == F.col("d")) & (docs["th"] == F.col("t")), "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "ranges")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
