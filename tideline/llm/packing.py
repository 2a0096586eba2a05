"""Operator 9: best-fit decreasing packing of token pieces.

Which piece goes where depends only on how many pieces there are of each length, so the packing is planned on that
histogram (a row for each length, at most `capacity`). The plan opens and fills bins by best fit: lengths descend, a
segment tree over remaining capacities finds the tightest open bin in logarithmic time, and all bins of one
remaining capacity are taken as runs. The plan holds runs `ranks r0.. of length L go to bins b0.., q to a bin`;
each piece is then placed by its rank among pieces of its length, which windows over small lots of a length give.
Full pieces and hot lengths are dealt out over lots, so no task gathers a length.

Defined cases: a null text is empty and has the end id alone; a repeated row is packed as often as it stands there; a null
doc_id is a document like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, stored, table
from .tokens import default_path, encoder

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, lot long"


class CapacityTree:
    """How many open bins have each remaining capacity, as a segment tree of 'any there'."""

    def __init__(self, capacity: int):
        self.size = 1 << int(capacity).bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def mark(self, cap: int, there: bool) -> None:
        i = cap + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least `need` that an open bin has."""
        i = need + self.size
        while not self.any[i]:
            while i & 1:
                i //= 2
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, first offset) in order of length and rank, and the number of bins."""
    tree, open_bins, bins, runs = CapacityTree(capacity), [[] for _ in range(capacity + 1)], 0, []

    def put(cap: int, first: int, n: int) -> None:
        if cap and n:
            if not open_bins[cap]:
                tree.mark(cap, True)
            open_bins[cap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            cap = tree.tightest(length)
            if cap is None:
                cap, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = cap // length
                first, n = open_bins[cap].pop()
                if not open_bins[cap]:
                    tree.mark(cap, False)
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - cap))
                put(cap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                runs.append((length, rank, left, first + full, left, capacity - cap))
                put(cap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(cap, first + full, n - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 6), bins


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, lot = encoder(path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for d, raw in zip(part.column(0).to_pylist(), tok.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.frombuffer(raw + tok.pack[end_id], tok.kind).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), lot))
                        lot += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])

    return run


def _placed(runs: np.ndarray, fields: list[str]):
    keys = runs[:, 0] << 44 | runs[:, 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            at = rank - row[:, 1]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 3] + at // row[:, 4]), pa.array(row[:, 5] + at % row[:, 4] * length)], names=[*fields, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, lot_rows: int = 50_000) -> DataFrame:
    """Pieces of docs(doc_id, text) with sequence_id and offset."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(docs.mapInArrow(_pieces(tokenizer_path, end_id, capacity), PIECE), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit_decreasing(counts, capacity)
    lots = max(1, -(-max(counts.values(), default=1) // lot_rows), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("lot"), F.lit(lots)))
    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "lot").agg(F.count("*").alias("n")).select("length", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("at", F.row_number().over(place) - 1).join(firsts, ["length", "lot"]).withColumn("rank", F.col("first") + F.col("at"))
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*fields, "rank").mapInArrow(_placed(runs, fields), "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long").withColumn("length", F.col("length").cast("long"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())
