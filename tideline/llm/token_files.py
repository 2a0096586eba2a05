"""Operator 3: token ids in seekable zstandard files.

A file holds documents in ascending doc_id order:

* a skippable frame (magic 0x184D2A50): `TLTK`, version, id width, order key and the doc_ids,
* one independent zstandard frame per document with its ids as little-endian unsigned integers,
* a trailing seek table (skippable frame 0x184D2A5E): compressed size, size and the low half of XXH64 of each
  frame's content, then frame count, descriptor and the magic 0x8F92EAB1.

Readers open the end of a file, find a document's frame by the table and decompress that one alone. Spark's text
writer puts the bytes on any Hadoop file system (one row a file, the last four bytes of the format as the
row's end), so its committer makes retries and lost executors harmless; `binaryFile` reads them back.

Defined cases: a null text is empty and has the end id alone; rows with a null doc_id come first; rows with equal
doc_id stand in order of their ids; an empty table makes no file and no row; other columns are not read.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, slices, table
from .tokens import default_path, encoder

HEAD, TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END = SEEKABLE.to_bytes(4, "little")
NULL_ID = -(1 << 63)


def write_file(doc_ids: list[int | None], frames: list[tuple[bytes, int, int]], width: int, key: int) -> bytes:
    """The bytes of one file. frames: compressed bytes, size and checksum of each document's ids."""
    ids = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    head = struct.pack("<4sBBqI", b"TLTK", 1, width, key, len(doc_ids)) + zstandard.ZstdCompressor(level=3).compress(ids)
    out = [struct.pack("<II", HEAD, len(head)), head]
    entries = [struct.pack("<III", len(head) + 8, 0, 0)]
    for frame, size, check in frames:
        out.append(frame)
        entries.append(struct.pack("<III", len(frame), size, check))
    body = b"".join(entries) + struct.pack("<IB", len(entries), 0x80) + END
    return b"".join([*out, struct.pack("<II", TABLE, len(body)), body])


class Reader:
    """Random access to one file; source is anything with seek and read."""

    def __init__(self, source):
        self.source = source
        source.seek(-9, io.SEEK_END)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError("no seek table")
        source.seek(-9 - 12 * count, io.SEEK_END)
        self.table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        source.seek(8)
        head = source.read(int(self.table[0, 0]) - 8)
        mark, version, self.width, self.key, n = struct.unpack("<4sBBqI", head[:18])
        if mark != b"TLTK" or version != 1 or n != count - 1:
            raise ValueError("not a token file")
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(head[18:]), "<i8")
        self.doc_ids = [None if d == NULL_ID else int(d) for d in ids]

    def __len__(self) -> int:
        return len(self.doc_ids)

    @property
    def n_ids(self) -> int:
        return int(self.table[1:, 1].sum()) // self.width

    def read(self, i: int) -> np.ndarray:
        """The ids of the i-th document; only its frame is read and decompressed."""
        self.source.seek(int(self.starts[i + 1]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[i + 1, 0])), max_output_size=int(self.table[i + 1, 1]))
        if len(raw) != self.table[i + 1, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i + 1, 2]:
            raise ValueError(f"checksum of frame {i} differs")
        return np.frombuffer(raw, f"<u{self.width}")


def _frames(path: str, end_id: int, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, press = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0).to_pylist()
                raw = [x + tok.pack[end_id] for x in tok.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0 if d is None else int(np.searchsorted(edges, d, "right")) for d in ids], pa.int32()),
                        part.column(0),
                        pa.array([press.compress(x) for x in raw], pa.binary()),
                        pa.array([len(x) for x in raw], pa.int64()),
                        pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in raw], pa.int64()),
                        pa.array([tok.width] * len(raw), pa.int32()),
                    ],
                    names=["shard", "doc_id", "frame", "size", "check", "width"],
                )

    return run


def _files(file_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, frames, size, shard, part, width = [], [], 0, None, 0, 2

        def cut() -> pa.RecordBatch:
            blob = write_file(ids, frames, width, (shard << 32) + part)
            return pa.RecordBatch.from_arrays([pa.array([blob[:-4]], pa.binary())], names=["value"])

        for batch in batches:
            for s, d, frame, n, check, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (s != shard or size + len(frame) > file_bytes):
                    yield cut()
                    part = part + 1 if s == shard else 0
                    ids, frames, size = [], [], 0
                elif s != shard:
                    part = 0
                shard, width = s, w
                ids.append(d)
                frames.append((frame, n, check))
                size += len(frame)
        if ids:
            yield cut()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_bytes: int = 16 << 20, file_bytes: int = 8 << 20) -> None:
    """Tokenizes docs(doc_id, text) and writes files to path. Shards are ranges of doc_id of about shard_bytes of
    text; a file has at most file_bytes of frames (or one larger document)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-total // shard_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(found or []))
    frames = docs.mapInArrow(_frames(tokenizer_path, end_id, bounds), "shard int, doc_id long, frame binary, size long, check long, width int")
    ordered = frames.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "check", "size")
    files = ordered.mapInArrow(_files(file_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", END.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            reader, start, rows = Reader(io.BytesIO(content.as_py())), 0, []
            for i, d in enumerate(reader.doc_ids):
                ids = reader.read(i)
                rows.append((reader.key, i, d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["file", "place", "doc_id", "first", "n_tokens", "ids_crc32"])


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            reader = Reader(io.BytesIO(content.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([reader.key], pa.int64()), pa.array([reader.n_ids], pa.int64())], names=["file", "n_ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32, and its place in the files.
    Where files begin comes from their seek tables alone: a row for each file."""
    content = spark.read.format("binaryFile").load(path).select("content")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    begins = content.mapInArrow(_totals, "file long, n_ids long").select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("begins"))
    rows = content.mapInArrow(_decoded, "file long, place long, doc_id long, first long, n_tokens long, ids_crc32 long")
    return rows.join(begins, "file").select("doc_id", (F.col("first") + F.col("begins")).alias("start"), "n_tokens", "ids_crc32", "file", "place")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, default_path())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
