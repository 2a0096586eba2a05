"""Connected components of links between longs, by alternating large and small stars, or by one task where they are few."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: So many edges at most are settled by one task, in some 40 MB of its memory, instead of rounds: a round of stars is six exchanges and
#: four joins, each with plans and threads in the driver, however few its edges are. More edges go in rounds.
FEW = 1 << 18


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, and of each the least node of its component. In each round every root is hooked to the least root next
    to it; in two rounds each that is not alone goes or takes another in, so they are logarithmically many."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, np.concatenate([root[a], root[b]]), np.concatenate([least, least]))
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _at_once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [[np.zeros(0, np.int64)] * 2, *([c.to_numpy() for c in batch.columns] for batch in batches)]
    nodes, roots = least_nodes(*map(np.concatenate, zip(*found, strict=True)))
    for a in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a : a + (1 << 16)]), pa.array(roots[a : a + (1 << 16)])], names=["node", "root"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) for each node of edges(u, v), stored. Up to FEW edges are settled by one task. Of more, each round's edges are stored and the
    round's before them deleted; only a count and a checksum of them reach the driver. Joins are merged at every size, as
    the many small tables of the rounds would fill the driver if broadcast. Rounds go on until nothing changes, which takes
    logarithmically many of the length of the longest path."""
    edges = edges.select("u", "v").filter("u <> v")
    if edges.count() <= FEW:
        return stored(edges.coalesce(1).mapInArrow(_at_once, "node long, root long"), "roots")
    edges, before = stored(edges.distinct(), "edges"), None
    while True:
        last, edges = edges, stored(_small(_large(edges)), "stars")
        discard(last)
        seen = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == before:
            break
        before = seen
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "roots")
    discard(edges)
    return found
