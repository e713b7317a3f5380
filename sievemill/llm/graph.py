"""Tallies of fixed size and connected components, shared by the duplicate finders."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, lean, stage

TALLY_BITS = 20
FILTER_BITS = 21
SLICE = 1 << 12
WIDTHS = ("<u1", "<u2", "<u4", "<i8")


def pack(counts: np.ndarray) -> bytes:
    """Compressed counters, after a byte for their width."""
    k = int(np.searchsorted([1 << 8, 1 << 16, 1 << 32], counts.max(), side="right"))
    return bytes([k]) + zlib.compress(counts.astype(WIDTHS[k]).tobytes(), 1)


def tally(df: DataFrame, count, bits: int = TALLY_BITS) -> np.ndarray:
    """Sum over all partitions of a table of 2**bits counters. count(batches) gives a partition's counters; partial tables are summed slice by slice, so the driver gets 2**bits numbers whatever the input."""

    def partial(batches):
        for k, c in slices(count(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c], pa.binary())], names=["slice", "counts"])

    return merged(df.mapInArrow(lean(partial), "slice int, counts binary"), bits)


def slices(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """A partition's counters as numbered slices, without those that are all zero."""
    return [(k // SLICE, pack(part)) for k in range(0, len(counts), SLICE) if (part := counts[k : k + SLICE]).any()]


def merged(parts: DataFrame, bits: int) -> np.ndarray:
    """The sum of the slices (slice, counts) of all partitions."""

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(c[1:]), WIDTHS[c[0]]).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(s) for s in sums.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros(1 << bits, np.int64)
    for r in parts.repartition("slice").mapInArrow(lean(merge), "slice int, counts binary").collect():
        got = np.frombuffer(zlib.decompress(r.counts[1:]), WIDTHS[r.counts[0]])
        out[r.slice * SLICE : r.slice * SLICE + len(got)] = got
    return out


def in_filter(tids: DataFrame, keep: bool = True, column: str = "tid"):
    """A function for mapInArrow that keeps rows whose value in column may stand in tids (keep=False: certainly does not): a bit table of fixed size."""
    mask = U((1 << FILTER_BITS) - 1)

    def count(batches):
        out = np.zeros(1 << FILTER_BITS, np.int64)
        for batch in batches:
            out[batch.column(0).to_numpy().view(np.uint64) & mask] = 1
        return out

    sent = tids.sparkSession.sparkContext.broadcast(tally(tids, count, FILTER_BITS) > 0)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(sent.value[(batch.column(column).to_numpy().view(np.uint64) & mask).astype(np.int64)] == keep))

    return run


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of edges (a, b): root is the least node that links reach.

    A union-find pass within partitions first; then large-star and small-star
    rounds over tables, until each node hangs from its root."""

    def forest(batches):
        up: dict[int, int] = {}

        def find(x):
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p]
            return x

        def flush():
            pairs = [(x, r) for x in list(up) if (r := find(x)) != x]
            up.clear()
            for k in range(0, len(pairs), 50_000):
                a, b = zip(*pairs[k : k + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > 1_000_000:  # bounded memory: the rounds below join what is cut here
                yield from flush()
        yield from flush()

    e = stage(edges.select("a", "b").mapInArrow(lean(forest), "a long, b long").distinct(), "edges")  # a > b
    while True:
        if not e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").take(1) and not e.groupBy("a").count().where("count > 1").take(1):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = stage(small.distinct(), "edges")
