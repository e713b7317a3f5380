"""Best-fit packing (operator 1).

Texts become token ids (tokenizers library) plus an end id; longer ones are cut
into pieces of the capacity. Pieces are packed best-fit decreasing: the longest
first, each into the open bin with the least room that still holds it. A segment
tree over the remaining capacities finds that bin's capacity in logarithmic time.

Pieces of one length are alike, so the driver packs lengths with counts instead
of rows: bins with the same room are kept as ranges of bin numbers, and a range
takes floor(room / length) pieces of a length at once. The packing is exactly the
one that row-wise best-fit decreasing gives, while the driver holds at most
`capacity` counts and a few ranges per length, whatever the corpus size. The r-th
piece of a length then finds its bin by binary search. Ranks within a length come
from per-partition counts and their prefix sums, so a length that a third of the
pieces share is never gathered.

Defined cases: null text counts as empty (one piece holding the end id); repeated
rows are packed as rows of their own; an empty table gives no rows; other columns
are ignored. Texts have no length limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, crc, lean, stage, table, text_bytes, workers_import
from .tokens import tokenizer as tokenizer_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over capacities 0..capacity; a leaf tells whether a bin with that room is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, np.int64)

    def add(self, room: int, change: int) -> None:
        i = self.size + room
        while i:
            self.open[i] += change
            i >>= 1

    def tightest(self, need: int) -> int:
        """Least room >= need among open bins, or -1."""
        i = self.size + need
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first bin, pieces per bin, offset in the bin) in rank order, as best-fit decreasing places its pieces."""
    tree, open_bins, bins, out = CapacityTree(capacity), {}, 0, {}

    def put(room: int, first: int, n: int) -> None:
        open_bins.setdefault(room, []).append((first, n))
        tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank, rows, back = counts[length], 0, [], []
        while left:
            room = tree.tightest(length)
            if room < 0:  # new bins for all that is left
                each = capacity // length
                full, rest = divmod(left, each)
                rows.append((rank, bins, each, 0))
                if full:
                    back.append((capacity - each * length, bins, full))
                if rest:
                    back.append((capacity - rest * length, bins + full, 1))
                bins += full + bool(rest)
                break
            first, n = open_bins[room].pop()
            tree.add(room, -n)
            each = room // length
            full, rest = divmod(left, each)
            used = min(n, full)
            rows.append((rank, first, each, capacity - room))
            if used:
                back.append((room - each * length, first, used))
            placed = used * each
            if used < n:
                if rest:
                    back.append((room - rest * length, first + used, 1))
                    placed += rest
                if n - used - bool(rest):
                    back.append((room, first + used + bool(rest), n - used - bool(rest)))
            rank, left = rank + placed, left - placed
        for room, first, n in back:
            put(room, first, n)
        out[length] = np.array(rows, np.int64)
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, leading: bool) -> DataFrame:
    """A row per piece, with its partition and its rank there among the pieces of its length."""

    def run(batches):
        tok, seen, part = tokenizer_of(tokenizer, leading), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            a, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets):
                ids, bounds = tok.run(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                docs, rows = batch.column(0).slice(i, j - i), []
                for k in range(j - i):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                    for n, at in enumerate(range(0, len(own), capacity)):
                        cut = own[at : at + capacity]
                        rows.append((k, n, at, len(cut), crc(cut), seen[len(cut)]))
                        seen[len(cut)] += 1
                k, n, at, length, check, nth = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(k)), pa.array(n.astype(np.int32)), pa.array(at), pa.array(length), pa.array(check), pa.array(np.full(len(k), part, np.int32)), pa.array(nth)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, "tokens"), PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, leading: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text) with sequence_id and offset. leading: the vocabulary keeps white space (see tokens)."""
    spark = docs.sparkSession
    workers_import(spark)
    cut = stage(pieces(docs, tokenizer, end_id, capacity, leading), "pieces")
    per_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(best_fit(totals, capacity))
    base = per_part.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = cut.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        plan = places.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own, rows = np.flatnonzero(length == n), plan[int(n)]
                first, bins, each, at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1].T
                seq[own], offset[own] = bins + (rank[own] - first) // each, at + (rank[own] - first) % each * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), PLACED)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
