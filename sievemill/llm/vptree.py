"""Approximate nearest neighbours (operator 4): a vantage-point tree per shard.

Vectors are dealt into shards of bounded size by a hash of their id. A shard's tree
is built over its distinct vectors: a vantage point (of some, the one whose distances
vary most) and the median distance to it split a node into a near and a far half, down
to leaves of LEAF vectors. Each half knows the least and the greatest distance of its
vectors to the vantage point. A half is skipped if the triangle inequality, with the gap
between the query's distance and the half's span times `relax`, puts it beyond the k-th
best so far. relax = 1 is exact search; larger values prune more. Blocks of queries walk
a tree together: once to each query's own leaf, for a first bound, and once through all
that the bounds leave. Each shard gives its k best, and the k best of those are kept.

How much is pruned depends on the vectors: groups of like ones are found and the rest
of the tree skipped; where all vectors lie at like distances (independent directions in
many dimensions) no bound by the triangle inequality can rule one out, and exact search
measures them all. `Tree.looked` counts what leaves were asked for.

Every vector is indexed; trees are staged in the shared folder. Each task has one
shard's tree, once, and a stream of query blocks (a stated query set against all
rows). In a leaf one matrix product rules out most vectors, the rest is measured
exactly.

Defined cases: null or zero vectors, or vectors with null or non-finite components
take no part, neither as query nor as candidate; vectors of different lengths are
never compared; ties go to the smaller id; rows that repeat an id are each a
candidate, but never for their own id, and each a query with results of its own
(equal rows ask once); fewer than k candidates give fewer rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, stage, table, workers_import

SHARD_ROWS = 20_000
BLOCK_ROWS = 1024
LEAF = 64
TRIED, SEEN = 8, 128  # vantage points tried for a node, on so many of its vectors
PART_BLOCKS = 64  # blocks of queries that one task takes through a shard's tree


def valid(embedding: str) -> Column:
    return F.expr(f"{embedding} is not null and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({embedding}, x -> x <> 0)")


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision of the rows of q to one vector."""
    d = q - v
    return np.sqrt((d * d).sum(1))


def measured(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of q to the rows of v, squares added one after the other as a plain loop does, so that results don't depend on how many rows are measured at once."""
    d = v - q
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


class Tree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1])) if len(ids) else np.arange(0)
        vectors, ids = vectors[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        self.vectors = vectors[new]
        # of equal vectors the least k + 1 ids can ever be asked for (one may be the query's own)
        begin = np.flatnonzero(new)
        self.ids = [np.unique(ids[s:e])[: k + 1] if len(np.unique(ids[s:e])) == e - s else ids[s:e] for s, e in zip(begin, np.append(begin[1:], len(ids)), strict=True)]
        # how many vectors of one id there are at most: so many of the closest may be a query's own
        own = np.concatenate([np.unique(x) for x in self.ids]) if self.ids else np.empty(0, np.int64)
        self.alike = int(np.unique(own, return_counts=True)[1].max(initial=1))
        self.looked = 0
        self.root = self.split(np.arange(len(self.vectors)), np.random.default_rng(1))

    def split(self, own: np.ndarray, rng):
        if len(own) <= LEAF:
            return own
        seen = self.vectors[rng.choice(own, min(SEEN, len(own)), replace=False)]
        tried = rng.choice(own, TRIED, replace=False)
        vantage = int(tried[np.argmax([distances(seen, self.vectors[t]).var() for t in tried])])
        d = distances(self.vectors[own], self.vectors[vantage])
        middle = float(np.median(d))
        near = d <= middle
        if near.all():
            near = d < middle
            if not near.any():
                return own
            middle = float(d[near].max())
        spans = [(float(d[x].min()), float(d[x].max())) for x in (near, ~near)]
        return (vantage, middle, *spans, self.split(own[near], rng), self.split(own[~near], rng))

    def search(self, q: np.ndarray, names: np.ndarray, k: int, relax: float):
        """Rows (place of the query, id, distance), at most k a query."""
        best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

        square = (self.vectors * self.vectors).sum(1)

        def leaf(own, rows):
            """One matrix product rules out what is certainly too far (with room for its rounding); the rest is measured exactly, the closest k + 1 vectors first."""
            self.looked += len(own) * len(rows)
            v, a = self.vectors[own], (q[rows] * q[rows]).sum(1)
            rough = a[:, None] + square[own] - 2 * (q[rows] @ v.T)
            room = 1e-9 * (a[:, None] + square[own])
            limit = best_d[rows, -1] ** 2
            most = k + self.alike - 1
            if len(own) > most:
                limit = np.minimum(limit, np.partition(rough + room, most, axis=1)[:, most])  # so many vectors are that close for sure, and at least k of them are no rows of the query's id
            near = rough - room <= limit[:, None]
            for r in np.flatnonzero(near.any(1)):
                row, hit = rows[r], np.flatnonzero(near[r])
                d = measured(q[row], v[hit])
                new = [(x, i) for x, h in zip(d.tolist(), hit, strict=True) if x <= best_d[row, -1] for i in self.ids[own[h]].tolist() if i != names[row]]
                got = sorted([*zip(best_d[row].tolist(), best_i[row].tolist(), strict=True), *new])[:k]
                best_d[row], best_i[row] = [x[0] for x in got], [x[1] for x in got]

        every, home = np.arange(len(q)), np.zeros(len(q), np.int64)
        todo = [(self.root, every)]
        while todo:  # down to the leaf that its own distances point to, which gives each query a first bound
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not isinstance(node, tuple):
                leaf(node, rows)
                home[rows] = id(node)
                continue
            inside = distances(q[rows], self.vectors[node[0]]) <= node[1]
            todo += [(node[-1], rows[~inside]), (node[-2], rows[inside])]
        todo = [(self.root, every, np.zeros(len(q)))]
        while todo:  # then all other leaves in order, without what the bounds rule out
            node, rows, gap = todo.pop()  # gap: how far the query is from what this half holds, at least
            on = gap * relax <= best_d[rows, -1] * (1 + 1e-12) + 1e-12
            rows = rows[on]
            if not isinstance(node, tuple):
                rows = rows[home[rows] != id(node)]
                if len(rows):
                    leaf(node, rows)
                continue
            if not len(rows):
                continue
            vantage, _, *spans, near, far = node
            d = distances(q[rows], self.vectors[vantage])
            todo += [(half, rows, np.maximum(least - d, d - most)) for half, (least, most) in zip((far, near), reversed(spans), strict=True)]
        r, c = np.nonzero(np.isfinite(best_d))
        return r, best_i[r, c], best_d[r, c]


def matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, relax: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors: vec_id, embedding; queries: which rows ask."""
    spark = vectors.sparkSession
    workers_import(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(valid("embedding") & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per vector length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = spark.createDataFrame([(d, -(-n // shard_rows)) for d, n in sizes.items()], "dim int, shards int")
    rows = rows.join(F.broadcast(shards), "dim")

    def build(t: pa.Table) -> pa.Table:
        tree = Tree(matrix(t["embedding"]), t["vec_id"].to_numpy(), k)
        return pa.table({"dim": t["dim"].slice(0, 1), "shard": t["shard"].slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    trees = stage(dealt.select("dim", "shard", "vec_id", "embedding").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"), "trees")

    asked = rows.where(queries).select("dim", "shards", "vec_id", "embedding").distinct()  # equal rows ask once

    def block(batches):
        """Queries of one length, at most BLOCK_ROWS a row: numbered within their partition, so that rows of one id stay apart."""
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            dim = batch.column(0).to_numpy()
            for d in np.unique(dim).tolist():
                own = batch.filter(pa.array(dim == d))
                for s in range(0, own.num_rows, BLOCK_ROWS):
                    q = own.slice(s, BLOCK_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), q.column(1).slice(0, 1), pa.array([(part << 32) + number]), pa.array([q.column(2).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([matrix(q.column(3)).astype("<f8").tobytes()], pa.binary())], names=["dim", "shards", "block", "names", "q"])
                    number += 1

    blocks = stage(asked.mapInArrow(lean(block), "dim int, shards int, block long, names binary, q binary"), "queries")
    parts = -(-blocks.count() // PART_BLOCKS) or 1
    none = lambda kind: F.lit(None).cast(kind)
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    asked = blocks.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), none("binary").alias("tree"), "block", "names", "q")
    sent = trees.select("dim", "shard", each, F.lit(0).alias("kind"), "tree", none("long").alias("block"), none("binary").alias("names"), none("binary").alias("q")).union(asked)

    def search(batches):
        """Rows come by shard and part: its tree, which is loaded once, then its queries, block by block."""
        tree = None
        for batch in batches:
            for dim, kind, body, number, names, q in zip(*(batch.column(c).to_pylist() for c in ("dim", "kind", "tree", "block", "names", "q")), strict=True):
                if kind == 0:
                    tree = pickle.loads(body)
                    continue
                names = np.frombuffer(names, "<i8")
                at, near, d = tree.search(np.frombuffer(q, "<f8").reshape(len(names), dim), names, k, relax)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(at), pa.array(names[at]), pa.array(near), pa.array(d)], names=["block", "at", "query_id", "vec_id", "score"])

    dealt_ = sent.repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "kind")
    found = dealt_.mapInArrow(lean(search), "block long, at long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("block", "at").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
