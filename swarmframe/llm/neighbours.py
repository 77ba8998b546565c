"""Approximate nearest neighbours by inner product: a forest of random-projection trees and one priority queue per query.

Trees split at the median of a projection onto the difference of two vectors. They are fitted on a bounded sample, but
every vector is indexed: it is routed to one leaf of each tree. A query walks all trees with one shared queue, best margin
first, until it has visited its number of leaves. Leaves are blocks of bounded size (a leaf with more vectors becomes
several), each block meets the queries that visit it in one task, as one matrix product, and the best of a partition are
kept per query. Candidates are scored again, exactly, in double precision.

Equal vectors are indexed once, under their least id; of a vector's ids the ``k + 1`` least are kept, as no more can be among
the ``k`` nearest. So one vector may fill any share of the table.

Cases: vectors that are null, zero, or hold null or non-finite numbers take no part, nor do null ids and vectors of another
length than most; rows that share an id count once (the least vector); ties go to the smaller id; fewer candidates than ``k``
give them all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, shipped


@dataclass
class Forest:
    """Trees of equal depth in heap order: ``planes[tree, node]`` and ``offsets[tree, node]``."""

    planes: np.ndarray
    offsets: np.ndarray
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        planes, offsets = np.zeros((trees, (1 << depth) - 1, dim)), np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            at = np.zeros(n, dtype=np.int64)
            for node in range((1 << depth) - 1):
                own = np.flatnonzero(at == node)
                direction = rng.normal(size=dim)
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    if (sample[a] != sample[b]).any():
                        direction = sample[a] - sample[b]
                direction /= np.linalg.norm(direction)
                planes[t, node] = direction
                if len(own):
                    projected = sample[own] @ direction
                    offsets[t, node] = np.median(projected)
                    at[own] = 2 * node + 1 + (projected > offsets[t, node])
        return cls(planes, offsets, depth)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.zeros((len(vectors), len(self.planes)), dtype=np.int32)
        for t in range(len(self.planes)):
            at = np.zeros(len(vectors), dtype=np.int64)
            for _ in range(self.depth):
                margin = np.einsum("ij,ij->i", vectors, self.planes[t, at]) - self.offsets[t, at]
                at = 2 * at + 1 + (margin > 0)
            out[:, t] = at - ((1 << self.depth) - 1)
        return out

    def visited(self, vector: np.ndarray, n_leaves: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the least margin by which the query is on the wrong side."""
        margins = self.planes @ vector - self.offsets
        queue, out, first = [(0.0, t, 0) for t in range(len(self.planes))], [], (1 << self.depth) - 1
        while queue and len(out) < n_leaves:
            wrong, t, node = heapq.heappop(queue)
            if node >= first:
                out.append((t, node - first))
                continue
            margin = float(margins[t, node])
            heapq.heappush(queue, (max(wrong, -margin), t, 2 * node + 2))
            heapq.heappush(queue, (max(wrong, margin), t, 2 * node + 1))
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _vector_column(vectors: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))


def best_of(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the ``k`` vectors of largest inner product, ties to smaller ids: ids and exact scores."""
    k = min(k, len(ids))
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    scores = queries @ vectors.T
    if k < len(ids):
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        # all that could tie with the last one after exact scoring
        near = scores >= least - 1e-9 * (np.abs(least) + 1)
        width = int(near.sum(axis=1).max())
        picked = np.argsort(~near, axis=1, kind="stable")[:, :width]
    else:
        picked = np.broadcast_to(np.arange(len(ids)), scores.shape)
        near = np.ones_like(scores, dtype=bool)
    exact = np.stack([(vectors[p] * q).sum(axis=1) for p, q in zip(picked, queries, strict=True)])
    exact[~np.take_along_axis(near, picked, axis=1)] = -np.inf
    top = np.argsort(-exact, axis=1, kind="stable")[:, :k]  # picked is by id, so ties stay in its order
    return ids[np.take_along_axis(picked, top, axis=1)], np.take_along_axis(exact, top, axis=1)


class _Best:
    """The best ``k`` per query so far, given back when there are many."""

    def __init__(self, k: int, limit: int = 500_000):
        self.k, self.limit, self.found, self.n = k, limit, {}, 0

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.found:
            old_ids, old_scores = self.found[query]
            self.n -= len(old_ids)
            new = ~np.isin(ids, old_ids)
            ids, scores = np.concatenate([old_ids, ids[new]]), np.concatenate([old_scores, scores[new]])
            order = np.lexsort((ids, -scores))[:self.k]
            ids, scores = ids[order], scores[order]
        self.found[query] = ids, scores
        self.n += len(ids)

    def given_back(self) -> pa.RecordBatch:
        n = [len(i) for i, _ in self.found.values()]
        query = np.repeat(np.fromiter(self.found, dtype=np.int64, count=len(self.found)), n)
        ids = np.concatenate([i for i, _ in self.found.values()]) if n else np.array([], dtype=np.int64)
        scores = np.concatenate([s for _, s in self.found.values()]) if n else np.array([], dtype=np.float64)
        self.found, self.n = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(scores)], names=["query_id", "class_id", "score"])


def _searched(dim: int, k: int, at_once: int = 256):
    """Rows of a partition by block, vectors before queries: the best of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block, ids, vectors, waiting = _Best(k), None, [], [], []

        def answer() -> None:
            if waiting and ids:
                own_ids, own = np.concatenate(ids), np.concatenate(vectors)
                q_ids, q = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
                for at in range(0, len(q_ids), at_once):
                    found, scores = best_of(q[at:at + at_once], own_ids, own, k)
                    for query, i, s in zip(q_ids[at:at + at_once].tolist(), found, scores, strict=True):
                        best.add(query, i, s)
            waiting.clear()

        for batch in batches:
            blocks, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            all_ids, matrix = batch.column(2).to_numpy(), _matrix(batch.column(3), dim)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (side[1:] != side[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if begin == end:
                    continue
                if blocks[begin] != block:
                    answer()
                    block, ids, vectors = blocks[begin], [], []
                if side[begin] == 0:
                    ids.append(all_ids[begin:end])
                    vectors.append(matrix[begin:end])
                else:
                    waiting.append((all_ids[begin:end], matrix[begin:end]))
            if sum(len(w[0]) for w in waiting) > 20_000:
                answer()
            if best.n > best.limit:
                yield best.given_back()
        answer()
        yield best.given_back()

    return run


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(``vec_id``, ``vector``) of the rows that take part, one per id."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    once = Window.partitionBy("vec_id").orderBy("vector")
    return rows.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")


def nearest(table: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, trees: int = 4,
            leaf_size: int = 1500, visit_share: float = 1.5, sample_rows: int = 20_000, block_size: int = 4096,
            max_depth: int = 10) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the ``k`` nearest other rows of each row for which ``is_query`` holds.

    ``is_query``: a column over ``vec_id``. A query visits ``visit_share`` times as many leaves as one tree has.
    """
    spark = table.sparkSession
    rows = settled(valid_vectors(table, id_col, vector_col))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    dim = sizes["dim"]
    rows = rows.where(F.size("vector") == dim)

    # equal vectors are one class, named by its least id
    of_class = Window.partitionBy("vector")
    members = rows.withColumn("nth", F.row_number().over(of_class.orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    members = settled(members.withColumn("class_id", F.min("vec_id").over(of_class)))
    classes = members.where("nth = 1").select("class_id", "vector")

    n_classes = classes.count()
    depth = int(np.clip(np.ceil(np.log2(max(n_classes, 1) / leaf_size)), 0, max_depth))
    share = min(1.0, sample_rows / n_classes)
    sample = classes.where(F.pmod(F.xxhash64("class_id", F.lit("sample")), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20))))
    vectors = np.array([r["vector"] for r in sample.orderBy("class_id").select("vector").toLocalIterator()], dtype=np.float64)
    forest = spark.sparkContext.broadcast(Forest.fit(vectors.reshape(-1, dim), trees, depth))  # trees x 2^depth planes
    n_visits = max(1, int(np.ceil(visit_share * (1 << depth))))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.value.leaves(_matrix(batch.column(1), dim))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * trees), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["class_id", "vector", "leaves"])

    index = settled(shipped(classes).mapInArrow(routed, "class_id long, vector array<double>, leaves array<int>"))
    # how many blocks each leaf needs: at most trees x 2^depth numbers
    placed = index.select("class_id", F.posexplode("leaves").alias("tree", "leaf"))
    n_blocks = np.zeros((trees, 1 << depth), dtype=np.int64)
    for r in placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect():
        n_blocks[r["tree"], r["leaf"]] = -(-r["n"] // block_size)
    first_block = (np.cumsum(n_blocks) - n_blocks.ravel()).reshape(n_blocks.shape)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, trees)
            ids = batch.column(0).to_numpy().astype(np.uint64)
            spread = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for t in range(trees):
                block = first_block[t, leaves[:, t]] + spread % n_blocks[t, leaves[:, t]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(np.zeros(len(block), dtype=np.int32)), *batch.columns[:2]], names=["block", "side", "id", "vector"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = [], []
            matrix = _matrix(batch.column(1), dim)
            for i, q in enumerate(matrix):
                own_keys = [int(first_block[at]) + b for at in forest.value.visited(q, n_visits) for b in range(int(n_blocks[at]))]
                keys += own_keys
                numbers += [i] * len(own_keys)
            for at in range(0, len(keys), 10_000):
                rows_at = np.array(numbers[at:at + 10_000], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at:at + 10_000], pa.int64()), pa.array(np.ones(len(rows_at), dtype=np.int32)),
                     batch.column(0).take(pa.array(rows_at)), _vector_column(matrix[rows_at])], names=["block", "side", "id", "vector"])

    queries = rows.where(is_query).select("vec_id", "vector")
    schema = "block long, side int, id long, vector array<double>"
    both = shipped(index).mapInArrow(dealt, schema).unionByName(shipped(queries).mapInArrow(asked, schema))
    found = both.repartition("block").sortWithinPartitions("block", "side").mapInArrow(
        _searched(dim, k + 1), "query_id long, class_id long, score double")
    # the same class may come from several trees
    found = found.groupBy("query_id", "class_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    found = found.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1).drop("nth")
    ids = members.select("class_id", "vec_id")
    named = found.join(ids, "class_id").where("vec_id != query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
