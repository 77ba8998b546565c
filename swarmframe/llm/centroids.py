"""Centroid clustering with a VA-file: small cells decide most assignments, full vectors settle the rest.

Every vector is written once, with a key, its whole components and a cell number of a few bits for each component. Cells
are bounded by quantiles of a sample of at most ``sample_rows`` vectors (an index is fitted on it, never a result); a vector
with a component outside the sample's range is marked and always fetched. For a set of centroids, a lookup table holds for
each (component, cell, centroid) the least and greatest product that a value of the cell can add, so the sum over the
components is an interval that holds the vector's squared distance to the centroid, less its own squared length, which is the
same for all centroids. Where one interval lies below all others the centroid is known without the vector.

Sums of clusters change only by vectors that move. A round scans keys and cells alone, decides under the former and the
present centroids, and fetches the vectors that are undecided under either or that moved: their keys meet the bucketed table
of vectors, which is not shuffled, and add their components to the sums of the new cluster and take them from the old one.
Per partition at most one row per centroid leaves the task. All numbers are integers, so results are exact and do not depend on the order of
rows. The first round adds all vectors and the last pass writes all distances, so both read the vectors.

Cases: vectors that are null, have another number of components, or a null or non-finite component take no part, nor do those
with a component of 2^19 or more (a distance would not fit 64 bits); repeated rows and repeated or null ids are rows like any
others, null ids come last as first centroids; with fewer vectors than centroids there are as many centroids as vectors; empty
clusters keep their centroid; equal distances go to the smaller number; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_folder, settled, shipped

#: Components of this size or more cannot be clustered: squared distances would not fit 64 bits.
TOO_LARGE = 2.0 ** 19
#: Vectors a bucket of the written table is meant for.
BUCKET_ROWS = 500_000
_BLOCK = 4096


def kept_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64,
                 scale: int = 256) -> DataFrame:
    """(``vec_id``, ``v``): vectors of ``dims`` finite components as integers floor(scale * x)."""
    raw = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[vector_col].cast("array<double>").alias("x"))
    fits = (F.size("x") == dims) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE))
    return raw.where(F.coalesce(fits, F.lit(False))).select(
        "vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"))


class Cells:
    """Cells of each component: whole numbers from ``low`` to ``high``, both of shape (components, cells)."""

    def __init__(self, sample: np.ndarray, bits: int):
        n, dims = 1 << bits, sample.shape[1]
        self.bits = bits
        self.marks = [np.unique(np.quantile(sample[:, j], np.arange(1, n) / n, method="lower")) for j in range(dims)]
        self.least, self.most = sample.min(axis=0), sample.max(axis=0)
        self.low, self.high = np.zeros((dims, n), dtype=np.int64), np.zeros((dims, n), dtype=np.int64)
        for j, marks in enumerate(self.marks):
            low, high = np.append(self.least[j], marks + 1), np.append(marks, self.most[j])
            high = np.maximum(low, high)  # the greatest value may be a mark itself; nothing falls in the cell behind it
            self.low[j], self.high[j] = low[-1], high[-1]
            self.low[j, :len(low)], self.high[j, :len(high)] = low, high

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers, and true for vectors with a component outside all cells."""
        numbers = np.stack([np.searchsorted(m, vectors[:, j], side="left") for j, m in enumerate(self.marks)], axis=1)
        return numbers.astype(np.uint8), ((vectors < self.least) | (vectors > self.most)).any(axis=1)

    def packed(self, numbers: np.ndarray) -> list[bytes]:
        bits = np.unpackbits(numbers[:, :, None], axis=2)[:, :, 8 - self.bits:]
        return [row.tobytes() for row in np.packbits(bits.reshape(len(numbers), -1), axis=1)]

    def unpacked(self, rows: list[bytes]) -> np.ndarray:
        dims = len(self.marks)
        data = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
        bits = np.unpackbits(data, axis=1)[:, :dims * self.bits].reshape(len(rows), dims, self.bits)
        return (bits * (1 << np.arange(self.bits - 1, -1, -1, dtype=np.uint8))).sum(axis=2, dtype=np.uint8)


class Lookup:
    """Distance intervals from cell numbers for one set of centroids."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        one, other = (b[:, :, None] * centroids.T[:, None, :] for b in (cells.low, cells.high))
        self.least, self.most = np.minimum(one, other), np.maximum(one, other)
        self.squares = (centroids * centroids).sum(axis=1)

    def decide(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid whose interval ends first, and whether all other intervals begin behind its end."""
        least = np.zeros((len(numbers), len(self.squares)), dtype=np.int64)
        most = np.zeros_like(least)
        for j in range(numbers.shape[1]):
            least += self.least[j][numbers[:, j]]
            most += self.most[j][numbers[:, j]]
        ends = self.squares - 2 * least
        nearest = ends.argmin(axis=1)
        open_ = (self.squares - 2 * most <= ends.min(axis=1)[:, None]).sum(axis=1)
        return nearest, open_ == 1


def exact_nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroids by squared distance, the smaller number among equals. Exact: whole numbers below 2^53 or 64-bit integers."""
    small = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0))) < 1 << 22
    kind = np.float64 if small else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    return ((c * c).sum(axis=1) - 2 * (v @ c.T)).argmin(axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _assigned(cells: Cells, centroids: np.ndarray, numbers: np.ndarray, outside: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Clusters of whole rows: by intervals where these decide, by exact distance elsewhere."""
    nearest, sure = Lookup(cells, centroids).decide(numbers)
    rest = np.flatnonzero(~sure | outside)
    nearest[rest] = exact_nearest(vectors[rest], centroids)
    return nearest


def _encoded(cells: Cells, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, outside = cells.of(_matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells.packed(numbers), pa.binary()), pa.array(outside)],
                names=["key", "vec_id", "v", "cells", "outside"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            yield batch.slice(at, _BLOCK)


def _to_fetch(cells: Cells, before: np.ndarray, now: np.ndarray):
    """Keys of vectors that are undecided or have moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = Lookup(cells, before), Lookup(cells, now)
        for batch in _blocks(batches):
            numbers = cells.unpacked(batch.column("cells").to_pylist())
            (old, old_sure), (new, new_sure) = (lookup.decide(numbers) for lookup in lookups)
            stays = old_sure & new_sure & (old == new) & ~batch.column("outside").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(~stays))], names=["fetch"])

    return run


def _changes(cells: Cells | None, before: np.ndarray | None, now: np.ndarray, dims: int):
    """What the rows of a partition add to each cluster: number and sums of vectors, at most one row per cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(now), dtype=np.int64), np.zeros((len(now), dims), dtype=np.int64)
        for batch in _blocks(batches):
            vectors = _matrix(batch.column("v"), dims)
            if before is None:  # whole rows, first round
                new = _assigned(cells, now, cells.unpacked(batch.column("cells").to_pylist()),
                                batch.column("outside").to_numpy(zero_copy_only=False), vectors)
            else:
                old, new = exact_nearest(vectors, before), exact_nearest(vectors, now)
                moved = old != new
                old, new, vectors = old[moved], new[moved], vectors[moved]
                np.subtract.at(counts, old, 1)
                np.subtract.at(sums, old, vectors)
            np.add.at(counts, new, 1)
            np.add.at(sums, new, vectors)
        found = np.flatnonzero((counts != 0) | (sums != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(counts[found]), pa.array(sums[found].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    return run


def _distances(cells: Cells, centroids: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            vectors = _matrix(batch.column("v"), dims)
            nearest = _assigned(cells, centroids, cells.unpacked(batch.column("cells").to_pylist()),
                                batch.column("outside").to_numpy(zero_copy_only=False), vectors)
            away = ((vectors - centroids[nearest]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest.astype(np.int32)), pa.array(away)],
                                             names=["vec_id", "cluster", "distance"])

    return run


def _summed(changes: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Changes of all partitions together: one row per centroid reaches the driver."""
    exact = "decimal(38,0)"
    rows = changes.groupBy("cluster").agg(
        F.sum(F.col("n").cast(exact)).alias("n"),
        F.array(*[F.sum(F.get("sums", F.lit(j)).cast(exact)) for j in range(dims)]).alias("sums")).collect()
    return {r["cluster"]: (int(r["n"]), [int(x) for x in r["sums"]]) for r in rows}


class VectorFile:
    """The written table of a clustering: key, id, cells and components of every vector, in buckets of the key."""

    def __init__(self, vectors: DataFrame, bits: int, sample_rows: int, dims: int):
        spark = vectors.sparkSession
        sample = vectors.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(sample_rows).select("v").toArrow()
        self.cells = Cells(_matrix(sample.column("v").combine_chunks(), dims), bits)
        self.name, self.path = f"va_file_{uuid.uuid4().hex}", scratch_folder(spark, "va-file")
        keyed = vectors.select(F.monotonically_increasing_id().alias("key"), "vec_id", "v")
        rows = shipped(keyed).mapInArrow(_encoded(self.cells, dims), "key long, vec_id long, v array<int>, cells binary, outside boolean")
        n_buckets = max(8, -(-vectors.count() // BUCKET_ROWS))
        (rows.repartition(n_buckets, "key").write.bucketBy(n_buckets, "key").sortBy("key")
         .option("path", self.path).saveAsTable(self.name))
        self.rows = spark.table(self.name)

    def fetched(self, before: np.ndarray, now: np.ndarray) -> DataFrame:
        """Vectors that cells leave undecided, or that moved, between two sets of centroids."""
        keys = shipped(self.rows.select("key", "cells", "outside")).mapInArrow(_to_fetch(self.cells, before, now), "fetch long")
        vectors = self.rows.select("key", "v")
        return keys.join(vectors, keys["fetch"] == vectors["key"]).select("v")

    def drop(self) -> None:
        """Forget the table's name; its files lie in the scratch folder and go with the session."""
        spark, schema = self.rows.sparkSession, self.rows.schema
        self.rows = spark.read.schema(schema).parquet(self.path)
        spark.sql(f"DROP TABLE {self.name}")


def first_centroids(vectors: DataFrame, k: int, seed: int = 2) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of ``<seed>:<vec_id>``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def cluster_vectors(embeddings: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                    dims: int = 64, scale: int = 256, bits: int = 6, seed: int = 2, sample_rows: int = 20_000,
                    ) -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): (``vec_id``, ``cluster``, ``distance``) per kept vector, and the final centroids.

    ``bits`` per component (1 to 8) trade the size of the scanned cells for vectors to be fetched; results do not depend on them.
    """
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings, id_col, vector_col, dims, scale)
    now = first_centroids(vectors, k, seed)
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    file = VectorFile(vectors, bits, sample_rows, dims)
    counts, sums = [0] * len(now), [[0] * dims for _ in now]
    before = None
    for _ in range(rounds):
        if before is None:
            source = file.rows.select("cells", "outside", "v")
        else:
            source = file.fetched(before, now)
        changes = shipped(source).mapInArrow(_changes(file.cells if before is None else None, before, now, dims),
                                             "cluster int, n long, sums array<long>")
        for cluster, (n, added) in _summed(changes, dims).items():
            counts[cluster] += n
            sums[cluster] = [a + b for a, b in zip(sums[cluster], added, strict=True)]
        before, now = now, np.array([[s // n for s in total] if n else old.tolist()
                                     for n, total, old in zip(counts, sums, now, strict=True)], dtype=np.int64)
    file.drop()
    rows = shipped(file.rows.select("vec_id", "cells", "outside", "v")).mapInArrow(
        _distances(file.cells, now, dims), "vec_id long, cluster int, distance long")
    return rows, now.tolist()


def cluster_report(embeddings: DataFrame, **options: object) -> DataFrame:
    """Per kept vector: cluster, distance, the distances summed over its cluster and over all, and a digest of its centroid."""
    spark = embeddings.sparkSession
    rows, centroids = cluster_vectors(embeddings, **options)
    rows = settled(rows)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(exact.alias("s")).collect()}  # one row per centroid
    total = sum(inertia.values())
    facts = [(c, inertia.get(c, 0), total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    per_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(per_cluster, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
