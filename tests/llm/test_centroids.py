import hashlib
import math

import numpy as np
import pytest

from swarmframe.llm.centroids import Cells, Lookup, cluster_report, cluster_vectors, exact_nearest, kept_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key long, cells binary, v string, fetch long, cluster int, x string"


def table(spark, rows, n_partitions=3):
    return spark.createDataFrame([(i, v, 0, 1, b"c", "v", 2, 3, "x") for i, v in rows], SCHEMA).repartition(n_partitions)


def brute(rows, k, rounds, dims):
    """The contract, with Python's integers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2 ** 19 for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(b"2:%d" % r[0]).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, owner, strict=True) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    sums = {}
    for _, j, d in found:
        sums[j] = sums.get(j, 0) + d
    return sorted((str(i), j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                  for i, j, d in found)


def result(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def odd_rows(rng, n=150, dims=5):
    rows = [(i, rng.normal(size=dims).astype(np.float32).tolist()) for i in range(n)]
    rows += [(i, [0.25] * dims) for i in (3, 4, 5)] * 20  # one vector many times, under repeated ids
    rows += [(None, rng.normal(size=dims).astype(np.float32).tolist()) for _ in range(4)]
    rows += [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [1.0] * (dims + 1)), (904, [None] * dims), (905, [math.nan] * dims),
             (906, [math.inf] + [0.0] * (dims - 1)), (907, [-math.inf] * dims), (908, [3e38] * dims), (909, [60.0] * dims), (910, [-0.0] * dims)]
    return rows


@pytest.mark.parametrize("k,bits,sample_rows", [(7, 6, 1000), (7, 2, 40), (1, 8, 1000), (500, 4, 60)])
def test_clusters_equal_brute_force(spark, k, bits, sample_rows):
    rows = odd_rows(np.random.default_rng(k))
    got = cluster_report(table(spark, rows), k=k, rounds=3, dims=5, bits=bits, sample_rows=sample_rows)
    assert result(got) == brute(rows, k, 3, 5)


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        out = cluster_report(table(spark, rows), k=3, dims=5)
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows, centroids = cluster_vectors(table(spark, []), dims=5)
    assert rows.isEmpty() and centroids == []


def test_equal_distances_go_to_the_smaller_number(spark):
    rows = [(i, [float(x)]) for i, x in enumerate([0, 2, 1, 1, 1])]
    got = cluster_report(table(spark, rows), k=5, rounds=0, dims=1)
    assert result(got) == brute(rows, 5, 0, 1)


@pytest.mark.parametrize("bits", [1, 3, 6, 8])
def test_intervals_hold_the_distance(bits):
    rng = np.random.default_rng(bits)
    vectors, centroids = rng.integers(-400, 400, (300, 9)), rng.integers(-400, 400, (11, 9))
    cells = Cells(vectors[:100], bits)
    numbers, outside = cells.of(vectors)
    assert (cells.unpacked(cells.packed(numbers)) == numbers).all()
    inside = ~outside
    for j in range(9):
        own = numbers[inside, j]
        assert (cells.low[j][own] <= vectors[inside, j]).all() and (vectors[inside, j] <= cells.high[j][own]).all()
    nearest, sure = Lookup(cells, centroids).decide(numbers)
    sure &= inside
    assert (nearest[sure] == exact_nearest(vectors, centroids)[sure]).all()


def test_clustered_vectors_are_seldom_fetched():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-200, 200, (40, 64))
    vectors = centroids[rng.integers(0, 40, 4000)] + rng.integers(-12, 13, (4000, 64))
    cells = Cells(vectors[:1000], 6)
    numbers, outside = cells.of(vectors)
    sure = Lookup(cells, centroids).decide(numbers)[1] & ~outside
    assert sure.mean() > 0.5 and Lookup(cells, centroids).decide(numbers)[1].mean() > 0.99


def test_large_components_stay_exact():
    vectors, centroids = np.array([[2 ** 27 - 1, -(2 ** 27)]]), np.array([[-(2 ** 27), 2 ** 27 - 1], [2 ** 27 - 1, 1 - 2 ** 27]])
    assert exact_nearest(vectors, centroids).tolist() == [1]


def test_kept_vectors_are_whole_numbers(spark):
    rows = [(1, [0.1, -0.1]), (2, [0.0, 1.0])]
    got = {r.vec_id: r.v for r in kept_vectors(table(spark, rows), dims=2).collect()}
    assert got == {1: [25, -26], 2: [0, 256]}
