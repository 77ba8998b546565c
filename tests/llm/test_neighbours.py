import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmframe.llm.neighbours import Forest, best_of, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, None, "r") for i, v in rows], SCHEMA)


def brute(rows, k, dim, every=20):
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows
            if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % every == 0:
            scored = sorted((-float((v * w).sum()), i) for i, w in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6)) for i in range(50)]
    rows += [(100, [1, 0, 0, 0, 0, 0]), (140, [1, 0, 0, 0, 0, 0])] + [(200 + k, [1, 0, 0, 0, 0, 0]) for k in range(60)]
    rows += [(300, None), (320, [0] * 6), (340, [1, None, 0, 0, 0, 0]), (360, [math.nan] * 6), (380, [math.inf] * 6), (400, [1, 2]), (None, [1] * 6)]
    rows += [(60, [0, 1, 0, 0, 0, 0])] * 3
    got, want = found(nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20)), brute(rows, 20, 6)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_fewer_candidates_than_asked_for_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 1.0])]
    got = found(nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 20], 20: [0, 1]}
    assert nearest(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(table(spark, [(0, None)]), F.col("vec_id") % 20 == 0).collect() == []


def test_recall_over_many_leaves_and_split_leaves(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=32)
    centre /= np.linalg.norm(centre)
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(rng.normal(size=(2400, 32)))]
    rows += [(5000 + i, centre + 0.01 * rng.normal(size=32)) for i in range(1200)]  # a third of all, close together
    got = found(nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20, leaf_size=200, block_size=100))
    want = brute(rows, 20, 32)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values()) and recall >= 0.9


@pytest.mark.parametrize("trees", [1, 3])
def test_a_full_walk_visits_every_leaf_once(trees):
    rng = np.random.default_rng(3)
    forest = Forest.fit(rng.normal(size=(300, 5)), trees, 4)
    assert sorted(forest.visited(rng.normal(size=5), 1000)) == [(t, leaf) for t in range(trees) for leaf in range(16)]
    counts = np.bincount(forest.leaves(rng.normal(size=(300, 5)))[:, 0], minlength=16)
    assert counts.sum() == 300
    assert Forest.fit(np.ones((40, 5)), 1, 3).leaves(np.ones((2, 5))).shape == (2, 1)


def test_ties_go_to_the_smaller_id():
    ids = np.array([9, 4, 7, 1])
    found_ids, scores = best_of(np.array([[1.0, 0.0]]), ids, np.array([[1.0, 5], [1.0, 6], [1.0, 7], [0.5, 8]]), 2)
    assert found_ids.tolist() == [[4, 7]] and scores.tolist() == [[1.0, 1.0]]
