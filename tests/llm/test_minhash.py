import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmframe.llm import minhash
from swarmframe.llm.minhash import Hasher, closest, first_bands, least_matches, likely, near_duplicate_groups, possible, shingle_set, unit_survivors
from swarmframe.plans.once import stored

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, words, percent):
    sets = [shingle_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        component = least.get(find(k)) if sets[k] else i
        out.append((str(i), len(sets[k]), str(component), i == component))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def corpus(rng, families=12, size=8):
    rows = []
    for _ in range(families):
        first = [rng.choice(WORDS) for _ in range(rng.randint(30, 120))]
        for _ in range(size):
            rows.append(" ".join(edited(rng, first, rng.choice([0, 1, 1, 2, 3, 5]))))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    rows += [(500 + i, rows[3][1].upper()) for i in range(40)]  # one text many times
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "One"), (604, "one"), (605, "a b c"), (606, "A  B\nC"), (607, "a b c d"),
             (608, "a b c d " * 3000), (609, "a b c d " * 2999), (610, "é É"), (611, "é é"), (611, "é É"), (3, rows[5][1]), (None, rows[5][1]),
             (None, "alone among the texts without a name"), (None, None)]
    return rows


@pytest.mark.parametrize("words,percent,unit,share", [(4, 80, 2048, 8), (5, 80, 8, 1), (4, 60, 6, 1)])
def test_groups_equal_brute_force(spark, docs_of, words, percent, unit, share):
    rows = corpus(random.Random(words + unit))
    got = near_duplicate_groups(docs_of(rows, 4), words=words, percent=percent, unit=unit, share=share)
    assert result(got) == brute(rows, words, percent)


def test_chain_of_near_copies_in_small_units(spark, docs_of):
    """Each text links only with its neighbours, so stars alone do not join the group, and survivors exceed what a unit hands over."""
    rng = random.Random(5)
    text, rows = [rng.choice(WORDS) for _ in range(60)], []
    for i in range(60):
        rows.append((i, " ".join(text)))
        text = edited(rng, text, 1)
    assert result(near_duplicate_groups(docs_of(rows), words=4, unit=8, share=1)) == brute(rows, 4, 80)


def test_no_documents_and_other_columns(spark, docs_of):
    empty = near_duplicate_groups(docs_of([]))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    docs = docs_of([(2, "a b c d e"), (1, "A b c d e"), (3, "z")])
    for name in ("text_key", "cid", "signature", "band", "component", "own", "row_id", "salt", "a", "b", "n", "root", "first_id", "label"):
        docs = docs.withColumn(name, F.lit("other"))
    assert result(near_duplicate_groups(docs)) == [("1", 1, "1", True), ("2", 1, "1", False), ("3", 1, "3", True)]


def test_signatures_estimate_similarity():
    rng, hasher = random.Random(1), Hasher(2048)
    common, one, other = ([rng.getrandbits(64) for _ in range(n)] for n in (800, 100, 100))
    signatures = [hasher.signature(np.array(common + x, dtype=np.uint64)) for x in (one, other)]
    assert abs((signatures[0] == signatures[1]).mean() - 0.8) < 0.04


def test_pruning_bound():
    assert [least_matches(n, 0.8, 1e-7) for n in (32, 128)] == sorted(least_matches(n, 0.8, 1e-7) for n in (32, 128))
    for n in (32, 64, 128):
        m = least_matches(n, 0.8, 1e-7)
        grid = np.linspace(0, 1, 200_001)
        density = grid ** (m - 1) * (1 - grid) ** (n - m + 1)  # posterior of m - 1 agreements, uniform prior
        assert density[grid >= 0.8].sum() / density.sum() < 1e-7
    signatures = np.zeros((3, 128), dtype=np.uint32)
    signatures[1, :64] = 1
    signatures[2, :10] = 1
    assert likely(signatures, np.array([0, 0, 1]), np.array([1, 2, 2]), 0.8, 1e-7)[0].tolist() == [1]


def test_unit_survivors_cover_all_pairs_of_components():
    rng = np.random.default_rng(3)
    signatures = rng.integers(0, 2, (150, 1)).astype(np.uint32).repeat(128, axis=1)
    component = rng.integers(0, 4, 150)
    for left in (None, 70):
        got = {tuple(p[:2]) for p in unit_survivors(signatures, component, left, 0.8, 1e-7, block=16).tolist()}
        want = {(i, j) for i in range(150) for j in range(i + 1, 150) if signatures[i, 0] == signatures[j, 0]
                and component[i] != component[j] and (left is None or i < left <= j)}
        assert got == want


def test_closest_partners_of_either_end():
    rng = np.random.default_rng(4)
    pairs = np.array([(i, j, rng.integers(0, 9)) for i in range(20) for j in range(i + 1, 20) if rng.random() < 0.5])
    chosen = [set(closest(pairs, share).tolist()) for share in (1, 2, 8, 100)]
    assert all(a < b for a, b in zip(chosen, chosen[1:], strict=False)) and len(chosen[-1]) == len(pairs)
    for end in range(20):
        mine = [k for k, p in enumerate(pairs) if end in p[:2]]
        assert max(pairs[mine, 2]) in pairs[[k for k in mine if k in chosen[0]], 2]
    assert len(closest(pairs[:0], 3)) == 0


def test_first_band_of_a_pair():
    rng = np.random.default_rng(6)
    minima = rng.integers(0, 2, (40, 12)).astype(np.uint8)
    bands = minima.reshape(40, 6, 2)
    one, other = np.triu_indices(40, 1)
    agree = (bands[one] == bands[other]).all(axis=2)
    some = agree.any(axis=1)
    got = first_bands(minima, one[some], other[some], 6)
    assert got.tolist() == [row.tolist().index(True) for row in agree[some]]


def test_small_sets_rule_out_no_link():
    rng = np.random.default_rng(8)
    whole = [rng.choice(60, rng.integers(1, 60), replace=False) for _ in range(60)]
    packed = [(s % 50).astype("<u4").tobytes() if k % 7 else b"" for k, s in enumerate(whole)]  # some hashes merge, some sets are too large
    n = np.array([len(s) for s in whole])
    pairs = np.array([(i, j, 0) for i in range(60) for j in range(i + 1, 60)])
    may = possible(pairs, n, packed, 60)
    links = np.array([100 * len(set(whole[i]) & set(whole[j])) >= 60 * len(set(whole[i]) | set(whole[j])) for i, j, _ in pairs])
    assert not (links & ~may).any() and may.sum() < 0.7 * len(pairs) and links.any()


def test_verifying_plans_stay_small_and_roots_need_not_have_the_least_id(spark, monkeypatch):
    plans = {}

    def kept(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return stored(df, name)

    monkeypatch.setattr(minhash, "stored", kept)
    rng = random.Random(11)
    words = [rng.choice(WORDS) for _ in range(120)]
    # the least id comes last, so it is not the one of the class that is written first
    rows = [(100 - k, " ".join([*words[:100 + 2 * k], f"only{k}"])) for k in range(8)] + [(None, " ".join(words[:99])), (7, "alone in here")]
    rows += [(300 + k, " ".join(rng.choice(WORDS) for _ in range(50))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert result(near_duplicate_groups(docs, words=4)) == brute(rows, 4, 80)
    assert max(plans["minhash-checked"]) < 20
