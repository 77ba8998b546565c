import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from swarmframe.llm.common import settled
from swarmframe.llm.components import components
from swarmframe.llm.exact_dedup import FuseFilter, exact_duplicates
from swarmframe.llm.line_dedup import drop_shared_lines, shared_lines
from swarmframe.llm.simhash import fingerprint, first_of_each_group, near_links, simhash_groups, tile_links

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values, radius):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near_values(rng, n_centres, per_centre, bits):
    out = set()
    for _ in range(n_centres):
        centre = rng.getrandbits(64)
        for _ in range(per_centre):
            value = centre
            for b in rng.sample(range(64), rng.randint(0, bits)):
                value ^= 1 << b
            out.add(value)
    return sorted(out)


def test_fingerprints_follow_the_definition():
    for text in [None, "", " \n", "One", "a b c", "A B C D", "a b c d e f a b c d " * 9, "é É x\xa0y\tz w É"]:
        assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("left", [None, 300])
def test_tiles_connect_what_all_pairs_connect(left):
    rng = random.Random(2)
    values = np.array(near_values(rng, 12, 60, 3), dtype=np.uint64)
    if left is None:
        values = values[np.argsort(np.bitwise_count(values), kind="stable")]
    else:
        values = np.concatenate([v[np.argsort(np.bitwise_count(v), kind="stable")] for v in (values[:left], values[left:])])
    for tile in (8, 64, 2000):
        parent = list(range(len(values)))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in tile_links(values, left, 4, tile):
            assert find(a) != find(b)  # a forest
            parent[max(find(a), find(b))] = min(find(a), find(b))
        expected = list(range(len(values)))

        def root(i, expected=expected):
            while expected[i] != i:
                i = expected[i]
            return i

        for i in range(len(values)):
            for j in range(i):
                if (left is None or (i >= left) != (j >= left)) and bin(int(values[i] ^ values[j])).count("1") <= 4:
                    a, b = root(i), root(j)
                    expected[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(values))] == [root(i) for i in range(len(values))]


@pytest.mark.parametrize("options", [{}, {"unit": 16, "tile": 8}, {"n_blocks": 7}])
def test_links_lose_nothing(spark, options):
    rng = random.Random(4)
    values = near_values(rng, 6, 50, 4) + [0, 1, (1 << 64) - 1]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, **options)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    got = [roots.get(v, v) for v in signed]
    want = brute_components(values, 4)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_a_long_path_and_of_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (101, 102), (102, 101), (None, 5)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(102, 101)}
    assert components(edges.limit(0)).collect() == []


def test_edges_that_are_stars_cost_no_round(spark):
    kept = []

    def keep(df):
        kept.append(settled(df))
        return kept[-1]

    stars = spark.createDataFrame([(i, 0) for i in range(1, 40)] + [(51, 50), (52, 50), (50, 52)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(stars, keep=keep).collect()} == {(i, 0) for i in range(1, 40)} | {(51, 50), (52, 50)}
    assert len(kept) == 1
    path = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(path, keep=keep).collect()} == {(2, 1), (3, 1)}


WORDS = " ".join(f"word{i}" for i in range(200))
DOCS = [(7, WORDS), (3, WORDS.upper()), (9, WORDS.replace("word7 ", "other ")), (4, "short one"), (5, ""), (6, None), (8, "short one"), (8, "short one"),
        (None, "without id"), (None, "without id too")]


def test_simhash_groups_and_the_document_that_stays(docs_of):
    docs = docs_of(DOCS)
    rows = simhash_groups(docs).collect()
    values = sorted({plain_fingerprint(t) for _, t in DOCS})
    classes = dict(zip(values, brute_components(values, 4), strict=True))
    want = {}
    for i, t in DOCS:
        if i is not None:
            c = classes[plain_fingerprint(t)]
            want[c] = min(i, want.get(c, i))
    assert sorted((r["doc_id"] or -1, r["fp"] % (1 << 64), r["component_id"] or -1) for r in rows) == sorted(
        (i or -1, plain_fingerprint(t), want.get(classes[plain_fingerprint(t)], -1)) for i, t in DOCS)
    kept = first_of_each_group(docs)
    assert kept.columns == docs.columns
    # the two texts without ids are groups of their own
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted([*want.values(), -1, -1])
    assert simhash_groups(docs.limit(0)).collect() == []


def test_fuse_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 40_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        f = FuseFilter.build(np.concatenate([keys, keys[:1]]))
        assert f.may_hold(keys).all() and int(keys[0]) in f
        assert f.may_hold(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.02
        assert n < 1000 or len(f.marks) < 1.5 * n


@pytest.mark.parametrize("old", ["false", "true", "doc_id % 2 = 0", "cast(null as boolean)"])
def test_exact_duplicates_do_not_depend_on_the_snapshot(docs_of, old):
    rows = [(i, f"Text {i % 7}".swapcase() if i % 2 else f"Text {i % 7}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "É"), (103, "é"), (59, "Text 3"), (None, "text 1"), (None, "alone"), (None, "alone")]
    got = exact_duplicates(docs_of(rows), F.expr(old), bucket_size=5).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        key, = [k for k in groups if hashlib.sha256(k.encode()).digest() == bytes(r["digest"])]
        ids = [i for i in groups[key] if i is not None]
        assert r["group_size"] == len(groups[key]) and r["keep_id"] == (max(ids) if ids else None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_duplicates_of_nothing(docs_of):
    assert exact_duplicates(docs_of(DOCS).limit(0), F.lit(True)).collect() == []


def brute_lines(rows, min_docs, min_chars):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = {}
    for n, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(n)
    gone = {k for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    return [(i, len((t or "").split("\n")), sum(key(x) in gone for x in (t or "").split("\n")),
             "\n".join(x for x in (t or "").split("\n") if key(x) not in gone)) for i, t in rows]


@pytest.mark.parametrize("min_chars", [1, 5])
def test_shared_lines_go_everywhere(docs_of, min_chars):
    rng = random.Random(8)
    pool = ["Common", " common ", "É", "é", "", "\t", "x\x0b", "abcde", "ABCDE ", "rare"] + [f"only {k}" for k in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 150)))) for i in range(20)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (5, rows[5][1]), (5, "common"), (None, "common\nmine"), (None, "Common")]
    got = drop_shared_lines(docs_of(rows), min_docs=8, min_chars=min_chars, salts=3)
    assert sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == sorted(
        (i or -1, *rest) for i, *rest in brute_lines(rows, 8, min_chars))


def test_shared_lines_name_the_first_document(docs_of):
    rows = [(i, f"all\nline {i}") for i in range(3, 30)]
    got = shared_lines(docs_of(rows), min_docs=10).collect()
    assert [(r["n_docs"], r["first_id"]) for r in got] == [(27, 3)]
    assert drop_shared_lines(docs_of(rows).limit(0)).collect() == []
