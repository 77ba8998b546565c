import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from swarmframe.llm.mixing import mix_sources, repeat_rows, size_class, source_targets


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by dealing the excess again and again."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full, total = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in full]
        if not rest:
            return full
        each = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if each * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: each * weight[s] for s in rest}
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets_are_those_of_dealing_the_excess_again(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 100_000]) * rng.randint(0, 9) for i in range(rng.randint(1, 12))} | ({None: 50} if seed % 2 else {})
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert {r["source"]: pytest.approx(r["target"], abs=1e-6) for r in rows} == want


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string, n string, target double")


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = [(i, "w " * min(300, int(rng.paretovariate(1.1))), rng.choice(["a", "a", "a", "b", "é", None]), "x", None, None) for i in range(3000)]
    rows += [(5000, None, "a", "x", None, None), (5001, "", None, "x", None, None), (None, "p q", "b", "x", None, None)] + [rows[0]] * 3
    docs = documents(spark, rows)
    mixed = mix_sources(docs)
    assert mixed.columns[:6] == docs.columns
    got = mixed.collect()
    assert len(got) == len(rows)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r["mix_size_"] == size(r) and 0 <= r["mix_copies"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r)
        taken[r["source"]] = taken.get(r["source"], 0) + size(r) * r["mix_copies"]
        target[r["source"]] = r["mix_target"]
    for s, want in filled(sizes).items():
        assert target[s] == pytest.approx(want)
        assert abs(taken[s] - want) <= 300 + 0.01 * want
    again = mix_sources(docs.repartition(7)).select("doc_id", "source", "mix_copies")
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.select("doc_id", "source", "mix_copies").collect()))
    copies = repeat_rows(mixed, docs.columns)
    assert copies.columns == docs.columns and copies.count() == sum(r["mix_copies"] for r in got)


def test_mix_of_nothing_and_of_no_words(spark):
    assert mix_sources(documents(spark, [])).collect() == []
    rows = mix_sources(documents(spark, [(1, None, "a", None, None, None), (2, " ", None, None, None, None)])).collect()
    assert [(r["mix_target"], r["mix_copies"]) for r in rows] == [(0.0, 0)] * 2


def test_size_classes_are_the_same_in_sql(spark):
    sizes = [*range(0, 70), 127, 128, 255, 256, 1023, 1024, 1025, 2 ** 20, 2 ** 29, 2 ** 40 - 1]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(size_class(F.col("s"))).collect()]
    k = "(length(bin(s + 1)) - 1)"
    want = duckdb.sql(f"SELECT (4 * {k} + floor((s + 1) * 4 / 2.0::DOUBLE ** {k}) - 4)::INT FROM (SELECT unnest({sizes})::BIGINT AS s)").fetchall()
    assert got == [r[0] for r in want] and got == sorted(got)
