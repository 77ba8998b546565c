import pytest

import __spark_entry__
import corpus_pipeline
from check_oracle import compare, connect
from swarmframe.llm import queries

SF = "/root/testdata/sf0.001"


def test_entry_knows_all_operators():
    known = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in known} and "pipeline" in known


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_query_equals_its_sql(spark, name):
    query, sql = queries.QUERIES[name]
    ok, note = compare(spark, connect(SF), query, sql, SF)
    assert ok, note


def test_stages_take_effect(spark, docs_of, tmp_path):
    shared = "the same line everywhere"
    rows = [(i, f"{shared}\nthe text number {i} has its own words of the kind w{i}a w{i}b w{i}c w{i}d") for i in range(30)]
    long = " ".join(f"word{k} of the" for k in range(80))
    rows += [(100, long), (101, long + " "), (102, "123 456"), (103, None), (104, "")]
    docs = docs_of(rows)
    out = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = out.collect()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
    ids = {name: {r["doc_id"] for r in got} for name, got in seen.items()}
    assert ids["language"] == set(range(30)) | {100, 101}
    assert ids["line_dedup"] == ids["language"] and all(shared not in r["text"] for r in seen["line_dedup"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"])
    assert 100 in ids["simhash"] and 101 not in ids["simhash"]
    assert ids["mixing"] <= ids["simhash"] and len(seen["mixing"]) > len(ids["mixing"]) > 0
    assert ids["packing"] == ids["mixing"]


def test_one_of_many_copies_keeps_its_lines(spark, docs_of, tmp_path):
    text = "\n".join(f"line {k} of a text that was copied often" for k in [*range(70), 3, 3])
    near = [f"an edit that only number {i} has\n" + text.replace("line", "row").replace("often", "and edited") for i in range(12)]
    rows = [(i, "common line\n" + f"words of document {i} alone " * 4) for i in range(12)]
    rows += [(i, text) for i in [*range(120, 100, -1), None, 101]] + [(200 + i, t) for i, t in enumerate(near)]
    corpus_pipeline.without_shared_lines(spark, docs_of(rows, 4), SF).write.parquet(str(tmp_path / "lines"))
    out = spark.read.parquet(str(tmp_path / "lines"))
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[101] == [text] * 2 and all(got[i] == [""] for i in [None, *range(102, 121)])
    assert got[200] == [near[0]] and got[207] == ["an edit that only number 7 has"]
    assert all("common" not in t for i in range(12) for t in got[i])
    assert text in [r["text"] for r in corpus_pipeline.one_of_near_copies(spark, out, SF).collect()]


def test_run_over_no_rows(spark, docs_of, tmp_path):
    docs_of([(1, "x")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
