import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmframe.llm import language as L
from swarmframe.llm import toxicity as X
from swarmframe.llm.common import held_out

SF = "/root/testdata/sf0.01"


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_is_crc32_of_the_id_as_text(spark):
    rows = spark.createDataFrame([(i,) for i in [None, 0, 7, -3, *range(100, 160)]], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert all(r["h"] == is_held_out(r["doc_id"]) for r in rows)


def test_language_of_held_out_documents(spark, documents):
    model = L.fit_language_model(documents)
    rows = L.predict_languages(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where(held_out()).collect()
    assert len(rows) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    odd = [(1, None), (2, ""), (3, "123 ... 4"), (4, "the of and " * 60_000), (5, "é"), (5, "é"), (None, "of the")]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in odd], "doc_id long, text string, score string, rejected int")
    got = L.predict_languages(docs, model).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and [r["score"] for r in got[:3]] == [0.0] * 3
    assert all(r["lang_pred"] in model.languages for r in got[3:]) and got[4] == got[5]
    kept = L.keep_known_languages(docs, model)
    assert kept.columns == docs.columns and 4 in [r["doc_id"] for r in kept.collect()]
    assert not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}
    assert L.predict_languages(docs.limit(0), model).collect() == []


def test_language_learns_nothing_from_held_out_rows(spark, documents):
    wrong = documents.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert L.fit_language_model(wrong).languages == L.fit_language_model(documents).languages
    none = documents.withColumn("lang", F.lit(None).cast("string")).limit(3)
    assert {r["lang_pred"] for r in L.predict_languages(none, L.fit_language_model(none)).collect()} == {"und"}


def test_texts_of_unknown_languages_go_and_mixtures_stay(spark, documents):
    rows = [r for r in documents.where("lang IS NOT NULL AND n_chars > 200").select("doc_id", "text", "lang").collect()]
    out = [r for r in rows if is_held_out(r["doc_id"])]
    languages = sorted({r["lang"] for r in rows})
    for left_out in [None, *languages]:
        fit = [r for r in rows if not is_held_out(r["doc_id"]) and r["lang"] != left_out]
        model = L.train([r["text"] for r in fit], [r["lang"] for r in fit])

        def rejected(texts, model=model):
            return np.mean([model.rejects(t, model.predict(t)[1]) for t in texts])

        known = [r for r in out if r["lang"] != left_out]
        mixed = [f"{a['text'][:2000]} {b['text'][:2000]}" for a in known[::9] for b in known[::7] if a["lang"] != b["lang"]]
        assert rejected([r["text"] for r in known]) < 0.01 and len(mixed) > 20 and rejected(mixed) < 0.01
        if left_out:
            assert rejected([r["text"] for r in out if r["lang"] == left_out]) > 0.7
        else:
            assert rejected(["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Все люди рождаются свободными и равными"]) == 1
            docs = spark.createDataFrame([(1, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan"), (2, mixed[0])], "doc_id long, text string")
            assert [r["doc_id"] for r in L.keep_known_languages(docs, model).collect()] == [2]
            assert [r["rejected"] for r in L.predict_languages(docs, model).orderBy("doc_id").collect()] == [True, False]


def test_long_texts_count_whole():
    model = L.train(["aaa bbb", "xyz zyx"] * 20, ["p", "q"] * 20)
    whole = model.logits("aaa " * 600_000)
    part = model.logits("aaa " * 1000)
    assert np.allclose(whole, part, atol=0.02)
    assert model.predict("xyz " * 10 + "aaa bbb " * 500_000)[0] == "p"


def test_word_hashes_see_words_only():
    assert len(X.word_hashes(b"")[0]) == len(X.word_hashes(b" .,\n")[0]) == len(X.features(None)) == 0
    a, _ = X.word_hashes(b"One two, ONE\ttwo-three")
    assert len(a) == 5 and a[0] == a[2] and a[1] == a[3] and len(set(a.tolist())) == 3
    assert X.word_hashes(b"x" * 10_000)[0][0] != X.word_hashes(b"x" * 10_001)[0][0]
    # words of one beginning share its hash, wherever they stand
    stems = X.word_hashes("a beginning, beginnon BEGINNS".encode())[1]
    assert [len(set(s.tolist())) for s in stems] == [1, 1, 1, 2] and [len(s) for s in stems] == [3, 3, 3, 2]


def test_toxicity_of_held_out_documents(spark):
    rng = np.random.default_rng(3)
    clean = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(1600):
        words = list(rng.choice(clean, 60))
        toxic = int(i % 8 == 0)
        if toxic:
            words[int(rng.integers(60))] = ["bad1", "bad2", "BAD3"][i % 3]
        rows.append((i, " ".join(words), "q"))
        labels.append((i, toxic, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(5, None, 1), (99_999, 1, 0)], "doc_id long, toxic int, quality int")
    model = X.fit_toxicity_model(docs, known)
    got = {r["doc_id"]: r["score"] for r in X.score_toxicity(docs, model).collect()}
    out = [i for i in range(1600) if is_held_out(i)]
    assert np.mean([(got[i] >= 0.3) == labels[i][1] for i in out]) > 0.98
    assert 0 < len(model.buckets) < 3000
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "bad1 " * 200_000), (4, "?"), (4, "?"), (None, "bad2")], "doc_id long, text string")
    scores = [r["score"] for r in X.score_toxicity(odd, model).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] == scores[3] == scores[4] < 0.3 < scores[2]
    assert X.score_toxicity(odd.limit(0), model).collect() == []
    assert {r["score"] < 0.01 for r in X.score_toxicity(odd, X.fit_toxicity_model(docs, known.limit(0))).collect()} == {True}


def test_rare_languages_are_sampled_and_hot_ids_are_bounded(spark):
    rows = [(i, f"text {i}", "aa") for i in range(4000)] + [(10_000 + i, f"rare {i}", "bb") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = L.training_sample(docs, "doc_id", "text", F.col("lang"), 200, least=50)
    n = {lang: sum(r["label"] == lang for r in picked) for lang in ("aa", "bb")}
    assert 120 < n["aa"] < 290 and n["bb"] > 30
    one_id = spark.createDataFrame([(None, f"text {i}", "aa") for i in range(4000)], "doc_id long, text string, lang string")
    for salt in ("", "x", "y", "z"):  # all or none of them are picked
        assert len(L.training_sample(one_id.withColumn("text", F.concat("text", F.lit(salt))), "doc_id", "text", F.col("lang"), 200)) <= 500


def test_hot_document_ids_do_not_fill_the_driver(spark):
    docs = spark.createDataFrame([(1, f"you fool number {i}") for i in range(3000)] + [(2, "fine"), (3, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    model = X.fit_toxicity_model(docs, labels, rows_per_class=50)
    assert 0 <= model.score("you fool") <= 1
