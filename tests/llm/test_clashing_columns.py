"""Other columns, whatever they are called, change nothing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from swarmframe.llm import centroids, exact_dedup, language, line_dedup, minhash, mixing, neighbours, packing, page_text, prefix_trie, simhash, token_files, toxicity

NAMES = ["id", "label", "keep_id", "keep_key", "k", "h", "v", "x", "a", "b", "n", "fp", "root", "component_id", "text_key", "rank", "row_id", "cid",
         "band", "key", "cells", "digest", "hash", "salt", "pos", "line", "size", "place", "target", "mix_size", "known", "class", "start",
         "length", "ids", "sequence_id", "offset", "score", "lang_pred", "rejected", "cluster", "distance", "depth", "words", "block", "toxic_"]


def documents(spark):
    texts = ["the cat sat on the mat and slept all day long", "The cat sat on the mat and slept all day long", None, "", "one line\nanother line",
             "you are a stupid idiot and an ugly fool", "le chat est sur la table et dort toute la nuit", "word " * 400]
    rows = [(i, texts[i % len(texts)], ["en", "fr"][i % 7 == 6], ["s", "t", None][i % 3], 1) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def labels(spark):
    return spark.createDataFrame([(i, int(i % 8 == 5)) for i in range(40)], "doc_id long, toxic int")


def vectors(spark):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 9)]) for i in range(60)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def talks(spark):
    rows = [(i // 3, i % 3, "user", f"turn {i % 5 // 2}") for i in range(30)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<html><body><div>menu of all pages here today</div><p>Text number {i} of a page.</p></body></html>") for i in range(8)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def stored_tokens(spark, docs):
    from swarmframe.llm.common import scratch_folder

    path = scratch_folder(spark, "clash-tokens")
    token_files.write_token_files(docs, path)
    return token_files.token_index(spark, path)


OPERATORS = {
    "packing": (documents, lambda s, d: packing.pack_documents(d, window=64).select("doc_id", "start", "length", "doc_tokens")),
    "simhash": (documents, lambda s, d: simhash.simhash_groups(d).select("doc_id", "fp", "component_id")),
    "first_of_each_group": (documents, lambda s, d: simhash.first_of_each_group(d).select("doc_id", "text")),
    "exact": (documents, lambda s, d: exact_dedup.exact_duplicates(d, old=F.col("doc_id") % 2 == 0).select("doc_id", "keep_id", "group_size", "kept")),
    "mixing": (documents, lambda s, d: mixing.mix_sources(d).select("doc_id", "text")),
    "lines": (documents, lambda s, d: line_dedup.drop_shared_lines(d, min_docs=3, min_chars=1).select("doc_id", "kept_text")),
    "language": (documents, lambda s, d: language.predict_languages(d, language.fit_language_model(d)).select("doc_id", "lang_pred", "score")),
    "known languages": (documents, lambda s, d: language.keep_known_languages(d, language.fit_language_model(d)).select("doc_id", "text")),
    "tokens": (documents, lambda s, d: stored_tokens(s, d)),
    "toxicity": (documents, lambda s, d: toxicity.score_toxicity(d, toxicity.fit_toxicity_model(d, labels(s).withColumns(
        {"text": F.lit("other"), "label": F.lit(7), "id": F.lit("x"), "k": F.lit(1)}))).select("doc_id", "score")),
    "neighbours": (vectors, lambda s, d: neighbours.nearest(d, F.col("vec_id") % 20 == 0, k=3)),
    "pages": (pages, lambda s, d: page_text.main_texts(d).select("page_id", "text")),
    "centroids": (vectors, lambda s, d: centroids.cluster_report(d, k=4, rounds=2, dims=8)),
    "minhash": (documents, lambda s, d: minhash.near_duplicate_groups(d)),
    "trie": (talks, lambda s, d: prefix_trie.prefix_trie(d)),
    **{f"stage {name}": (documents, lambda s, d, stage=stage: stage(s, d, "")) for name, stage in corpus_pipeline.STAGES},
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_other_columns_change_nothing(spark, name):
    table, operator = OPERATORS[name]
    plain = table(spark)
    taken = {c.lower() for c in plain.columns}
    wide = plain.withColumns({c: F.lit(f"other {c}") for c in NAMES if c not in taken})

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    got, want = operator(spark, wide), operator(spark, plain)
    assert got.columns == want.columns
    if name in ("packing", "stage packing"):  # which window a piece lies in depends on how a table is split
        got, want = got.drop("sequence_id", "offset"), want.drop("sequence_id", "offset")
    assert rows(got) == rows(want)
