"""The corpus pipeline: from documents to packed training windows.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmframe.llm.common import scratch_folder
from swarmframe.llm.language import fit_language_model, keep_known_languages
from swarmframe.llm.line_dedup import drop_shared_lines
from swarmframe.llm.mixing import mix_sources, repeat_rows
from swarmframe.llm.packing import pack_documents
from swarmframe.llm.queries import QUERIES as OPERATOR_QUERIES
from swarmframe.llm.simhash import first_of_each_group

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language that the model knows, go."""
    docs = docs.select(*COLUMNS)
    return keep_known_languages(docs, fit_language_model(docs))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents or more hold go; of documents that consist of such lines the first keeps them. A null text stays null."""
    lines = drop_shared_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1, keep_copies=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return lines.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    return first_of_each_group(docs.select(*COLUMNS), words=4, radius=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return repeat_rows(mix_sources(docs.select(*COLUMNS)), COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 ids."""
    return pack_documents(docs, window=1024).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", known_languages),
    ("line_dedup", without_shared_lines),
    ("simhash", one_of_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {**OPERATOR_QUERIES, "pipeline": (run, ORACLE_SQL)}
