import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Small documents tables: rows of (doc_id, text) with more columns of clashing names."""
    def make(rows, n_partitions=2):
        schema = ("doc_id long, text string, lang string, source string, n_chars long, size long, fp string, kept string, n string, "
                  "hash string, score string, target string")
        full = [(i, t, "en", "s", 0, None, "x", "y", "z", "h", None, None) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(n_partitions)
    return make
