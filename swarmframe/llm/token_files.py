"""Token ids of documents as ORC files, and the way back.

Documents are range-partitioned by id and sorted within each partition, so the files, one after the other, hold them in
ascending id order. Each row keeps its ids as an integer array (run-length encoded by ORC) and the number of ids before
it in its file. Row indexes and a Bloom filter on the ids let a reader skip stripes and row groups; stripes are read in
parallel. The base of a file is the sum of the files before it: one number per file crosses the cluster.

Cases: a null or empty text is the end id alone; null ids come first; rows that share an id keep an order by text; an
empty table gives an empty result; other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shipped, texts_of
from .tokens import default_vocabulary, documents_ids

FILE_SCHEMA = "doc_id long, part long, start_in_part long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()),
                    ("ids", pa.list_(pa.int32()))])


def _encoded(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0

        def rows(doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal start
            n = np.array([len(b) // 4 for b in ids], dtype=np.int64)
            ends = np.cumsum(n)
            flat = np.frombuffer(b"".join(ids), dtype="<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype("<i4")), pa.array(flat))
            out = [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(n), part)), pa.array(start + ends - n), pa.array(n), lists]
            start += int(ends[-1])
            return pa.RecordBatch.from_arrays(out, schema=_ARROW)

        for batch in batches:
            doc_ids, some, own, size = batch.column(0).to_pylist(), [], [], 0
            for doc_id, ids in zip(doc_ids, documents_ids(texts_of(batch.column(1)), vocabulary), strict=True):
                own.append(doc_id)
                some.append(ids)
                size += len(ids)
                if size > 4_000_000:
                    yield rows(own, some)
                    some, own, size = [], [], 0
            if some:
                yield rows(own, some)

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str | None = None, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000) -> None:
    """Write the ids of all documents, the end id 0 behind each, below ``path`` in ascending id order."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    (shipped(rows).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_encoded(vocabulary or default_vocabulary()), FILE_SCHEMA)
     .write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(row_index_stride))
     .option("orc.stripe.size", str(stripe_bytes)).orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files: ``doc_id``, ``part``, ``start_in_part``, ``n_tokens``, ``ids``."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; statistics and Bloom filters skip the stripes that cannot hold them."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(doc_ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        # ids are below 2 ** 31: their bytes are those of unsigned numbers
        flat = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        ends = np.cumsum(n) * 4
        crc = [zlib.crc32(flat[e - 4 * k:e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        columns = [*batch.columns[:3], pa.array(n), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    files = read_token_files(spark, path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = shipped(files).select("doc_id", "part", "start_in_part", "ids").mapInArrow(
        _checksums, "doc_id long, part long, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
