"""Exact duplicates against an immutable snapshot, screened by static binary-fuse filters.

A snapshot's distinct digests are dealt into buckets; each bucket gets a binary-fuse filter over the first 64 digest bits,
built once in a task and never changed. The distinct digests of a new batch meet the filter of their bucket; only those that
pass join the snapshot's exact buckets, where all bytes of the digest and the text length are compared. Duplicates inside
the batch are grouped on their own, before the screening, so a text that fills a third of the batch is one digest there.
Texts never cross the cluster: a row is its id, SHA-256 and length.

Cases: a null text counts as empty; A-Z equal a-z, nothing else is folded; among equal texts the largest id stays, nulls
last, and of repeated rows with that id one; a group of null ids keeps one row with a null keep_id; an empty snapshot lets
nothing pass; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, shipped, texts_of

#: Digests that a bucket's filter is meant for.
BUCKET_SIZE = 50_000
_BUCKETS = "bucket long, seed long, segment long, segments long, marks binary"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (murmur style) of keys and seed."""
    h = keys + np.uint64(seed)
    for _ in range(2):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """A static 3-wise binary-fuse filter with 8-bit marks: no false negative, about 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, marks: np.ndarray):
        self.seed, self.segment, self.segments, self.marks = seed, segment, segments, marks

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Three slots per key, in three neighbouring segments, and its mark."""
        h = _mixed(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        inner = [h & np.uint64(0xFFFFF), (h >> np.uint64(18)) & np.uint64(0xFFFFF), _mixed(h, 1) >> np.uint64(40)]
        slots = np.stack([(first + np.uint64(k)) * np.uint64(segment) + (x & np.uint64(segment - 1)) for k, x in enumerate(inner)])
        return slots.astype(np.int64), (_mixed(h, 2) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel keys that are alone in a slot, round by round, then set marks backwards; a new seed where peeling stops."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        # sizes of the published construction
        segment = 1 << min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1_000_000) / np.log(n))
        segments = max(1, int(np.ceil(n * factor / segment)) - 2)
        for seed in range(1, 1000):
            slots, marks = cls._slots(keys, seed, segment, segments)
            size = segment * (segments + 2)
            order, alive = [], np.ones(len(keys), dtype=bool)
            counts = np.bincount(slots.ravel(), minlength=size)
            numbers = np.zeros(size, dtype=np.int64)
            for row in slots:
                np.bitwise_xor.at(numbers, row, np.arange(len(keys)))
            while True:
                alone = np.flatnonzero(counts == 1)
                if not len(alone):
                    break
                found, at = np.unique(numbers[alone], return_index=True)
                order.append((found, alone[at]))
                alive[found] = False
                for row in slots[:, found]:
                    np.subtract.at(counts, row, 1)
                    np.bitwise_xor.at(numbers, row, found)
            if not alive.any():
                table = np.zeros(size, dtype=np.uint8)
                for found, own in reversed(order):
                    three = slots[:, found]
                    others = np.bitwise_xor.reduce(np.where(three == own, 0, table[three]), axis=0)
                    table[own] = marks[found] ^ others
                return cls(seed, segment, segments, table)
        raise RuntimeError("no seed lets the filter be built")

    def __contains__(self, key: int) -> bool:
        return bool(self.may_hold(np.array([key], dtype=np.uint64))[0])

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        slots, marks = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return np.bitwise_xor.reduce(self.marks[slots], axis=0) == marks


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # lower() of bytes folds A-Z only
        digests, lengths = [], []
        for text in texts_of(batch.column(2)):
            data = (text or "").encode("utf-8", "surrogatepass").lower()
            digests.append(hashlib.sha256(data).digest())
            lengths.append(len(data))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(lengths, pa.int64())], names=["doc_id", "old", "digest", "n_bytes"])


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", old: object = None) -> DataFrame:
    """(``doc_id``, ``old``, ``digest``, ``n_bytes``) per row; ``old`` is a column that marks rows of the snapshot."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.lit(False) if old is None else old).alias("old"),
                       docs[text_col].cast("string").alias("text"))
    return shipped(rows).mapInArrow(_digested, "doc_id long, old boolean, digest binary, n_bytes long")


def _first_bits(digest: str):
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(rows["first_bits"].to_numpy().view(np.uint64))
    return pd.DataFrame({"bucket": [key[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "marks": [f.marks.tobytes()]})


def _screened(key: tuple, batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if batch.empty or filters.empty:
        return batch[:0]
    row = filters.iloc[0]
    f = FuseFilter(int(row["seed"]), int(row["segment"]), int(row["segments"]), np.frombuffer(row["marks"], dtype=np.uint8))
    return batch[f.may_hold(batch["first_bits"].to_numpy().view(np.uint64))]


def _classes(rows: DataFrame, n_buckets: int) -> DataFrame:
    """One row per distinct text, combined before the shuffle."""
    return rows.groupBy("digest", "n_bytes").agg(F.max("doc_id").alias("max_id"), F.count("*").alias("n")).withColumn(
        "first_bits", _first_bits("digest")).withColumn("bucket", F.pmod("first_bits", F.lit(n_buckets)))


def snapshot_filters(classes: DataFrame) -> DataFrame:
    """One immutable filter per bucket of a snapshot's distinct texts."""
    return classes.select("bucket", "first_bits").groupBy("bucket").applyInPandas(_built, _BUCKETS)


def screened(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """Distinct texts of a batch that the filters let pass."""
    schema = "digest binary, n_bytes long, max_id long, n long, first_bits long, bucket long"
    return batch.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_screened, schema)


def exact_duplicates(docs: DataFrame, old: object, id_col: str = "doc_id", text_col: str = "text",
                     bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """(``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``digest``) per row of ``docs``.

    ``old``: a true/false column, true for the rows of the snapshot; the others are the batch that is screened against it.
    """
    rows = settled(text_digests(docs, id_col, text_col, old))
    n_buckets = max(1, -(-rows.count() // bucket_size))
    snapshot = settled(_classes(rows.where("old"), n_buckets))
    batch = settled(_classes(rows.where("NOT coalesce(old, false)"), n_buckets))

    passed = screened(batch, snapshot_filters(snapshot))
    exact = ["bucket", "digest", "n_bytes"]
    both = settled(snapshot.alias("s").join(passed.alias("p"), exact).select(
        *exact, F.coalesce(F.greatest("s.max_id", "p.max_id"), "s.max_id", "p.max_id").alias("max_id"),
        (F.col("s.n") + F.col("p.n")).alias("n")))
    own = snapshot.unionByName(batch).select(*exact, "max_id", "n").join(both, exact, "left_anti")
    groups = own.unionByName(both).select("digest", "n_bytes", F.col("max_id").alias("keep_id"), F.col("n").alias("group_size"))

    joined = rows.join(groups, ["digest", "n_bytes"])
    # several rows may share the id that stays: one of them does
    candidates = Window.partitionBy("digest", "doc_id").orderBy(F.lit(0))
    return joined.withColumn("first", F.row_number().over(candidates) == 1).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first")).alias("kept"), "digest")
