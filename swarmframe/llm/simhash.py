"""Near-duplicates by SimHash: 64-bit fingerprints of word shingles, linked at a few differing bits.

Documents become fingerprints in tasks, equal fingerprints one row. Two fingerprints that differ in at most ``radius``
bits agree in at least ``n - radius`` of any ``n`` blocks of bits, so all that can link meet under the key of some choice
of blocks; no pair is missed. Within a key, fingerprints are sorted by population count and cut into tiles; tiles are
compared exactly (exclusive or, bit count) unless their population counts differ by more than the radius. Keys with many
fingerprints are split: each pair of their tiles within the radius is a unit of its own, so no task holds a large key.
A unit returns a spanning forest of its links, never all pairs. Components are contracted over those forests.

Cases: a null text has no words; no words give fingerprint zero, which links like any other; fewer words than a shingle
are one shingle; repeated rows share a fingerprint; null ids never become a component id unless a component has no
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, settled, shipped, texts_of
from .components import components

SEED = 42


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; A-Z count as a-z."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    n = len(found) - words + 1
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in texts_of(batch.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values)], names=["doc_id", "text_key", "fp"])

    return run


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(``doc_id``, ``text_key``, ``fp``) per row; ``text_key`` is xxhash64 of the text as it stands."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"),
                       docs[text_col].cast("string").alias("text"))
    return shipped(rows).mapInArrow(_fingerprints(words), "doc_id long, text_key long, fp long")


class _Forest:
    """Union-find over positions; the least position of a set is its root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, begin: int, end: int) -> np.ndarray:
        out = self.parent[begin:end]
        while True:
            up = self.parent[out]
            if np.array_equal(up, out):
                break
            out = up
        self.parent[begin:end] = out
        return out

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)


def linked_pairs(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (row, column) that connect what a true/false matrix connects, at most one per row and column."""
    rows, columns = near.shape
    labels = np.arange(rows)
    while True:  # least label over neighbours, from rows to columns and back
        of_columns = np.where(near, labels[:, None], rows).min(axis=0)
        back = np.minimum(labels, np.where(near, of_columns[None, :], rows).min(axis=1))
        if np.array_equal(back, labels):
            break
        labels = back
    # columns of one label meet in any row of it: the row that carries the label
    for c in np.flatnonzero(of_columns < rows).tolist():
        yield int(of_columns[c]), c
    for r in np.flatnonzero(near.any(axis=1)).tolist():
        yield r, int(near[r].argmax())


def tile_links(values: np.ndarray, left: int | None, radius: int, tile: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``values`` (unsigned, by population count), as pairs of positions.

    With ``left``, the first ``left`` values are one side and the rest the other; both are sorted.
    """
    n, forest = len(values), _Forest(len(values))
    counts = np.bitwise_count(values).astype(int)
    sides = [range(0, n, tile)] * 2 if left is None else [range(0, left, tile), range(left, n, tile)]
    limit = [n, n] if left is None else [left, n]
    for i in sides[0]:
        i_end = min(i + tile, limit[0])
        for j in sides[1]:
            if left is None and j < i:
                continue
            j_end = min(j + tile, limit[1])
            if counts[j] - counts[i_end - 1] > radius:
                break
            if counts[i] - counts[j_end - 1] > radius:
                continue
            a, b = forest.roots(i, i_end), forest.roots(j, j_end)
            if a[0] == b[0] and (a == a[0]).all() and (b == b[0]).all():
                continue  # one component already
            near = np.bitwise_count(values[i:i_end, None] ^ values[None, j:j_end]) <= radius
            if i == j:
                np.fill_diagonal(near, False)
            if near.any():
                r, c = np.nonzero(near)
                pairs = zip(r.tolist(), c.tolist(), strict=True) if len(r) <= 2 * tile else linked_pairs(near)
                for x, y in pairs:
                    forest.join(i + x, j + y)
    roots = forest.roots(0, n)
    return [(k, int(roots[k])) for k in np.flatnonzero(roots != np.arange(n)).tolist()]


def _unit_links(radius: int, tile: int):
    """Links of the units that lie one after the other in a partition, sorted by unit, side and population count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("choice", "block", "low", "high", "side", "fp")
        rest = None

        def links(part: dict, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
            values, side = part["fp"][begin:end], part["side"][begin:end]
            two = part["low"][begin] != part["high"][begin]
            found = tile_links(values.view(np.uint64), int((side == 0).sum()) if two else None, radius, tile)
            at = np.array(found, dtype=np.int64).reshape(-1, 2)
            return values[at[:, 0]], values[at[:, 1]]

        def done(part: dict, last: bool) -> tuple[list, dict | None]:
            n = len(part["fp"])
            change = np.zeros(n, dtype=bool)
            for k in names[:4]:
                change[1:] |= part[k][1:] != part[k][:-1]
            ends = np.append(np.flatnonzero(change), n) if n else np.array([0])
            begins = np.append(0, ends[:-1])
            if not last:
                left_over = {k: v[begins[-1]:] for k, v in part.items()}
                begins, ends = begins[:-1], ends[:-1]
            several = ends - begins > 1
            out = [links(part, b, e) for b, e in zip(begins[several].tolist(), ends[several].tolist(), strict=True)]
            return out, None if last else left_over

        def record(out: list) -> pa.RecordBatch:
            a = np.concatenate([x for x, _ in out]) if out else np.array([], dtype=np.int64)
            b = np.concatenate([x for _, x in out]) if out else np.array([], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            part = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
            if rest is not None:
                part = {k: np.concatenate([rest[k], v]) for k, v in part.items()}
            out, rest = done(part, last=False)
            yield record(out)
        if rest is not None:
            yield record(done(rest, last=True)[0])

    return run


def near_links(fps: DataFrame, radius: int = 4, n_blocks: int | None = None, tile: int = 512,
               unit: int = 4096) -> DataFrame:
    """Edges (``a``, ``b``) that connect all distinct fingerprints ``fp`` at most ``radius`` bits apart.

    ``n_blocks`` blocks make choose(n_blocks, radius) keys per fingerprint; unless given, it is the least number for which a
    key is expected to have few fingerprints. Keys with over ``unit`` fingerprints are split into pairs of tiles.
    """
    if n_blocks is None:
        n = fps.count()
        n_blocks = next(k for k in range(radius + 1, 17) if n >> (64 * (k - radius) // k) < 2048 or k == 16)
    edges_of = [64 * k // n_blocks for k in range(n_blocks + 1)]
    whole = [sum(1 << bit for bit in range(edges_of[k], edges_of[k + 1])) for k in range(n_blocks)]
    masks = [sum(whole[k] for k in some) for some in combinations(range(n_blocks), n_blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("block"))
                     for i, m in enumerate(signed)])
    rows = fps.select("fp", F.bit_count("fp").cast("int").alias("ones"), F.explode(keys).alias("k")).select(
        "k.choice", "k.block", "fp", "ones")

    # keys with many fingerprints: how many tiles each population count needs (at most 65 entries a key)
    counts = rows.groupBy("choice", "block", "ones").agg(F.count("*").alias("n"))
    large = counts.groupBy("choice", "block").agg(
        F.sum("n").alias("all"),
        F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / unit).cast("int").alias("tiles")))).alias("tiles"),
    ).where(F.col("all") > unit).drop("all")
    rows = rows.join(large, ["choice", "block"], "left")
    own = F.col("ones") * (1 << 20) + F.pmod(F.xxhash64("fp"), F.element_at("tiles", F.col("ones")))
    present = F.filter(F.sequence(F.greatest(F.lit(0), F.col("ones") - radius), F.least(F.lit(64), F.col("ones") + radius)),
                       lambda p: F.map_contains_key(F.col("tiles"), p))
    others = F.flatten(F.transform(present, lambda p: F.transform(
        F.sequence(F.lit(0), F.element_at(F.col("tiles"), p) - 1), lambda t: (p * (1 << 20) + t).cast("long"))))
    rows = rows.select("choice", "block", "fp", "ones", F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(own).cast("long").alias("own"),
                       F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)).alias("other"))
    rows = rows.select("choice", "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                       (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "ones")
    sorted_rows = rows.repartition("choice", "block", "low", "high").sortWithinPartitions(
        "choice", "block", "low", "high", "side", "ones", "fp").drop("ones")
    return shipped(sorted_rows).mapInArrow(_unit_links(radius, tile), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4,
                   **tiling: int) -> DataFrame:
    """(``doc_id``, ``text_key``, ``fp``, ``root``, ``component_id``) per row of ``docs``.

    ``root`` names the component by its least (signed) fingerprint, ``component_id`` by its least document id.
    """
    rows = settled(document_fingerprints(docs, id_col, text_col, words))
    classes = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(classes.select("fp"), radius, **tiling)).withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(classes.select("fp", "root").join(groups, "root"), "fp").select(
        "doc_id", "text_key", "fp", "root", "component_id")


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: the least id (nulls last), then text hash."""
    groups = simhash_groups(docs, id_col, text_col, **options)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("f"))
    keep_id, keep_key = fresh(docs, "keep_id", "keep_key")
    keep = first.select(F.col("f.doc_id").alias(keep_id), F.col("f.text_key").alias(keep_key)).distinct()
    ids, key = docs[id_col].cast("long"), F.xxhash64(docs[text_col])
    kept = docs.join(keep, ids.eqNullSafe(keep[keep_id]) & (key == keep[keep_key]))
    return kept.dropDuplicates([keep_id, keep_key]).select(*docs.columns)
