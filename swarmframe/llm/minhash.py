"""Near-duplicates by the Jaccard similarity of word-shingle sets: MinHash bands, Bayesian pruning, exact verification.

1. Each document becomes the size of its shingle set, a digest of the set and ``bands * rows`` minima. Equal sets are one class from
   here on, so copies cost nothing further.
2. Classes that agree in a band share a bucket. Buckets with the same members are kept once, and a pair belongs to the first band it
   agrees in. Only classes in buckets get a signature of ``checks`` further minima, of which a byte each is kept.
3. Candidates are compared in batches of 64 minima. With a uniform prior, after ``m`` agreements among ``n`` minima the similarity
   is at least ``t`` with the probability that a binomial variable of ``n + 1`` trials and chance ``t`` is at most ``m`` (``t`` raised by the
   chance that different minima share a byte); a pair goes as soon as that falls below ``miss``. Pairs whose sizes alone rule a link out
   go too, and pairs of small sets whose whole sets, as 32-bit hashes, do (merged hashes counted as shared). What is left is verified
   on the whole shingle sets, whatever signatures say.
4. First the components of a bucket meet its least class (a star), for one band, then three, then the rest; after each step
   verified links are contracted into components. Only buckets that still hold several components are searched further, and in
   these only pairs of different components; large buckets are dealt as pairs of tiles, without pairs inside the bucket's main
   component. A unit hands over, for each member, the ``share`` survivors with the most agreements. While a unit has more, it
   is searched again after contraction with a share 16 times as large, until it has handed over all survivors that still lie in
   different components. No pair of a bucket is left out, and no bucket is written out as pairs.

Two sets of similarity 0.8 miss all of 32 bands of 4 rows with probability 5e-8 (less for more similar ones); a pruned pair is one
that reaches the threshold with posterior probability below ``miss`` (1e-7). Everything that is found is exact.

Cases: a null text has no words; a text without words has an empty set, links with nothing and is its own component; fewer words
than a shingle are one shingle; A-Z equal a-z and nothing else is folded; repeated rows have equal sets; null ids never name a
component unless it has no other; repeated ids are rows like any others; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmframe.plans.once import stored

from .common import scratch_folder, shipped, texts_of
from .components import components

BATCH = 64
#: Sets of at most so many shingles travel whole, as 32-bit hashes, beside their signatures.
SMALL_SET = 256
#: Parts that a bucket of more members than a unit is joined in.
_PARTS = 64
_SEED = 7
_ROWS = "doc_id long, text_key long, n long, sum_a long, sum_b long, minima binary"


def shingle_set(text: str | None, words: int) -> set[bytes]:
    """The distinct shingles of a text; A-Z count as a-z."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if len(found) < words:
        return {b" ".join(found)} if found else set()
    return set(map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)))


class Hasher:
    """Signatures: the least of ``a * h + b`` modulo 2^32 over a set's hashes, for ``size`` pairs (a, b); the last bits of each are kept."""

    def __init__(self, size: int, kind: type = np.uint16, seed: int = _SEED):
        rng, self.kind = np.random.default_rng(seed), kind
        self.a = rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint32)

    def hashes(self, shingles: set[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(_SEED)), dtype=np.uint64, count=len(shingles))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        upper = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), np.iinfo(np.uint32).max, dtype=np.uint32)
        step = max(64, (1 << 18) // len(self.a))
        for at in range(0, len(upper), step):
            values = np.multiply.outer(self.a, upper[at:at + step])
            values += self.b[:, None]
            np.minimum(least, values.min(axis=1), out=least)
        return least.astype(self.kind)


_TEXTS = "cid long, text string, minima binary, signature binary, n long, hashes binary"


def _checked_texts(words: int, checks: int):
    """What candidates are compared by: a signature, the size of the set, and a small set's hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(checks, np.uint8, _SEED + 1)
        for batch in batches:
            signatures, n, small = [], [], []
            for text in texts_of(batch.column(1)):
                hashes = hasher.hashes(shingle_set(text, words))
                signatures.append(hasher.signature(hashes).tobytes())
                n.append(len(hashes))
                small.append((hashes >> np.uint64(32)).astype("<u4").tobytes() if len(hashes) <= SMALL_SET else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signatures, pa.binary()), pa.array(n, pa.int64()), pa.array(small, pa.binary())],
                                             names=["cid", "text", "minima", "signature", "n", "hashes"])

    return run


def possible(pairs: np.ndarray, n: np.ndarray, hashes: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of positions may link by the sizes of their sets and, of small sets, by their 32-bit hashes."""
    sizes = np.sort(n[pairs[:, :2]], axis=1)
    out = 100 * sizes[:, 0] >= percent * sizes[:, 1]
    sets: dict[int, frozenset] = {}

    def whole(k: int) -> frozenset:
        if k not in sets:
            sets[k] = frozenset(np.frombuffer(hashes[k], dtype="<u4").tolist())
        return sets[k]

    for at in np.flatnonzero(out).tolist():
        i, j = int(pairs[at, 0]), int(pairs[at, 1])
        if hashes[i] and hashes[j]:
            merged = min(int(n[i]) - len(whole(i)), int(n[j]) - len(whole(j)))
            shared = len(whole(i) & whole(j)) + merged
            out[at] = 100 * shared >= percent * (int(n[i]) + int(n[j]) - shared)
    return out


def _signed(value: np.uint64) -> int:
    return int(value) - (1 << 64) if int(value) >> 63 else int(value)


def _signatures(words: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, odd = Hasher(size), np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n, first, second, signatures = [], [], [], []
            for text in texts_of(batch.column(2)):
                hashes = hasher.hashes(shingle_set(text, words))
                n.append(len(hashes))
                # sums do not depend on the order of a set
                first.append(_signed(hashes.sum(dtype=np.uint64)))
                second.append(_signed(((hashes ^ (hashes >> np.uint64(29))) * odd).sum(dtype=np.uint64)))
                signatures.append(hasher.signature(hashes).astype("<u2").tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.array(signatures, pa.binary())], names=["doc_id", "text_key", "n", "sum_a", "sum_b", "minima"])

    return run


@lru_cache(maxsize=1024)
def least_matches(trials: int, threshold: float, miss: float) -> int:
    """The fewest agreements among ``trials`` minima that leave a posterior chance of ``miss`` for ``threshold`` or more."""
    chance = 0.0
    for m in range(trials + 1):
        chance += math.comb(trials + 1, m) * threshold ** m * (1 - threshold) ** (trials + 1 - m)
        if chance >= miss:
            return m
    return trials


def likely(signatures: np.ndarray, one: np.ndarray, other: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (one[i], other[i]) that batch after batch of minima leaves likely enough, and their agreements."""
    alive = np.arange(len(one))
    matches = np.zeros(len(one), dtype=np.int64)
    for at in range(0, signatures.shape[1], BATCH):
        end = min(at + BATCH, signatures.shape[1])
        part = signatures[:, at:end]
        matches[alive] += (part[one[alive]] == part[other[alive]]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(end, threshold, miss)]
        if not len(alive):
            break
    return alive, matches[alive]


def unit_survivors(signatures: np.ndarray, component: np.ndarray, left: int | None, threshold: float, miss: float,
                   block: int = 64) -> np.ndarray:
    """Pairs of positions of different components that pruning leaves, as rows (i, j, agreements).

    With ``left``, only pairs of one of the first ``left`` members and one of the rest.
    """
    n, out = len(signatures), [np.zeros((0, 3), dtype=np.int64)]
    for i in range(0, n if left is None else left, block):
        end = min(i + block, n if left is None else left)
        start = i if left is None else left
        apart = component[i:end, None] != component[None, start:]
        if left is None:
            apart &= np.arange(i, end)[:, None] < np.arange(start, n)[None, :]
        r, c = np.nonzero(apart)
        one, other = r + i, c + start
        found, matches = likely(signatures, one, other, threshold, miss)
        out.append(np.stack([one[found], other[found], matches], axis=1))
    return np.concatenate(out)


def closest(pairs: np.ndarray, share: int) -> np.ndarray:
    """Which rows (i, j, agreements) are among the ``share`` with the most agreements of either end; a larger share holds a smaller one."""
    n = len(pairs)
    ends = np.concatenate([pairs[:, 0], pairs[:, 1]])
    order = np.lexsort((np.concatenate([pairs[:, 1], pairs[:, 0]]), -np.tile(pairs[:, 2], 2), ends))
    begins = np.flatnonzero(np.append(True, ends[order][1:] != ends[order][:-1])) if n else np.array([], dtype=np.int64)
    place = np.arange(2 * n) - np.repeat(begins, np.diff(np.append(begins, 2 * n)))
    return np.unique(order[place < share] % max(n, 1))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)


def first_bands(minima: np.ndarray, one: np.ndarray, other: np.ndarray, bands: int) -> np.ndarray:
    """The first band in which each pair (one[i], other[i]) agrees."""
    wide = minima.reshape(len(minima), bands, -1)
    out = np.empty(len(one), dtype=np.int64)
    for at in range(0, len(one), 65_536):
        out[at:at + 65_536] = (wide[one[at:at + 65_536]] == wide[other[at:at + 65_536]]).all(axis=2).argmax(axis=1)
    return out


def _likely_pairs(threshold: float, miss: float):
    """Pairs (a, b) whose signatures survive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                n = part.num_rows
                both = np.concatenate([_matrix(part.column("sig_a")), _matrix(part.column("sig_b"))])
                found, _ = likely(both, np.arange(n), np.arange(n, 2 * n), threshold, miss)
                yield part.select(["a", "b"]).take(pa.array(found))

    return run


def _unit_pairs(threshold: float, miss: float, share: int, bands: int, percent: int):
    """What the units of a partition hand over; rows lie sorted by unit, side and class."""
    key = ["band", "low", "high"]

    def survivors(rows: pa.Table) -> pa.RecordBatch:
        sides = rows.column("side").to_numpy()
        two = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
        classes, component = rows.column("cid").to_numpy(), rows.column("component").to_numpy()
        pairs = unit_survivors(_matrix(rows.column("signature").combine_chunks()), component,
                               int((sides == 0).sum()) if two else None, threshold, miss)
        minima = _matrix(rows.column("minima").combine_chunks())
        pairs = pairs[first_bands(minima, pairs[:, 0], pairs[:, 1], bands) == rows.column("nr")[0].as_py()]
        pairs = pairs[possible(pairs, rows.column("n").to_numpy(), rows.column("hashes").to_pylist(), percent)]
        chosen = pairs[closest(pairs, share)]
        a, b, more = classes[chosen[:, 0]], classes[chosen[:, 1]], len(chosen) < len(pairs)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([more] * len(a), pa.bool_())],
                                          names=["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            ids = np.stack([table.column(k).to_numpy() for k in key], axis=1)
            cuts = (np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist()
            for begin, end in zip([0, *cuts[:-1]], cuts, strict=False):
                yield survivors(table.slice(begin, end - begin))
            rest = table.slice(cuts[-1]) if cuts else table
        if rest is not None and rest.num_rows:
            yield survivors(rest)

    return run


def _verified(words: int, percent: int):
    """Exact similarity of ``a`` (the row without ``b``, first of its group) with each ``b`` that follows it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, set()
        for batch in batches:
            a, salt, b = (batch.column(k).to_pylist() for k in ("a", "salt", "b"))
            out = []
            for one, s, other, text in zip(a, salt, b, texts_of(batch.column("text")), strict=True):
                found = shingle_set(text, words)
                if other is None:
                    group, own = (one, s), found
                    continue
                assert group == (one, s)
                shared = len(own & found)
                out.append((one, other, 100 * shared >= percent * (len(own) + len(found) - shared)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], names=["a", "b", "linked"])

    return run


def verify_pairs(pairs: DataFrame, texts: DataFrame, words: int, percent: int, per_group: int = 256) -> DataFrame:
    """(``a``, ``b``, ``linked``) for pairs of classes; a class with many partners is dealt in groups of about ``per_group``."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_group).alias("groups"))
    dealt = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).alias("salt"), "b")
    others = dealt.join(texts.withColumnRenamed("cid", "b"), "b").select("a", "salt", "b", "text")
    firsts = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("cid", "a"), "a").select(
        "a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = firsts.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return shipped(rows).mapInArrow(_verified(words, percent), "a long, b long, linked boolean")


def _parts(many: Column) -> Column:
    """The parts that a row of one bucket is joined under: all of them, if the bucket has many members."""
    return F.explode(F.when(many, F.sequence(F.lit(0), F.lit(_PARTS - 1))).otherwise(F.array(F.lit(0))))


def _part(many: Column, cid: str) -> Column:
    return F.when(many, F.pmod(F.xxhash64(cid), F.lit(_PARTS))).otherwise(0).cast("int").alias("part")


def _units(members: DataFrame, signatures: DataFrame, unit: int) -> DataFrame:
    """Members (``band``, ``nr``, ``many``, ``cid``, ``component``) of buckets with several components, dealt to units of bounded size."""
    per_component = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    buckets = per_component.groupBy("band").agg(
        F.sum("n").alias("all"), F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("main")
    ).where("components > 1").select(
        "band", (F.col("all") <= unit).alias("small"), F.col("main.component").alias("main"),
        F.ceil(F.col("main.n") * 2 / unit).cast("int").alias("mains"),
        F.ceil((F.col("all") - F.col("main.n")) * 2 / unit).cast("int").alias("others"), _parts(F.col("all") > unit).alias("part"))
    rows = members.withColumn("part", _part(F.col("many"), "cid")).join(buckets, ["band", "part"])
    is_main, pick = F.col("component") == F.col("main"), F.xxhash64("cid")
    tile = F.when(F.col("small"), 0).when(is_main, F.pmod(pick, F.col("mains"))).otherwise(
        F.col("mains") + F.pmod(pick, F.col("others"))).cast("int")
    # tiles of the main component meet those of the others; these meet all tiles, their own included
    first, last = F.when(is_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1
    partners = F.when(F.col("small"), F.array(F.lit(0))).otherwise(F.sequence(first, last))
    dealt = rows.select("band", "nr", "cid", "component", tile.alias("own"), F.explode(partners).alias("other"))
    dealt = dealt.select("band", "nr", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                         (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "component")
    return dealt.join(signatures, "cid").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "side", "cid").select(
        "band", "low", "high", "nr", "side", "cid", "component", "minima", "signature", "n", "hashes")


class _Rounds:
    """Tables of an iteration in the shared folder: the one before goes when the next has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def __call__(self, df: DataFrame) -> DataFrame:
        former, self.path = self.path, scratch_folder(self.spark, "minhash-round")
        df.write.parquet(self.path)
        if former is not None:
            jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(former)
            jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        return self.spark.read.schema(df.schema).parquet(self.path)


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "band", "nr", "many", "cid", F.coalesce("root", "cid").alias("component"))


def _stars(members: DataFrame) -> DataFrame:
    """(``a``, ``b``): in each bucket its least class and the least class of every other component."""
    least = members.groupBy("band", "many", "component").agg(F.min("cid").alias("b"))
    centre = least.groupBy("band", "many").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select(
        "band", "a", _parts(F.col("many")).alias("part"))
    return least.select("band", "b", _part(F.col("many"), "b")).join(centre, ["band", "part"]).where("a != b").select("a", "b").distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
                          bands: int = 32, rows: int = 4, checks: int = 1024, miss: float = 1e-7, unit: int = 2048, share: int = 4) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``, ``kept``) per row of ``docs``.

    Sets link when ``100 * intersection >= percent * union``; ``component_id`` is the least id that links reach, ``kept`` says whether
    it is the row's own. ``bands`` of ``rows`` minima make buckets, ``checks`` minima a signature; ``unit`` bounds the members that a task
    compares at once, ``share`` the partners that each of them hands over in the first round.
    """
    threshold = percent / 100 + (1 - percent / 100) / 256
    spark = docs.sparkSession
    ids, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    source = docs.select(ids.alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = shipped(source).mapInArrow(_signatures(words, bands * rows), _ROWS)
    rows_kept = _Rounds(spark)
    found = rows_kept(found.withColumn("row_id", F.monotonically_increasing_id()))

    same_set = ["n", "sum_a", "sum_b"]
    classes = found.where("n > 0").groupBy(*same_set).agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("row_id", "doc_id", "text_key", "minima")).alias("own"))
    classes = stored(classes.select(*same_set, "first_id", F.col("own.row_id").alias("cid"), F.col("own.doc_id").alias("own_id"),
                                    F.col("own.text_key").alias("own_key"), F.col("own.minima").alias("minima")), "minhash-classes")
    found = rows_kept(found.select("doc_id", *same_set))  # minima of copies are not needed any more
    # buckets of two or more classes, each set of members once; a bucket of many members is joined in parts
    keys = F.array(*[F.struct(F.xxhash64(F.substring("minima", 2 * rows * i + 1, 2 * rows), F.lit(i)).alias("band"), F.lit(i).alias("nr"))
                     for i in range(bands)])
    entries = classes.select("cid", F.inline(keys))
    buckets = entries.groupBy("band", "nr").agg(F.count("*").alias("size"), F.min("cid").alias("least"), F.bit_xor(F.xxhash64("cid")).alias("x"),
                                                F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y")).where("size > 1")
    buckets = stored(buckets.groupBy("size", "least", "x", "y").agg(F.min(F.struct("nr", "band")).alias("one")).select(
        "one.*", (F.col("size") > unit).alias("many")), "minhash-buckets")
    many = buckets.where("many").select("band", "nr", F.lit(True).alias("in_many"))
    dealt = entries.join(many, ["band", "nr"], "left").select("cid", "band", "nr", _part(F.coalesce("in_many", F.lit(False)), "cid"))
    members = dealt.join(buckets.select("band", "nr", "many", _parts(F.col("many")).alias("part")), ["band", "nr", "part"])
    members = stored(members.select("band", "nr", "many", "cid"), "minhash-members")

    wanted = members.select("cid").distinct().join(classes.select("cid", "own_id", "own_key", "minima"), "cid")
    texts = source.join(wanted, (F.col("text_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("cid", "text", "minima")
    texts = shipped(texts.groupBy("cid").agg(F.first("text").alias("text"), F.first("minima").alias("minima")))
    texts = stored(texts.mapInArrow(_checked_texts(words, checks), _TEXTS), "minhash-texts")
    signatures, texts = texts.drop("text"), texts.select("cid", "text")

    def contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
        """Classes and the least class of their component: ``roots``, which are stars already, with new links."""
        return components(roots.toDF("a", "b").unionByName(links.select("a", "b")), keep=_Rounds(spark))

    def verified(pairs: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``checked`` with new pairs, and the links that these hold. New pairs are written first, as verifying reads them several times."""
        new = stored(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "minhash-new")
        now = stored(verify_pairs(new, texts, words, percent), "minhash-checked")
        return checked.unionByName(now), now.where("linked")

    checked = spark.createDataFrame([], "a long, b long, linked boolean")
    roots = spark.createDataFrame([], "node long, root long")
    for first, last in ((0, 1), (1, 4), (4, bands)):  # few buckets first: what they join need not be compared in the others
        stars = _stars(_labelled(members.where(F.col("nr").between(first, last - 1)), roots))
        stars = stars.join(signatures.select(F.col("cid").alias("a"), F.col("signature").alias("sig_a")), "a").join(
            signatures.select(F.col("cid").alias("b"), F.col("signature").alias("sig_b")), "b")
        pairs = shipped(stars.select("a", "b", "sig_a", "sig_b")).mapInArrow(_likely_pairs(threshold, miss), "a long, b long")
        checked, links = verified(pairs, checked)
        if not links.isEmpty():
            roots = contracted(roots, links)

    while True:
        parts = shipped(_units(_labelled(members, roots), signatures, unit)).mapInArrow(
            _unit_pairs(threshold, miss, share, bands, percent), "a long, b long, more boolean")
        parts = stored(parts.groupBy("a", "b").agg(F.max("more").alias("more")), "minhash-pairs")
        checked, links = verified(parts.select("a", "b"), checked)
        if not links.isEmpty():
            roots = contracted(roots, links)
        if parts.where("more").isEmpty():
            break
        share *= 16

    # a component is named by the least id of its classes, which its root need not have
    of_roots = roots.toDF("cid", "root").unionByName(roots.select(F.col("root").alias("cid"), "root").distinct())
    names = of_roots.join(classes.select("cid", "first_id"), "cid").groupBy("root").agg(F.min("first_id").alias("root_id"))
    named = classes.join(of_roots.join(names, "root").select("cid", "root_id"), "cid", "left").select(
        *same_set, F.coalesce("root_id", "first_id").alias("component_id"))
    joined = found.select("doc_id", *same_set).join(named, same_set, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))
