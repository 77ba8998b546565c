"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Weights turn into targets by filling: a share of all words is dealt by weight, no source above ``max_repeats`` times its
size, what is above is dealt again among the others. Each document of a source then expects ``target / source size``
copies. Documents of a source are laid out in a fixed order (size class, chunk, size, hash of the id), their expected
copies are added up, one offset per source is added, and a document is taken once for each whole number that its sum
crosses. As the order goes by size, the words taken come near the target.

Chunks keep any source small in a task: the place of a document is its place in its chunk plus the counts of the chunks
before it, which are one row per (source, size class, chunk). Offsets and order come from md5, so reruns agree.

Cases: a null text has size 0; a null source is a source, the last one; a source without words, or an empty table, has
target 0 and nothing is taken from it; repeated rows are sampled each; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh

WEIGHTS = (5.0, 2.0, 1.0)


def hash_fraction(text: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def size_class(size: Column) -> Column:
    """Four classes to each doubling of the size, by exact arithmetic."""
    octave = F.length(F.bin(size + 1)) - 1
    return (4 * octave + F.floor((size + 1) * 4 / F.pow(F.lit(2.0), octave)) - 4).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
                   max_repeats: float = 2.0) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    Weights repeat over the sources in code-point order, null last. A source is full when the level that the rest of the
    words would reach, taken over all sources that fill later, is not below its own cap.
    """
    if share > max_repeats:
        raise ValueError("the share cannot exceed what repeats allow")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", max_repeats * F.col("source_size"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full_before = F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing))
    total = share * F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("level", (total - full_before) / weight_left)
    rows = rows.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    # the level of the first source that does not fill; those computed behind it are lower
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return rows.select("source", "source_size",
                       F.when(F.col("full") | level.isNull(), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_repeats: float = 2.0,
                chunks: int = 16) -> DataFrame:
    """All rows and columns of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    ``chunks`` divides every (source, size class); set it so that such a part of the largest source fits a task.
    """
    size, total, target, copies = fresh(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies")
    known, key, klass, chunk, order, place = fresh(docs, "mix_known", "mix_key", "mix_class", "mix_chunk", "mix_order", "mix_place")
    source = F.col(source_col).cast("string")
    identity = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.withColumns({
        size: F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long"),
        # a null source is a key of its own, so that plain equality joins and splits it
        known: source.isNotNull(), key: F.coalesce(source, F.lit("")), order: identity})
    rows = rows.withColumns({
        klass: size_class(F.col(size)),
        chunk: (F.conv(F.substring(order, 1, 6), 16, 10).cast("long") % chunks).cast("int")})

    parts = rows.groupBy(F.col(known).alias("known"), F.col(key).alias("key"), F.col(klass).alias("class"), F.col(chunk).alias("chunk")).agg(
        F.count("*").alias("n"), F.sum(size).alias("words"))
    sources = parts.groupBy("known", "key").agg(F.sum("words").alias("source_size")).withColumn(
        "source", F.when(F.col("known"), F.col("key")))
    targets = source_targets(sources.select("source", "source_size"), weights, share, max_repeats).select(
        F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("key"), "source_size", "target")
    before = Window.partitionBy("known", "key").orderBy("class", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    places = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(targets, ["known", "key"])

    within = Window.partitionBy(known, key, klass, chunk).orderBy(size, order, F.col(id_col))
    rows = rows.withColumn(place, F.row_number().over(within).cast("long"))
    joined = rows.join(places, (rows[known] == places["known"]) & (rows[key] == places["key"])
                       & (rows[klass] == places["class"]) & (rows[chunk] == places["chunk"]))
    expected = F.when(places["source_size"] > 0, places["target"] / places["source_size"]).otherwise(F.lit(0.0))
    offset = hash_fraction(F.concat(F.lit("offset "), rows[key], rows[known].cast("string")))
    rank = places["before"] + rows[place]
    taken = (F.floor(expected * rank + offset) - F.floor(expected * (rank - 1) + offset)).cast("long")
    return joined.select(*[rows[c] for c in docs.columns], rows[size], places["source_size"].alias(total),
                         places["target"].alias(target), taken.alias(copies))


def repeat_rows(mixed: DataFrame, columns: Sequence[str], copies: str = "mix_copies") -> DataFrame:
    """Each row as often as it is taken."""
    number, = fresh(mixed, "mix_number")
    return mixed.where(F.col(copies) > 0).withColumn(
        number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*columns)
