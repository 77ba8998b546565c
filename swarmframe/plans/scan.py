"""Running values over long ordered groups, without one task per group.

A window partitioned by a session, a camera or a class puts that whole group into one task. These plans cut the rows
into chunks at quantiles of the order value, so chunks hold about as many rows each whatever the values are, run the
window inside each chunk, carry one value per chunk across chunks, and join the carried value back. No step holds a
whole group. Keys and order values may be null: a null key is a key, null orders come first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.plans.lookup import join_null_safe

CHUNKS = 256


def chunks_for(rows: int, per_chunk: int = 20_000) -> int:
    """How many chunks (up to ``CHUNKS``) a table of ``rows`` is worth: results are the same for any number."""
    return max(1, min(CHUNKS, -(-rows // per_chunk)))


def chunked(df: DataFrame, order: str, chunks: int = CHUNKS, aggregated: bool = False) -> DataFrame:
    """Add ``_chunk``: how many of about ``chunks`` approximate quantiles of ``order`` lie below the row's.

    Quantiles are looked up in two steps of ``side`` each, the square root of the number of chunks. With ``aggregated``
    (``df`` is the result of an aggregate) the quantiles read all its columns, so that Spark shuffles it once for all uses.
    """
    side = math.isqrt(max(chunks, 1) - 1) + 1
    shares = [i / side ** 2 for i in range(1, side ** 2)] or [1.0]
    value = F.col(order)
    if aggregated:
        value = F.when(F.xxhash64(*df.columns) != F.lit(0), value)
    bounds = df.select(F.percentile_approx(value, shares, 50 * side ** 2)).scalar()

    def below(at: Column) -> Column:
        return F.coalesce((F.get("_bounds", at) < F.col(order)).cast("int"), F.lit(0))

    coarse = reduce(add, [below(F.lit(side * i - 1)) for i in range(1, side)], F.lit(0))
    fine = reduce(add, [below(F.col("_coarse") * side + j) for j in range(side - 1)], F.lit(0))
    return (df.withColumn("_bounds", bounds).withColumn("_coarse", coarse)
            .withColumn("_chunk", F.col("_coarse") * side + fine).drop("_bounds", "_coarse"))


def running(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], how: str = "sum",
            exclusive: bool = False, chunks: int = CHUNKS, aggregated: bool = False) -> DataFrame:
    """Add running ``how`` (sum, max or min) of each ``values[column] -> name`` in ascending ``order``.

    ``order`` must be unique within ``keys``. With ``exclusive`` the row itself is left out, and the first row of a
    group gets null. ``aggregated``: see ``chunked``.
    """
    keys = list(keys)
    agg = getattr(F, how)
    rows = chunked(df, order, chunks, aggregated)
    totals = rows.groupBy(*keys, "_chunk").agg(*[agg(c).alias(f"_total_{n}") for c, n in values.items()])
    # at most ``chunks`` rows per key
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_chunk", *[agg(f"_total_{n}").over(before).alias(f"_carry_{n}")
                                               for n in values.values()])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    local = rows.select("*", *[agg(c).over(inside).alias(f"_local_{n}") for c, n in values.items()])
    joined = join_null_safe(local, carried, [*keys, "_chunk"])

    def combined(n: str) -> Column:
        here, earlier = F.col(f"_local_{n}"), F.col(f"_carry_{n}")
        if how != "sum":
            return (F.greatest if how == "max" else F.least)(earlier, here)
        return F.when(here.isNotNull() | earlier.isNotNull(),
                      F.coalesce(earlier, F.lit(0)) + F.coalesce(here, F.lit(0)))

    return joined.select(*df.columns, *[combined(n).alias(n) for n in values.values()])


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str],
                  chunks: int = CHUNKS, aggregated: bool = False) -> DataFrame:
    """Add the previous row's ``values[column] -> name`` in ascending ``order`` (``lag`` by one, cut into chunks)."""
    keys = list(keys)
    rows = chunked(df, order[0], chunks, aggregated)
    packed = F.struct(*order, *[F.col(c).alias(f"_v_{n}") for c, n in values.items()])
    tails = rows.groupBy(*keys, "_chunk").agg(F.max(packed).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = tails.select(*keys, "_chunk", F.lag("_tail").over(across).alias("_carry"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = rows.select("*", F.row_number().over(inside).alias("_place"),
                        *[F.lag(c).over(inside).alias(f"_local_{n}") for c, n in values.items()])
    joined = join_null_safe(local, carried, [*keys, "_chunk"])
    return joined.select(*df.columns, *[
        F.when(F.col("_place") == 1, F.col(f"_carry._v_{n}")).otherwise(F.col(f"_local_{n}")).alias(n)
        for n in values.values()])


def over_recent(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], n: int, how: str = "avg",
                chunks: int = CHUNKS, aggregated: bool = False) -> DataFrame:
    """Add ``how`` (any aggregate) of each ``values[column] -> name`` over the last ``n`` rows in ascending ``order``, the row included.

    The last ``n - 1`` rows of a chunk, or of as many chunks as it takes, are handed to the next one and leave it again.
    """
    keys = list(keys)
    agg = getattr(F, how)
    rows = chunked(df, order, chunks, aggregated)
    columns = [order, *values]
    back = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(order))
    ends = rows.select(*keys, "_chunk", *dict.fromkeys(columns), F.row_number().over(back).alias("_back")).filter(F.col("_back") < n)
    tails = ends.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"_h_{i}") for i, c in enumerate(columns)]))).alias("_tail"))
    # a chunk of a key has a row at least, so n - 1 chunks before hold n - 1 rows where there are as many
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-(n - 1), -1)
    halo = F.flatten(F.collect_list("_tail").over(before))
    handed = tails.select(*keys, "_chunk", halo.alias("_halo")).select(
        *keys, "_chunk", F.inline(F.when(F.size("_halo") >= n, F.slice("_halo", -(n - 1), n - 1)).otherwise(F.col("_halo"))))
    own = rows.select("*", F.lit(False).alias("_handed"))
    extra = handed.select(*keys, "_chunk", *[F.col(f"_h_{i}").alias(c) for i, c in enumerate(columns)], F.lit(True).alias("_handed"))
    recent = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(-(n - 1), 0)
    both = own.unionByName(extra, allowMissingColumns=True)
    return both.select(*df.columns, "_handed", *[agg(c).over(recent).alias(name) for c, name in values.items()]).filter(
        ~F.col("_handed")).drop("_handed")


def as_of(probes: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, time: str, rank: Sequence[str] = (),
          chunks: int = CHUNKS) -> DataFrame:
    """For every distinct (keys, ``at``) of ``probes``, the newest of ``rows`` with ``time`` not after it, by ``time``, then ``rank``.

    Times are numbers. Probes and rows are lined up by time, one line per (keys, time), and the newest row is carried along in
    chunks, so neither a key nor a time may hold too much. Columns: keys, ``at`` and those of ``rows``; probes before any row are left out.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in (*keys, time, *rank)]
    newest = rows.filter(F.col(time).isNotNull()).groupBy(*keys, F.col(time).alias("_at")).agg(F.max(F.struct(*rank, *rest)).alias("_row"))
    lines = newest.select(*keys, "_at", F.struct(F.col("_at").alias("_time"), "_row").alias("_row"), F.lit(False).alias("_asked"))
    nothing = F.lit(None).cast(lines.schema["_row"].dataType)
    asked = probes.filter(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), nothing.alias("_row"), F.lit(True).alias("_asked"))
    line = lines.unionByName(asked).groupBy(*keys, "_at").agg(F.max("_row").alias("_row"), F.max("_asked").alias("_asked"))
    carried = running(line, keys, "_at", {"_row": "_newest"}, how="max", chunks=chunks, aggregated=True)
    found = carried.filter(F.col("_asked") & F.col("_newest").isNotNull())
    return found.select(*keys, F.col("_at").alias(at), *[
        F.col("_newest._time").alias(c) if c == time else F.col(f"_newest._row.{c}").alias(c) for c in rows.columns if c not in keys])
