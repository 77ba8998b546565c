"""Pairs of overlapping boxes, without forming all pairs of a crowded image.

Two boxes with IoU >= t have widths within a factor 1/t of each other and left edges at most
``(1 - t) * max(width)`` apart; the same holds for heights and top edges. A box is therefore filed under its size
class and grid cell, and the other side looks only into the classes and cells it can match, in images of any size.
A box searches several cells, so its row moves several times; only crowded groups are worth that. In the others, found by one
pre-aggregated count, boxes are joined by the group alone: both sides move once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmframe.functions.geometry import box_iou
from swarmframe.plans.once import stored

#: Groups of more boxes, both sides counted, are crowded. It only chooses the plan.
GROUP_LIMIT = 512
_BASE = 4.0
_SLACK = 1e-9
COORDS = ["x1", "y1", "x2", "y2"]
CELLS = ["_x_level", "_x_cell", "_y_level", "_y_cell"]


def _file(df: DataFrame, axis: str) -> DataFrame:
    """Add the size class and the cell of the box itself along one axis."""
    low, size = F.col(f"{axis}1"), F.col(f"{axis}2") - F.col(f"{axis}1")
    level = F.floor(F.log(size) / F.log(F.lit(_BASE)))
    return (df.withColumn(f"_{axis}_level", level)
            .withColumn(f"_{axis}_cell", F.floor(low / F.pow(F.lit(_BASE), F.col(f"_{axis}_level") + 1))))


def _search(df: DataFrame, axis: str, iou: float) -> DataFrame:
    """One row per size class and cell along one axis in which a partner can be filed."""
    low, size = F.col(f"{axis}1"), F.col(f"{axis}2") - F.col(f"{axis}1")
    log = F.log(F.lit(_BASE))
    first = F.floor(F.log(size * iou) / log - _SLACK)
    last = F.floor(F.log(size / iou) / log + _SLACK)
    levels = df.withColumn(f"_{axis}_level", F.explode(F.sequence(first, last)))
    cell = F.pow(F.lit(_BASE), F.col(f"_{axis}_level") + 1)
    reach = (1 - iou + _SLACK) * F.greatest(size, F.least(cell, size / iou))
    return levels.withColumn(f"_{axis}_cell", F.explode(F.sequence(
        F.floor((low - reach) / cell - _SLACK), F.floor((low + reach) / cell + _SLACK))))


def _named(df: DataFrame, side: str, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    extra = [c for c in CELLS if c in df.columns]
    return df.select(*keys, *extra, *[F.col(c).alias(f"_{side}_{c}") for c in [*COORDS, *carry]])


def _iou() -> Column:
    return box_iou(*[F.col(f"_a_{c}") for c in COORDS], *[F.col(f"_b_{c}") for c in COORDS])


def real(df: DataFrame) -> DataFrame:
    """Boxes that can overlap: with an area and finite coordinates. Others (null, NaN, infinite, empty) overlap nothing."""
    return df.filter(is_real())


def is_real() -> Column:
    ok = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    for c in COORDS:
        # NaN is greater than infinity
        ok = ok & (F.abs(c) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def filed(df: DataFrame) -> DataFrame:
    """Boxes with the size class and cell they are filed under."""
    return _file(_file(real(df), "x"), "y")


def searching(df: DataFrame, iou: float) -> DataFrame:
    """Boxes once per size class and cell in which a box with at least this IoU can be filed."""
    return _search(_search(real(df), "x", iou), "y", iou)


def overlapping(looking: DataFrame, found: DataFrame, keys: Sequence[str], a_carry: Sequence[str],
                b_carry: Sequence[str]) -> DataFrame:
    """Searching boxes against filed boxes, with their ``iou``."""
    joined = _named(looking, "a", keys, a_carry).join(_named(found, "b", keys, b_carry), [*keys, *CELLS])
    return joined.withColumn("iou", _iou()).drop(*CELLS)


def grid_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], iou: float, a_carry: Sequence[str],
               b_carry: Sequence[str]) -> DataFrame:
    """Pairs with at least this IoU, which must be above 0; ``a`` looks up the cells ``b`` is filed under."""
    return overlapping(searching(a, iou), filed(b), keys, a_carry, b_carry).filter(F.col("iou") >= iou)


def split_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], iou: float, a_carry: Sequence[str],
                b_carry: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The pairs of ``grid_pairs``: those of groups of at most ``GROUP_LIMIT`` boxes, and those of crowded ones (None without any).

    The first come out of one join by ``keys`` and lie together by them. Groups are counted when this is called.
    """
    a, b = (df.dropna(subset=list(keys)) for df in (a, b))
    sizes = a.select(*keys).unionByName(b.select(*keys)).groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = stored(sizes.filter(F.col("_n") > GROUP_LIMIT).select(*keys), "crowded-groups")
    none = hot.isEmpty()
    a, b = real(a), real(b)
    few = [df if none else df.join(hot, list(keys), "left_anti") for df in (a, b)]
    joined = _named(few[0], "a", keys, a_carry).join(_named(few[1], "b", keys, b_carry), list(keys))
    direct = joined.withColumn("iou", _iou()).filter(F.col("iou") >= iou)
    if none:
        return direct, None
    return direct, grid_pairs(*[df.join(hot, list(keys), "left_semi") for df in (a, b)], keys, iou, a_carry, b_carry)
