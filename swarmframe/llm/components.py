"""Connected components of an edge table by star contraction.

Each round hangs the neighbours of a node on the smallest one (first the larger neighbours, then the smaller ones), so
paths halve and the edges end as stars around the smallest node of each component. A round is a few joins and
aggregates over edges; nothing is collected but one number that tells whether all edges are such stars, so edges that
already are cost no round. The edges of each round go to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one smaller node, on which nothing but nodes hang: then that is its component's least."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    most = ends.groupBy("x").agg((F.sum("below") + F.max("above")).alias("n")).agg(F.max("n")).first()[0]
    return most is None or most <= 1


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (columns ``a``, ``b``); the root is the component's least node.

    Loops, repeated edges and edges with a null end are ignored; an empty table gives an empty result. Least nodes
    themselves are not listed. ``keep`` computes the edges of a round once and may drop those of the round before.
    """
    edges = keep(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
