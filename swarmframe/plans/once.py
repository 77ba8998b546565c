"""Keep a wide computation in one place of the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmframe.session import scratch_path


def computed_once(df: DataFrame, kept: Sequence[str], computed: Sequence[Column | str]) -> DataFrame:
    """Select ``kept`` and ``computed`` so that later filters use the computed values.

    Catalyst pushes a filter through projections by writing out its columns in terms of the input. For values
    built over many steps that repeats the steps many times over. A filter is not pushed through a generator, so
    the computed columns pass through one that yields exactly one row; it takes part in whole-stage codegen.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*computed))))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` now, write it to the shared folder and return the written table.

    For small aggregates at the end of a long plan that several branches read: keys that are doubles keep Spark
    from recognising the branches as one, and the whole plan would run once for each.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
