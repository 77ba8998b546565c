"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmframe.session import shared_dir

#: Fixed: the white space of words and lines, and of nothing else.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after this package has been sent to the session's workers once, which may not have it installed."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_swarmframe_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(context._temp_dir, "swarmframe-code.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in sorted(os.walk(package)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(path)
        context._swarmframe_shipped = True
    return df


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; what lies there goes when the session's JVM ends.

    ``spark.checkpoint.dir`` is used where the session names it, the warehouse (which executors share too) otherwise.
    """
    base = shared_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs nothing of it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark) or scratch_folder(spark, "checkpoints"))
    return df.checkpoint()


def texts_of(column, rows: int = 256):
    """Values of an Arrow column as Python strings, a few rows at a time: a batch of long texts is not held twice."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(id_column: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each changed until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
