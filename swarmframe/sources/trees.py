"""Folders of small files (frames, calibration, labels) written from a table.

Every row is a file. A name is written whole and under its own name by whichever task has it, so a repeated task writes the same
file again. Folders are opened with ``pyarrow.fs``, as captures are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from swarmframe.sources.captures import file_system

# this code travels with its classes, so workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class TreeWriter(DataSourceWriter):
    """Rows (``name``, ``content``): the file ``name`` below the path, with these bytes; rows without either are left out."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = file_system(self.path)
        made = set()
        for row in iterator:
            if row.name is None or row.content is None:
                continue
            path = f"{root}/{row.name}"
            folder = path.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(path) as file:
                file.write(bytes(row.content))
        return WriterCommitMessage()


class TreeSource(DataSource):
    """Spark format ``file_tree``, for writing; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options)


def write_tree(df: DataFrame, path: str, name: Column, content: Column) -> None:
    """One file per row of ``df``: ``content`` (bytes, or text in UTF-8) under ``name`` below ``path``."""
    df.sparkSession.dataSource.register(TreeSource)
    df.select(name.cast("string").alias("name"), content.cast("binary").alias("content")).write.format("file_tree").mode("append").save(path)
