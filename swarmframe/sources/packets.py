"""Packet tables and packet streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swarmframe.schemas import PACKETS


def scan_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets at rest: session_id, packet_id, port_drone_id, arrival_ts, packet."""
    return spark.read.schema(PACKETS).parquet(path)


def scan_packet_files(spark: SparkSession, path: str, glob: str = "*.bin") -> DataFrame:
    """One packet per file: path, arrival_ts (modification time), packet."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    return files.selectExpr("path", "modificationTime AS arrival_ts", "content AS packet")


def stream_packets(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same packets as an unbounded stream of parquet files (any streaming table of this schema works too)."""
    return (spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))
