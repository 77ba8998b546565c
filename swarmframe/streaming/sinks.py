"""Streaming decode and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from swarmframe.operators.packets import decode_packets, decode_sections, drop_wrong_drone, validate_packets


def _trigger(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)


def decoded_stream(packets: DataFrame) -> DataFrame:
    """Good packets of the right drone, decoded; stateless, so it also works on a stream."""
    good, _ = decode_packets(packets)
    return drop_wrong_drone(good) if "port_drone_id" in good.columns else good


def stream_decode(packets: DataFrame, good_path: str, bad_path: str, checkpoint: str,
                  every: str | None = "500 milliseconds") -> StreamingQuery:
    """Decode a packet stream into one table and its bad packets into another.

    Each micro-batch replaces its own folder, so a repeated batch leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_packets(batch).persist()  # checked once for both tables
        try:
            good = decode_sections(checked.filter(F.col("error_kind").isNull())).drop("packet")
            good.write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
            bad = checked.filter(F.col("error_kind").isNotNull()).select(*batch.columns, "error_kind")
            bad.write.mode("overwrite").parquet(f"{bad_path}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    writer = packets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def write_sets(df: DataFrame, path: str, checkpoint: str, every: str | None = "500 milliseconds") -> StreamingQuery:
    """Append a stream of sets to parquet at the display pace of two per second (``every=None``: what is there now)."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path) \
        .option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()
