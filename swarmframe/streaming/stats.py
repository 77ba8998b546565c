"""Running counters and connection sessions over live streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_stats(packets: DataFrame) -> DataFrame:
    """Running received, failed and bytes per drone; write in ``update`` (or ``complete``) mode.

    ``packets``: drone_id, failed, packet_bytes. The state is one row per drone.
    """
    return packets.groupBy("drone_id").agg(
        F.count("*").alias("received"), F.count_if("failed").alias("failed"),
        F.coalesce(F.sum("packet_bytes"), F.lit(0)).alias("total_bytes"))


def stream_dropped(synced: DataFrame) -> DataFrame:
    """Accepted and dropped arrivals per drone from the output of ``stream_sync`` (a batch over its sink)."""
    late = F.col("kind") == "late"
    return synced.groupBy("session_id", "drone_id").agg(
        F.sum(F.when(late, 0).otherwise(F.col("n"))).alias("received"),
        F.sum(F.when(late, F.col("n")).otherwise(0)).alias("dropped"))


def stream_sessions(arrivals: DataFrame, gap: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Connections per drone: a silence of ``gap`` ends one. A connection is emitted once the watermark passes it."""
    return (arrivals.withWatermark("arrival_ts", delay)
            .groupBy("session_id", "drone_id", F.session_window("arrival_ts", gap))
            .agg(F.count("*").alias("packets"), F.max("arrival_ts").alias("last_at"))
            .select("session_id", "drone_id", F.col("session_window.start").alias("connected_at"), "last_at",
                    "packets"))
