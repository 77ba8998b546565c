"""Throughput, progress, outage and gap reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmframe.operators.sync import SESSION
from swarmframe.plans.lookup import micros
from swarmframe.plans.scan import running, with_previous


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def sender_stats(log: DataFrame, keys: Sequence[str] = ("drone_id",)) -> DataFrame:
    """Per drone: sent, failed, bytes, success % and mean KB.

    ``log``: outcome in ``sent``, ``failed``, ``idle`` (no client: counted nowhere) and packet_bytes.
    """
    sent = F.col("outcome") == "sent"
    sums = log.groupBy(*keys).agg(
        F.count_if(sent).alias("sent"), F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(sent, F.col("packet_bytes"))), F.lit(0)).cast("bigint").alias("total_bytes"))
    return sums.select("*", _ratio(F.col("sent") * 100.0, F.col("sent") + F.col("failed")).alias("success_pct"),
                       _ratio(F.col("total_bytes") / 1024.0, F.col("sent")).alias("avg_kb"))


def receiver_stats(log: DataFrame, keys: Sequence[str] = ("drone_id",)) -> DataFrame:
    """Per drone: received, failed and the success rate as reported.

    Packets that cannot be unpacked count in both columns, so ``success_rate_reported`` is
    received / (received + failed); ``success_rate`` is the share of good packets.
    """
    sums = log.groupBy(*keys).agg(F.count("*").alias("received"), F.count_if("failed").alias("failed"))
    return sums.select("*", _ratio(F.col("received") * 100.0, F.col("received") + F.col("failed"))
                       .alias("success_rate_reported"),
                       _ratio((F.col("received") - F.col("failed")) * 100.0, F.col("received")).alias("success_rate"))


def drone_report(stats: DataFrame) -> DataFrame:
    """Per-drone statistics in order of drone id (one short row per drone)."""
    return stats.orderBy("drone_id")


def progress_sample(log: DataFrame, every: int = 100, idle_every: int = 10, connected: str | None = "connected",
                    side: str = "sender", keys: Sequence[str] = SESSION) -> DataFrame:
    """Rows that are worth a progress line.

    Sender: every ``every``-th frame with a client, every ``idle_every``-th without (``connected=None``: always
    with a client). Receiver: every ``every``-th frame, but not the frame that was reported last.
    """
    if side == "sender":
        step = F.lit(every) if connected is None else \
            F.when(F.col(connected), F.lit(every)).otherwise(F.lit(idle_every))
        return log.filter(F.pmod(F.col("frame_num"), step) == 0)
    candidates = log.filter(F.pmod(F.col("frame_num"), F.lit(every)) == 0)
    timed = candidates.withColumn("_us", micros("arrival_ts"))
    seen = with_previous(timed, [*keys, "drone_id"], ["_us", "packet_id"], {"frame_num": "_before"})
    return seen.filter(F.col("_before").isNull() | (F.col("_before") != F.col("frame_num"))).drop("_before", "_us")


def running_avg_kb(log: DataFrame, every: int = 100, keys: Sequence[str] = SESSION) -> DataFrame:
    """Mean KB of all packets sent up to each ``every``-th frame, per drone.

    A sender walks its frames in ascending order, so bytes are summed per frame before the running sum, which
    then has at most one row per frame number.
    """
    keys = [*keys, "drone_id"]
    frames = log.groupBy(*keys, "frame_num").agg(F.sum("packet_bytes").alias("_bytes"), F.count("*").alias("_n"))
    sums = running(frames, keys, "frame_num", {"_bytes": "total_bytes", "_n": "sent"}, aggregated=True)
    return (sums.filter(F.pmod(F.col("frame_num"), F.lit(every)) == 0)
            .select(*keys, "frame_num", "sent", (F.col("total_bytes") / F.col("sent") / 1024.0).alias("avg_kb")))


def connection_gaps(log: DataFrame, gap: float = 5.0, keys: Sequence[str] = SESSION) -> DataFrame:
    """Outages per drone: silences longer than ``gap`` seconds, and the number of the connection that follows.

    Two arrivals within one window of ``gap`` seconds are never an outage, so only the first and last time of
    each window are needed; they are aggregated before the shuffle.
    """
    keys = [*keys, "drone_id"]
    width = F.lit(int(round(gap * 1_000_000))).cast("bigint")
    at = log.select(*keys, micros("arrival_ts").alias("_us"))
    slots = (at.withColumn("_slot", ((F.col("_us") - F.pmod("_us", width)) / width).cast("bigint"))
             .groupBy(*keys, "_slot").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last")))
    pairs = with_previous(slots, keys, ["_slot"], {"_last": "_silent_from"}, aggregated=True)
    outages = pairs.filter(F.col("_first") - F.col("_silent_from") > width).withColumn("_one", F.lit(1))
    numbered = running(outages, keys, "_slot", {"_one": "_n"})
    return numbered.select(*keys, F.timestamp_micros("_silent_from").alias("silent_from"),
                           F.timestamp_micros("_first").alias("back_at"),
                           ((F.col("_first") - F.col("_silent_from")) / 1_000_000.0).alias("gap_seconds"),
                           (F.col("_n") + 1).cast("bigint").alias("connection_no"))


def frame_gaps(log: DataFrame, n_frames: int | None = None, keys: Sequence[str] = SESSION) -> DataFrame:
    """Runs of missing frame numbers per drone; with ``n_frames`` also before the first and after the last frame.

    Frames are made distinct first; the next frame comes from chunks of frames, so no task holds all of a drone's.
    """
    keys = [*keys, "drone_id"]
    frames = log.select(*keys, "frame_num").distinct()
    down = frames.where("frame_num IS NOT NULL").withColumn("_down", -F.col("frame_num"))
    pairs = with_previous(down, keys, ["_down"], {"frame_num": "_next"}, aggregated=True).drop("_down")
    if n_frames is not None:
        first = frames.groupBy(*keys).agg(F.min("frame_num").alias("_next")).withColumn("frame_num", F.lit(-1))
        pairs = pairs.withColumn("_next", F.coalesce("_next", F.lit(n_frames))).unionByName(first)
    return (pairs.filter(F.col("_next") - F.col("frame_num") > 1)
            .select(*keys, (F.col("frame_num") + 1).cast("bigint").alias("gap_from"),
                    (F.col("_next") - 1).cast("bigint").alias("gap_to"),
                    (F.col("_next") - F.col("frame_num") - 1).cast("bigint").alias("n_missing")))
