"""Streaming queries: the events table is read as a stream, run to its end, and the sink is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from swarmframe.functions.packet import packet_info
from swarmframe.operators.packets import pack_packets
from swarmframe.queries.views import (ARRIVALS, HOUR, ORIGIN_US, PACKETS, REPLAY, arrivals_of, packets,
                                      table, ts)
from swarmframe.session import SETTINGS, scratch_path
from swarmframe.sources import stream_packets
from swarmframe.streaming import (stream_counts, stream_decode, stream_dedup, stream_dropped, stream_payloads, stream_sessions, stream_sets,
                                  stream_stats, stream_sync, stream_tick_max, write_sets)

BASE = ORIGIN_US // 3_600_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _closed(spark, sf, failed: bool = False) -> DataFrame:
    """Good arrivals and, in a session of its own, one long after them: it closes all windows and connections before it."""
    path = scratch_path(spark, "end")
    live = _arrivals(spark, sf, failed)
    last = spark.range(1).select(*[F.lit({"session_id": -1, "packet_id": -1, "drone_id": 1, "frame_num": 0, "failed": False}.get(f.name)).cast(f.dataType).alias(f.name)
                                   if f.name != "arrival_ts" else ts("2100-01-01 00:00:00").alias(f.name) for f in live.schema])
    last.write.parquet(path)
    return live.unionByName(spark.readStream.schema(live.schema).parquet(path))


def _arrivals(spark, sf, failed: bool = False) -> DataFrame:
    spark.conf.set(_PROVIDER, SETTINGS[_PROVIDER])
    schema = table(spark, sf, "events").schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf))
    rows = arrivals_of(events)
    return rows if failed else rows.filter(~F.col("failed"))


def _finished(query: StreamingQuery) -> None:
    query.awaitTermination()


def _drained(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _finished(write_sets(df, path, scratch_path(spark, f"{name}-checkpoint"), every=None))
    return spark.read.schema(df.schema).parquet(path)


def synced(spark, sf):
    sets = _drained(stream_sets(stream_sync(_closed(spark, sf), HOUR)), "sets")
    return sets.select("session_id", (F.col("tick") - BASE).alias("tick"), "frame_num",
                       F.col("n_drones").cast("bigint").alias("n_drones"), "drone_id", "packet_id")


def dropped(spark, sf):
    return stream_dropped(_drained(stream_sync(_closed(spark, sf), HOUR), "outcomes"))


def payloads(spark, sf):
    """Every arrival carries a whole packet; those of shown sets are delivered and read."""
    marker = F.lit(b"\xff\xd8"), F.lit(b"\xff\xd9")
    body = F.encode(F.repeat(F.lit("pixel"), (F.col("packet_id") % 9).cast("int")), "UTF-8")
    rows = _closed(spark, sf).select(
        "session_id", "packet_id", "arrival_ts", "drone_id", "frame_num", (F.unix_micros("arrival_ts") / 1_000_000).alias("ts"),
        F.concat(marker[0], body, marker[1]).alias("jpeg"), F.lit(b"\x00" * 24).alias("rvec"), F.lit(b"\x00" * 24).alias("tvec"),
        F.concat_ws(" ", F.lit("1000 0 960 0 1010 540 0 0"), F.col("packet_id").cast("string")).alias("k_text"), F.lit("0.5").alias("dist_text"))
    shown = _drained(stream_payloads(pack_packets(rows).drop("error_kind"), HOUR), "payloads")
    info = F.struct(packet_info("packet").alias("i"))["i"]
    return shown.select("session_id", (F.col("tick") - BASE).alias("tick"), "packet_id", F.col("n_drones").cast("bigint").alias("n_drones"),
                        info["drone_id"].alias("drone_id"), info["frame_num"].alias("frame_num"), info["jpeg_size"].alias("jpeg_size"),
                        F.length("packet").cast("bigint").alias("packet_size"))


def counts(spark, sf):
    """Running counters of packets, failures, accepted and late frames; the last update of each drone."""
    rows = _drained(stream_counts(_closed(spark, sf, failed=True), HOUR), "counts").filter("session_id >= 0")
    names = ("packets", "failed", "total_bytes", "accepted", "dropped")
    return rows.groupBy("session_id", "drone_id").agg(*[F.max_by(c, F.struct("as_of", "packets", "accepted", "dropped")).alias(c) for c in names])


def tick_max(spark, sf):
    peaks = _drained(stream_tick_max(_closed(spark, sf), HOUR), "peaks")
    return peaks.select("session_id", (F.col("tick") - BASE).alias("tick"), "frame_num")


def sessions(spark, sf):
    rows = _drained(stream_sessions(_closed(spark, sf), "4 hours", "0 seconds"), "sessions")
    return rows.select("session_id", "drone_id", F.col("connected_at").cast("timestamp_ntz").alias("connected_at"),
                       F.col("last_at").cast("timestamp_ntz").alias("last_at"), "packets")


def dedup(spark, sf):
    """Which packet of a cell is kept depends on the order of arrival within a batch, so only the cells are compared."""
    rows = _drained(stream_dedup(_arrivals(spark, sf), "40 days"), "dedup")
    return rows.select("session_id", "drone_id", "frame_num")


def totals(spark, sf):
    """Each update replaces the counters of the drones it names; the last one of each drone is the total."""
    path = scratch_path(spark, "stats")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    query = (stream_stats(_arrivals(spark, sf, failed=True)).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", scratch_path(spark, "stats-checkpoint")).trigger(availableNow=True).start())
    _finished(query)
    updates = spark.read.option("basePath", path).parquet(path)
    return updates.groupBy("drone_id").agg(*[F.max_by(c, "batch_id").alias(c)
                                             for c in ("received", "failed", "total_bytes")])


def decoded(spark, sf):
    """Packets written to a table, streamed back and decoded into good and bad rows."""
    source, good, bad = (scratch_path(spark, n) for n in ("packets", "good", "bad"))
    packed = pack_packets(packets(spark, sf)).filter(F.col("packet").isNotNull())
    broken = F.when(F.col("packet_id") % 6 == 0, F.substring("packet", 1, 70)).otherwise(F.col("packet"))
    packed.select("session_id", "packet_id", "port_drone_id", F.timestamp_seconds(F.lit(1_700_000_000)).alias("arrival_ts"),
                  broken.alias("packet")).write.parquet(source)
    _finished(stream_decode(stream_packets(spark, source, 100), good, bad, scratch_path(spark, "decode-checkpoint"),
                            every=None))
    rows = spark.read.option("recursiveFileLookup", "true").parquet(good).select(
        "packet_id", "drone_id", "frame_num", F.lit(None).cast("string").alias("error_kind"))
    errors = spark.read.option("recursiveFileLookup", "true").parquet(bad).select(
        "packet_id", F.lit(None).cast("int").alias("drone_id"), F.lit(None).cast("bigint").alias("frame_num"), "error_kind")
    return rows.unionByName(errors)


QUERIES = {
    "stream_sync": (synced, f"""WITH {REPLAY}
SELECT session_id, tick, frame_num, n_drones, drone_id, packet_id
FROM members JOIN sets USING (session_id, tick, frame_num)"""),
    "stream_dropped": (dropped, f"""WITH {REPLAY}
SELECT session_id, drone_id, count(*) FILTER (WHERE outcome <> 'late') AS received,
       count(*) FILTER (WHERE outcome = 'late') AS dropped FROM outcomes GROUP BY ALL"""),
    "stream_payloads": (payloads, f"""WITH {REPLAY}
SELECT session_id, tick, packet_id, n_drones, drone_id, frame_num, 4 + 5 * (packet_id % 9) AS jpeg_size,
       24 + 4 + 5 * (packet_id % 9) + 48 + 8 + 26 + length(CAST(packet_id AS VARCHAR)) + 3 AS packet_size
FROM members JOIN sets USING (session_id, tick, frame_num)"""),
    "stream_counts": (counts, f"""WITH {REPLAY},
judged AS (
  SELECT session_id, drone_id, count(*) FILTER (WHERE outcome <> 'late') AS accepted, count(*) FILTER (WHERE outcome = 'late') AS dropped
  FROM outcomes GROUP BY ALL),
seen AS (
  SELECT session_id, drone_id, count(*) AS packets, count(*) FILTER (WHERE failed) AS failed, CAST(sum(packet_bytes) AS BIGINT) AS total_bytes
  FROM arrivals GROUP BY ALL)
SELECT session_id, drone_id, packets, failed, total_bytes, coalesce(accepted, 0) AS accepted, coalesce(dropped, 0) AS dropped
FROM seen LEFT JOIN judged USING (session_id, drone_id)"""),
    "stream_tick_max": (tick_max, f"WITH {REPLAY} SELECT session_id, tick, peak AS frame_num FROM peaks"),
    "stream_sessions": (sessions, f"""WITH {ARRIVALS},
marked AS (
  SELECT *, coalesce(epoch_us(arrival_ts) - epoch_us(lag(arrival_ts) OVER w) >= 14400000000, TRUE) AS starts
  FROM good WINDOW w AS (PARTITION BY session_id, drone_id ORDER BY arrival_ts)),
numbered AS (
  SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY session_id, drone_id ORDER BY arrival_ts) AS n FROM marked),
runs AS (
  SELECT session_id, drone_id, n, min(arrival_ts) AS connected_at, max(arrival_ts) AS last_at, count(*) AS packets
  FROM numbered GROUP BY ALL)
SELECT session_id, drone_id, connected_at, last_at, packets FROM runs"""),
    "stream_dedup": (dedup, f"WITH {ARRIVALS} SELECT DISTINCT session_id, drone_id, frame_num FROM good"),
    "stream_stats": (totals, f"""WITH {ARRIVALS}
SELECT drone_id, count(*) AS received, count(*) FILTER (WHERE failed) AS failed,
       CAST(sum(packet_bytes) AS BIGINT) AS total_bytes FROM arrivals GROUP BY ALL"""),
    "stream_decode": (decoded, f"""WITH {PACKETS}
SELECT packet_id, CASE WHEN packet_id % 6 <> 0 THEN drone_id END AS drone_id,
       CASE WHEN packet_id % 6 <> 0 THEN frame END AS frame_num,
       CASE WHEN packet_id % 6 = 0 THEN 'too_small' END AS error_kind FROM packets"""),
}

