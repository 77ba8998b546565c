"""Stream-alignment and reporting queries over the arrivals view."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmframe.operators import sessions, sliding, stats, sync
from swarmframe.queries.views import ARRIVALS, HOUR, ORIGIN_US, REPLAY, arrivals, good_arrivals, ts

ARGS = {"tick": HOUR, "origin_us": ORIGIN_US}


def _outcomes(spark, sf):
    return sync.sync_outcomes(good_arrivals(spark, sf), **ARGS)


def _sets(spark, sf):
    return sync.sync_sets(good_arrivals(spark, sf), **ARGS)


def outcomes(spark, sf):
    return _outcomes(spark, sf).select("session_id", "packet_id", "drone_id", "frame_num", "tick", "outcome")


def set_members(spark, sf):
    return _sets(spark, sf).select("session_id", "tick", "frame_num", "n_drones", F.explode("drones").alias("m")) \
        .select("session_id", "tick", "frame_num", "n_drones", F.col("m.drone_id").alias("drone_id"),
                F.col("m.packet_id").alias("packet_id"))


def sliding_outcomes(spark, sf):
    outcomes, _ = sliding.sync_sliding(good_arrivals(spark, sf), HOUR)
    return outcomes.select("session_id", "packet_id", "outcome", F.col("shown_at").cast("timestamp_ntz").alias("shown_at"))


def sliding_sets(spark, sf):
    _, sets = sliding.sync_sliding(good_arrivals(spark, sf), HOUR)
    return sets.select("session_id", F.col("shown_at").cast("timestamp_ntz").alias("shown_at"), "frame_num", "n_drones",
                       F.explode("drones").alias("m")).select(
        "session_id", "shown_at", "frame_num", "n_drones", F.col("m.drone_id").alias("drone_id"), F.col("m.packet_id").alias("packet_id"))


def recovered(spark, sf):
    """Frame numbers that begin again every hundred hours, without a session id."""
    rows = good_arrivals(spark, sf).withColumn("frame_num", F.col("frame_num") % 100).drop("session_id")
    return sessions.recover_sessions(rows).select("packet_id", "drone_id", "frame_num", "session_no")


def _six_hours(spark, sf):
    """Every six hours that a session has."""
    at = F.timestamp_micros(F.unix_micros("arrival_ts") - F.pmod(F.unix_micros("arrival_ts"), F.lit(21_600_000_000)))
    return arrivals(spark, sf).select("session_id", at.alias("at")).distinct()


def newest_at(spark, sf):
    rows = sync.latest_per_drone_at(good_arrivals(spark, sf), _six_hours(spark, sf))
    return rows.select("session_id", F.col("at").cast("timestamp_ntz").alias("at"), "drone_id", "frame_num", "packet_id")


def complete(spark, sf):
    return sync.sync_complete(good_arrivals(spark, sf)).select(
        "session_id", "frame_num", "n_drones", F.col("completed_at").cast("timestamp_ntz").alias("completed_at"))


def last_write(spark, sf):
    return sync.last_write_wins(good_arrivals(spark, sf)).select("session_id", "drone_id", "frame_num", "packet_id")


def deduped(spark, sf):
    return sync.dedupe_displayed(sync.poll_trace(good_arrivals(spark, sf), **ARGS))


def buffer_stats(spark, sf):
    return sync.buffer_stats(_outcomes(spark, sf), _sets(spark, sf))


def buffer_text(spark, sf):
    return sync.buffer_status_text(_outcomes(spark, sf), _sets(spark, sf))


def fps(spark, sf):
    return sync.rolling_fps(_sets(spark, sf), HOUR).select(
        "session_id", "tick", "frame_num", F.round(F.col("fps") * 3600, 6).alias("fps_per_hour"),
        F.round(F.col("avg_fps") * 3600, 6).alias("avg_fps_per_hour"), "footer")


def _sender_log(spark, sf):
    outcome = F.when(F.col("failed"), "failed").when(F.col("packet_id") % 5 == 0, "idle").otherwise("sent")
    return arrivals(spark, sf).withColumn("outcome", outcome).withColumn("connected", F.col("packet_id") % 5 != 0)


def sender(spark, sf):
    return stats.sender_stats(_sender_log(spark, sf)).select(
        "drone_id", "sent", "failed", "total_bytes", F.round("success_pct", 6).alias("success_pct"),
        F.round("avg_kb", 6).alias("avg_kb"))


def receiver(spark, sf):
    return stats.receiver_stats(arrivals(spark, sf)).select(
        "drone_id", "received", "failed", F.round("success_rate_reported", 6).alias("success_rate_reported"),
        F.round("success_rate", 6).alias("success_rate"))


def running_kb(spark, sf):
    return stats.running_avg_kb(good_arrivals(spark, sf), every=100).withColumn("avg_kb", F.round("avg_kb", 6))


def gaps(spark, sf):
    return stats.connection_gaps(arrivals(spark, sf), gap=4 * HOUR).select(
        "session_id", "drone_id", F.col("silent_from").cast("timestamp_ntz").alias("silent_from"),
        F.col("back_at").cast("timestamp_ntz").alias("back_at"), F.round("gap_seconds", 6).alias("gap_seconds"),
        "connection_no")


_BUFFER = REPLAY + """,
ends AS (SELECT session_id, max(tick) AS last_tick FROM outcomes GROUP BY ALL),
spans AS (
  SELECT s.*, coalesce(lead(tick) OVER (PARTITION BY session_id ORDER BY tick), last_tick + 1) - tick AS polls
  FROM sets s JOIN ends USING (session_id)),
overall AS (
  SELECT session_id, CAST(coalesce(sum(polls) FILTER (WHERE n_drones = 8), 0) AS BIGINT) AS reported,
         count(*) FILTER (WHERE n_drones = 8) AS clean, max(frame_num) + 1 AS current_frame,
         arg_max(drones, tick) AS in_buffer, max(frame_num) AS shown
  FROM spans GROUP BY ALL),
counts AS (
  SELECT session_id, drone_id, count(*) FILTER (WHERE outcome <> 'late') AS received,
         count(*) FILTER (WHERE outcome = 'late') AS dropped FROM outcomes GROUP BY ALL),
stats AS (
  SELECT o.session_id, d.drone_id, coalesce(received, 0) AS received, coalesce(dropped, 0) AS dropped,
         CASE WHEN list_contains(in_buffer, d.drone_id) THEN 1 ELSE 0 END AS buffer_size,
         reported AS frames_synchronized_reported, clean AS frames_synchronized, current_frame, shown
  FROM overall o, (SELECT unnest(range(1, 9)) AS drone_id) d
  LEFT JOIN counts c ON c.session_id = o.session_id AND c.drone_id = d.drone_id)"""

# The display step by step: each new set looks for the next one.
_SLIDING = ARRIVALS + """,
instants AS (
  SELECT session_id, arrival_ts AS seen_at, max(max(frame_num)) OVER (PARTITION BY session_id ORDER BY arrival_ts) AS peak
  FROM good GROUP BY session_id, arrival_ts),
walk AS (
  SELECT session_id, min(seen_at) AS seen_at, min(peak) AS frame_num FROM instants GROUP BY session_id
  UNION ALL
  SELECT w.session_id, min(i.seen_at), min(i.peak) FROM walk w JOIN instants i
    ON i.session_id = w.session_id AND i.seen_at >= w.seen_at + INTERVAL 1 HOUR AND i.peak > w.frame_num GROUP BY w.session_id),
shown AS (
  SELECT session_id, seen_at AS shown_at, frame_num, coalesce(lag(seen_at) OVER w, TIMESTAMP '1970-01-01') AS after_at,
         coalesce(lag(frame_num) OVER w, -1) AS last_frame
  FROM walk WINDOW w AS (PARTITION BY session_id ORDER BY seen_at)),
ends AS (SELECT session_id, max(shown_at) AS last_at, max(frame_num) AS last_frame FROM shown GROUP BY ALL),
judged AS (
  SELECT g.session_id, g.packet_id, g.drone_id, g.frame_num, g.arrival_ts,
         CASE WHEN g.frame_num <= coalesce(s.last_frame, e.last_frame) THEN 'late' WHEN s.shown_at IS NULL THEN 'waiting'
              WHEN g.frame_num = s.frame_num THEN 'displayed' ELSE 'superseded' END AS outcome, s.shown_at
  FROM good g LEFT JOIN shown s ON g.session_id = s.session_id AND g.arrival_ts > s.after_at AND g.arrival_ts <= s.shown_at
  JOIN ends e ON e.session_id = g.session_id)"""

_TIMES = ARRIVALS + """,
times AS (SELECT DISTINCT session_id, time_bucket(INTERVAL 6 HOUR, arrival_ts, TIMESTAMP '2024-01-01') AS at_time FROM arrivals),
rows AS (SELECT session_id, drone_id, arrival_ts, max(packet_id) AS packet_id, arg_max(frame_num, packet_id) AS frame_num FROM good GROUP BY ALL),
asked AS (SELECT DISTINCT t.session_id, t.at_time, g.drone_id FROM times t JOIN good g ON g.session_id = t.session_id),
newest AS (
  SELECT a.session_id, a.at_time, a.drone_id, r.frame_num, r.packet_id, r.arrival_ts
  FROM asked a ASOF JOIN rows r ON a.session_id = r.session_id AND a.drone_id = r.drone_id AND a.at_time >= r.arrival_ts)"""

QUERIES = {
    "recover_sessions": (recovered, f"""WITH RECURSIVE {ARRIVALS},
trace AS (
  SELECT packet_id, drone_id, frame_num % 100 AS frame_num, row_number() OVER (PARTITION BY drone_id ORDER BY arrival_ts, packet_id) AS i
  FROM good),
walk AS (
  SELECT packet_id, drone_id, frame_num, i, frame_num AS top, 1::BIGINT AS session_no FROM trace WHERE i = 1
  UNION ALL
  SELECT t.packet_id, t.drone_id, t.frame_num, t.i, CASE WHEN t.frame_num < w.top - 10 THEN t.frame_num ELSE greatest(w.top, t.frame_num) END,
         w.session_no + CAST(t.frame_num < w.top - 10 AS BIGINT)
  FROM walk w JOIN trace t ON t.drone_id = w.drone_id AND t.i = w.i + 1)
SELECT packet_id, drone_id, frame_num, session_no FROM walk"""),
    "latest_per_drone_at": (newest_at, f"""WITH {_TIMES}
SELECT session_id, at_time AS "at", drone_id, frame_num, packet_id FROM newest"""),
    "sync_sliding_outcomes": (sliding_outcomes, f"""WITH RECURSIVE {_SLIDING}
SELECT session_id, packet_id, outcome, CASE WHEN outcome = 'displayed' THEN shown_at END AS shown_at FROM judged"""),
    "sync_sliding_sets": (sliding_sets, f"""WITH RECURSIVE {_SLIDING},
members AS (
  SELECT session_id, shown_at, frame_num, drone_id, arg_max(packet_id, (arrival_ts, packet_id)) AS packet_id
  FROM judged WHERE outcome = 'displayed' GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY session_id, shown_at) AS n_drones FROM members"""),
    "sync_latest_outcomes": (outcomes, f"""WITH {REPLAY}
SELECT session_id, packet_id, drone_id, frame_num, tick, outcome FROM outcomes"""),
    "sync_latest_sets": (set_members, f"""WITH {REPLAY}
SELECT session_id, tick, frame_num, n_drones, drone_id, packet_id
FROM members JOIN sets USING (session_id, tick, frame_num)"""),
    "sync_complete": (complete, f"""WITH {ARRIVALS}
SELECT session_id, frame_num, count(*) AS n_drones, max(first_at) AS completed_at
FROM (SELECT session_id, frame_num, drone_id, min(arrival_ts) AS first_at FROM good GROUP BY ALL)
GROUP BY ALL HAVING count(*) = 8"""),
    "last_write_wins": (last_write, f"""WITH {ARRIVALS}
SELECT session_id, drone_id, frame_num, packet_id FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, drone_id, frame_num
                               ORDER BY arrival_ts DESC, packet_id DESC) AS rn FROM good) WHERE rn = 1"""),
    "dedupe_displayed": (deduped, f"""WITH {REPLAY}
SELECT session_id, tick, frame_num FROM (
  SELECT session_id, tick, shown AS frame_num, lag(shown) OVER (PARTITION BY session_id ORDER BY tick) AS prev
  FROM polls) WHERE prev IS DISTINCT FROM frame_num"""),
    "frame_completeness": (
        lambda s, d: sync.frame_completeness(good_arrivals(s, d)), f"""WITH {ARRIVALS}
SELECT session_id, frame_num, count(DISTINCT drone_id) AS n_drones, count(DISTINCT drone_id) = 8 AS is_full
FROM good GROUP BY ALL"""),
    "buffer_stats": (buffer_stats, f"""WITH {_BUFFER} SELECT * EXCLUDE (shown), CASE WHEN buffer_size = 1 THEN shown END AS buffer_min,
       CASE WHEN buffer_size = 1 THEN shown END AS buffer_max FROM stats"""),
    "buffer_status_text": (buffer_text, f"""WITH {_BUFFER}
SELECT session_id, drone_id, printf('rx=%4d, drop=%3d, buf=%2d [%s]', received, dropped, buffer_size,
       CASE WHEN buffer_size = 1 THEN CAST(shown AS VARCHAR) ELSE 'empty' END) AS status FROM stats"""),
    "grid_manifest": (lambda s, d: sync.grid_manifest(_sets(s, d)), f"""WITH {REPLAY}
SELECT s.session_id, s.tick, s.frame_num, d.drone_id, m.packet_id, (d.drone_id - 1) // 4 AS grid_row,
       (d.drone_id - 1) % 4 AS grid_col, (d.drone_id - 1) // 4 * 270 AS pixel_y, (d.drone_id - 1) % 4 * 480 AS pixel_x,
       CASE WHEN m.drone_id IS NULL THEN 'NO DATA'
            ELSE printf('Drone %d | Frame %04d', d.drone_id, s.frame_num) END AS label
FROM sets s CROSS JOIN (SELECT unnest(range(1, 9)) AS drone_id) d
LEFT JOIN members m ON m.session_id = s.session_id AND m.tick = s.tick AND m.drone_id = d.drone_id"""),
    "best_frame": (lambda s, d: sync.best_frame(good_arrivals(s, d)), f"""WITH {ARRIVALS}
SELECT session_id, max(frame_num) AS best_frame FROM good GROUP BY ALL"""),
    "latest_per_drone": (
        lambda s, d: sync.latest_per_drone(good_arrivals(s, d), ts("2024-01-20 12:00:00")).select(
            "session_id", "drone_id", "frame_num", "packet_id"), f"""WITH {ARRIVALS}
SELECT session_id, drone_id, arg_max(frame_num, (arrival_ts, packet_id)) AS frame_num,
       arg_max(packet_id, (arrival_ts, packet_id)) AS packet_id
FROM good WHERE arrival_ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL"""),
    "rolling_fps": (fps, f"""WITH {REPLAY},
rates AS (
  SELECT session_id, tick, frame_num, 1.0::DOUBLE / ((tick - lag(tick) OVER (PARTITION BY session_id ORDER BY tick)) * 3600.0::DOUBLE) AS fps
  FROM sets),
means AS (
  SELECT *, avg(fps) OVER (PARTITION BY session_id ORDER BY tick ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS a
  FROM rates WHERE fps IS NOT NULL)
SELECT session_id, tick, frame_num, round(fps * 3600, 6) AS fps_per_hour, round(a * 3600, 6) AS avg_fps_per_hour,
       printf('Synchronized Frame: %04d | Display FPS: %.1f', frame_num, a) AS footer FROM means"""),
    "sender_stats": (sender, f"""WITH {ARRIVALS},
logged AS (SELECT *, NOT failed AND packet_id % 5 <> 0 AS sent FROM arrivals)
SELECT drone_id, count(*) FILTER (WHERE sent) AS sent, count(*) FILTER (WHERE failed) AS failed,
       CAST(sum(packet_bytes) FILTER (WHERE sent) AS BIGINT) AS total_bytes,
       round(count(*) FILTER (WHERE sent) * 100.0::DOUBLE / count(*) FILTER (WHERE sent OR failed), 6) AS success_pct,
       round(sum(packet_bytes) FILTER (WHERE sent) / 1024.0::DOUBLE / count(*) FILTER (WHERE sent), 6) AS avg_kb
FROM logged GROUP BY ALL"""),
    "receiver_stats": (receiver, f"""WITH {ARRIVALS}
SELECT drone_id, count(*) AS received, count(*) FILTER (WHERE failed) AS failed,
       round(count(*) * 100.0::DOUBLE / (count(*) + count(*) FILTER (WHERE failed)), 6) AS success_rate_reported,
       round(count(*) FILTER (WHERE NOT failed) * 100.0::DOUBLE / count(*), 6) AS success_rate
FROM arrivals GROUP BY ALL"""),
    "drone_report": (
        lambda s, d: stats.drone_report(buffer_stats(s, d)).select("drone_id", "received", "dropped"), f"""WITH {_BUFFER}
SELECT drone_id, received, dropped FROM stats ORDER BY drone_id"""),
    "progress_sample": (
        lambda s, d: stats.progress_sample(_sender_log(s, d)).select("packet_id", "drone_id", "frame_num", "connected"),
        f"""WITH {ARRIVALS}
SELECT packet_id, drone_id, frame_num, packet_id % 5 <> 0 AS connected FROM arrivals
WHERE frame_num % (CASE WHEN packet_id % 5 <> 0 THEN 100 ELSE 10 END) = 0"""),
    "progress_sample_receiver": (
        lambda s, d: stats.progress_sample(good_arrivals(s, d), every=20, side="receiver")
        .select("packet_id", "drone_id", "frame_num"), f"""WITH {ARRIVALS}
SELECT packet_id, drone_id, frame_num FROM (
  SELECT *, lag(frame_num) OVER (PARTITION BY session_id, drone_id ORDER BY arrival_ts, packet_id) AS prev
  FROM good WHERE frame_num % 20 = 0) WHERE prev IS DISTINCT FROM frame_num"""),
    "running_avg_kb": (running_kb, f"""WITH {ARRIVALS},
frames AS (SELECT session_id, drone_id, frame_num, sum(packet_bytes) AS b, count(*) AS n FROM good GROUP BY ALL)
SELECT session_id, drone_id, frame_num, sent, round(avg_kb, 6) AS avg_kb FROM (
  SELECT session_id, drone_id, frame_num, CAST(sum(n) OVER w AS BIGINT) AS sent,
         CAST(sum(b) OVER w AS DOUBLE) / sum(n) OVER w / 1024.0::DOUBLE AS avg_kb
  FROM frames WINDOW w AS (PARTITION BY session_id, drone_id ORDER BY frame_num)) WHERE frame_num % 100 = 0"""),
    "connection_gaps": (gaps, f"""WITH {ARRIVALS},
pairs AS (
  SELECT session_id, drone_id, arrival_ts, lag(arrival_ts) OVER (
           PARTITION BY session_id, drone_id ORDER BY arrival_ts, packet_id) AS prev FROM arrivals)
SELECT session_id, drone_id, prev AS silent_from, arrival_ts AS back_at,
       round((epoch_us(arrival_ts) - epoch_us(prev)) / 1000000.0::DOUBLE, 6) AS gap_seconds,
       row_number() OVER (PARTITION BY session_id, drone_id ORDER BY arrival_ts) + 1 AS connection_no
FROM pairs WHERE epoch_us(arrival_ts) - epoch_us(prev) > 14400000000"""),
    "frame_gaps": (
        lambda s, d: stats.frame_gaps(good_arrivals(s, d), n_frames=720), f"""WITH {ARRIVALS},
frames AS (SELECT DISTINCT session_id, drone_id, frame_num FROM good
           UNION SELECT DISTINCT session_id, drone_id, -1 FROM good)
SELECT session_id, drone_id, frame_num + 1 AS gap_from, next - 1 AS gap_to, next - frame_num - 1 AS n_missing FROM (
  SELECT *, coalesce(lead(frame_num) OVER (PARTITION BY session_id, drone_id ORDER BY frame_num), 720) AS next
  FROM frames) WHERE next - frame_num > 1"""),
}
