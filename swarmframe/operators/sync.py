"""Alignment of many camera streams by frame number.

A poll at the end of every tick shows the highest frame seen so far. With ``first(f)`` the first tick at which
frame ``f`` arrives in a session, let ``newer(f)`` be the smallest ``first(g)`` over ``g > f``, and ``due(f)``
the smaller of ``first(f)`` and ``newer(f)``. Then an arrival of frame ``f`` in tick ``k`` is

* late        when ``due(f) < k``       (a poll before ``k`` has already shown ``f`` or a newer frame),
* displayed   when ``newer(f) > k``     (no newer frame had come by the end of ``k``),
* superseded  otherwise.

So the whole replay is one pre-aggregation by (session, frame), a suffix minimum over frames, cut into chunks, and one
join back. Nothing is replayed row by row. Rows without a session, time, frame or known drone are invalid: they are
outcomes, but never part of a set. Frame numbers have no bound unless ``max_frame`` gives one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmframe.functions.text import fixed, footer_text, frame_key, grid_cell
from swarmframe.plans.lookup import latest, micros
from swarmframe.plans.once import stored
from swarmframe.plans.scan import as_of, over_recent, running, with_previous

SESSION = ("session_id",)


def tick_of(ts: Column | str, tick: float, origin_us: int = 0) -> Column:
    """Number of the poll window ``[start, end)`` of ``tick`` seconds that a time falls in."""
    width = F.lit(int(round(tick * 1_000_000))).cast("bigint")
    since = micros(ts) - F.lit(origin_us).cast("bigint")
    return ((since - F.pmod(since, width)) / width).cast("bigint")


def is_valid(n_drones: int = 8, max_frame: int | None = None, keys: Sequence[str] = SESSION) -> Column:
    """Known session and time, drone id within 1..n_drones, frame number from 0 (to ``max_frame`` where that is given)."""
    ok = F.col("drone_id").between(1, n_drones) & (F.col("frame_num") >= 0) & F.col("arrival_ts").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    if max_frame is not None:
        ok = ok & F.col("frame_num").between(0, max_frame)
    return F.coalesce(ok, F.lit(False))


def frame_timeline(ticked: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Per (session, frame): first tick, ``newer`` and ``due`` as defined above. Input: valid rows with ``tick``."""
    keys = list(keys)
    firsts = ticked.groupBy(*keys, "frame_num").agg(F.min("tick").alias("first_tick"))
    line = running(firsts.withColumn("_down", -F.col("frame_num")), keys, "_down", {"first_tick": "newer"}, how="min",
                   exclusive=True, aggregated=True).drop("_down")
    return line.withColumn("due", F.least("first_tick", "newer"))


def _ticked(arrivals: DataFrame, tick: float, origin_us: int) -> DataFrame:
    return arrivals.withColumn("tick", tick_of("arrival_ts", tick, origin_us))


def sync_outcomes(arrivals: DataFrame, tick: float, n_drones: int = 8, keys: Sequence[str] = SESSION,
                  max_frame: int | None = None, origin_us: int = 0) -> DataFrame:
    """Every arrival with its ``tick`` and ``outcome``: displayed, superseded, late or invalid."""
    keys = list(keys)
    ticked = _ticked(arrivals, tick, origin_us).withColumn("_valid", is_valid(n_drones, max_frame, keys))
    line = frame_timeline(ticked.filter("_valid"), keys).select(*keys, "frame_num", "newer", "due")
    # line holds one row per (session, frame), so a hot frame is split on the arrivals' side only
    joined = ticked.join(line, [*keys, "frame_num"], "left")
    outcome = (F.when(~F.col("_valid"), "invalid")
               .when(F.col("due") < F.col("tick"), "late")
               .when(F.col("newer").isNull() | (F.col("newer") > F.col("tick")), "displayed")
               .otherwise("superseded"))
    return joined.select(*arrivals.columns, "tick", outcome.alias("outcome"))


def sync_sets(arrivals: DataFrame, tick: float, n_drones: int = 8, keys: Sequence[str] = SESSION,
              max_frame: int | None = None, origin_us: int = 0) -> DataFrame:
    """Every newly shown set: tick, frame number, members (last write per drone) and their count."""
    keys = list(keys)
    valid = _ticked(arrivals, tick, origin_us).filter(is_valid(n_drones, max_frame, keys))
    line = frame_timeline(valid, keys)
    shown = line.filter((F.col("due") == F.col("first_tick"))
                        & (F.col("newer").isNull() | (F.col("newer") > F.col("first_tick"))))
    # at most n_drones members per set; last writes are found before the shuffle
    members = (valid.groupBy(*keys, "frame_num", "tick", "drone_id")
               .agg(F.max(F.struct("arrival_ts", "packet_id")).alias("_last")))
    shown = shown.select(*keys, "frame_num", F.col("first_tick").alias("tick"))
    return (members.join(shown, [*keys, "frame_num", "tick"])
            .groupBy(*keys, "tick", "frame_num")
            .agg(F.sort_array(F.collect_list(F.struct(
                F.col("drone_id"), F.col("_last.packet_id").alias("packet_id"),
                F.col("_last.arrival_ts").alias("arrival_ts")))).alias("drones"))
            .withColumn("n_drones", F.size("drones")))


def sync_latest(arrivals: DataFrame, tick: float, n_drones: int = 8, keys: Sequence[str] = SESSION,
                max_frame: int | None = None, origin_us: int = 0) -> tuple[DataFrame, DataFrame]:
    """Replay of the buffer under a poll every ``tick`` seconds -> (outcomes, sets)."""
    args = (arrivals, tick, n_drones, keys, max_frame, origin_us)
    return sync_outcomes(*args), sync_sets(*args)


def poll_trace(arrivals: DataFrame, tick: float, n_drones: int = 8, keys: Sequence[str] = SESSION,
               max_frame: int | None = None, origin_us: int = 0) -> DataFrame:
    """What each poll returns: per session and tick with valid arrivals, the highest frame so far (repeats kept)."""
    keys = list(keys)
    peaks = (_ticked(arrivals, tick, origin_us).filter(is_valid(n_drones, max_frame, keys))
             .groupBy(*keys, "tick").agg(F.max("frame_num").alias("_peak")))
    return running(peaks, keys, "tick", {"_peak": "frame_num"}, how="max", aggregated=True) \
        .select(*keys, "tick", "frame_num")


def dedupe_displayed(polls: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Drop polls that return the same frame as the poll before."""
    seen = with_previous(polls, keys, ["tick"], {"frame_num": "_before"})
    return seen.filter(F.col("_before").isNull() | (F.col("_before") != F.col("frame_num"))).drop("_before")


def last_write_wins(arrivals: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """One row per (session, drone, frame): the latest arrival, ties by packet id."""
    return latest(arrivals, [*keys, "drone_id", "frame_num"], ["arrival_ts", "packet_id"])


def frame_completeness(arrivals: DataFrame, n_drones: int = 8, keys: Sequence[str] = SESSION) -> DataFrame:
    """Distinct drones per (session, frame) and whether the set is full."""
    return (arrivals.filter(F.col("drone_id").between(1, n_drones)).select(*keys, "frame_num", "drone_id").distinct()
            .groupBy(*keys, "frame_num").agg(F.count("*").alias("n_drones"))
            .withColumn("is_full", F.col("n_drones") == n_drones))


def sync_complete(arrivals: DataFrame, n_drones: int = 8, keys: Sequence[str] = SESSION) -> DataFrame:
    """Only frames that every drone has, each once, with the time at which the last missing drone arrived."""
    cells = (arrivals.filter(F.col("drone_id").between(1, n_drones)).groupBy(*keys, "frame_num", "drone_id")
             .agg(F.min("arrival_ts").alias("_first")))
    return (cells.groupBy(*keys, "frame_num")
            .agg(F.count("*").alias("n_drones"), F.max("_first").alias("completed_at"))
            .filter(F.col("n_drones") == n_drones))


def best_frame(arrivals: DataFrame, n_drones: int = 8, keys: Sequence[str] = SESSION) -> DataFrame:
    """Highest frame number present per session (no row for a session without valid arrivals)."""
    return (arrivals.filter(F.col("drone_id").between(1, n_drones)).groupBy(*keys)
            .agg(F.max("frame_num").alias("best_frame")))


def latest_per_drone(arrivals: DataFrame, as_of: Column | None = None, keys: Sequence[str] = SESSION) -> DataFrame:
    """Newest row of each drone, optionally as of a time."""
    rows = arrivals if as_of is None else arrivals.filter(F.col("arrival_ts") <= as_of)
    return latest(rows, [*keys, "drone_id"], ["arrival_ts", "packet_id"])


def latest_per_drone_at(arrivals: DataFrame, times: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Newest row of each drone at each of a table of times (keys, ``at``); a drone that has not come yet has no row.

    One pass in chunks answers all times, so a drone may hold all arrivals and there may be as many times as arrivals.
    """
    rows = arrivals.withColumn("_us", micros("arrival_ts"))
    drones = arrivals.select(*keys, "drone_id").distinct()
    # a row per time and drone of its session
    probes = times.select(*keys, micros("at").alias("_at")).distinct().join(drones, list(keys))
    found = as_of(probes, rows, [*keys, "drone_id"], "_at", "_us", ["packet_id"])
    return found.select(*keys, F.timestamp_micros("_at").alias("at"), *[c for c in arrivals.columns if c not in keys])


def _dense_drones(sessions: DataFrame, n_drones: int) -> DataFrame:
    return sessions.withColumn("drone_id", F.explode(F.sequence(F.lit(1), F.lit(n_drones))))


def buffer_stats(outcomes: DataFrame, sets: DataFrame, n_drones: int = 8,
                 keys: Sequence[str] = SESSION) -> DataFrame:
    """Counters at the end of a trace, dense over drones.

    ``frames_synchronized_reported`` counts every poll at which the current set is full (repeated polls
    count again); ``frames_synchronized`` counts each full set once.
    """
    keys = list(keys)
    per_drone = (outcomes.groupBy(*keys, "drone_id").agg(
        F.count_if(F.col("outcome").isin("displayed", "superseded")).alias("received"),
        F.count_if(F.col("outcome") == "late").alias("dropped"),
        F.max("tick").alias("_last_tick")))
    ends = per_drone.groupBy(*keys).agg(F.max("_last_tick").alias("_end"))
    shown = stored(sets.select(*keys, "tick", "frame_num", "n_drones", F.transform("drones", lambda d: d["drone_id"]).alias("_members"),
                               (-F.col("tick")).alias("_down")), "buffer-sets")
    # the row before in falling order is the next one
    spans = with_previous(shown, keys, ["_down"], {"tick": "_next"})
    full = F.col("n_drones") == n_drones
    overall = spans.join(ends, keys).groupBy(*keys).agg(
        F.sum(F.when(full, F.coalesce("_next", F.col("_end") + 1) - F.col("tick")).otherwise(0))
        .alias("frames_synchronized_reported"),
        F.count_if(full).alias("frames_synchronized"),
        (F.max("frame_num") + 1).alias("current_frame"),
        F.max_by("_members", "tick").alias("_in_buffer"),
        F.max("frame_num").alias("_shown"))
    dense = _dense_drones(ends.select(*keys), n_drones)
    zero = F.lit(0).cast("bigint")
    return (dense.join(per_drone.drop("_last_tick"), [*keys, "drone_id"], "left")
            .join(overall, keys, "left")
            .select(*keys, "drone_id",
                    F.coalesce("received", zero).alias("received"), F.coalesce("dropped", zero).alias("dropped"),
                    F.when(F.array_contains("_in_buffer", F.col("drone_id")), 1).otherwise(0).alias("buffer_size"),
                    F.coalesce("frames_synchronized_reported", zero).alias("frames_synchronized_reported"),
                    F.coalesce("frames_synchronized", zero).alias("frames_synchronized"),
                    F.coalesce("current_frame", zero).alias("current_frame"),
                    F.when(F.array_contains("_in_buffer", F.col("drone_id")), F.col("_shown")).alias("buffer_min"),
                    F.when(F.array_contains("_in_buffer", F.col("drone_id")), F.col("_shown")).alias("buffer_max")))


def status_line(received: Column, dropped: Column, size: Column, low: Column, high: Column) -> Column:
    frames = (F.when(low.isNull(), F.lit("empty")).when(low == high, low.cast("string"))
              .otherwise(F.concat_ws("-", low.cast("string"), high.cast("string"))))
    return F.format_string("rx=%4d, drop=%3d, buf=%2d [%s]", received, dropped, size, frames)


def buffer_status_text(outcomes: DataFrame, sets: DataFrame, n_drones: int = 8,
                       keys: Sequence[str] = SESSION) -> DataFrame:
    """One status line per drone at the end of a trace."""
    stats = buffer_stats(outcomes, sets, n_drones, keys)
    return stats.select(*keys, "drone_id", status_line(
        F.col("received"), F.col("dropped"), F.col("buffer_size"), F.col("buffer_min"), F.col("buffer_max"))
        .alias("status"))


def grid_manifest(sets: DataFrame, n_drones: int = 8, keys: Sequence[str] = SESSION) -> DataFrame:
    """Every set as dense grid cells. A set already carries its members, so this needs no join and no shuffle."""
    cells = sets.select(*keys, "tick", "frame_num", F.col("drones").alias("_drones"),
                        F.explode(F.sequence(F.lit(1), F.lit(n_drones))).alias("drone_id"))
    member = F.get(F.filter("_drones", lambda d: d["drone_id"] == F.col("drone_id")), F.lit(0))
    cells = cells.withColumn("_member", member)
    has = F.col("_member").isNotNull()
    place = grid_cell("drone_id")
    return cells.select(
        *keys, "tick", "frame_num", "drone_id", F.col("_member.packet_id").alias("packet_id"),
        place["row"].alias("grid_row"), place["col"].alias("grid_col"), place["y"].alias("pixel_y"),
        place["x"].alias("pixel_x"),
        F.when(has, F.concat(F.lit("Drone "), F.col("drone_id").cast("string"), F.lit(" | Frame "),
                             frame_key("frame_num"))).otherwise(F.lit("NO DATA")).alias("label"))


def rolling_fps(sets: DataFrame, tick: float, n: int = 30, keys: Sequence[str] = SESSION) -> DataFrame:
    """Instantaneous display rate of each new set and the mean over the last ``n`` rates; no task holds a whole session."""
    shown = stored(sets.select(*keys, "tick", "frame_num"), "fps-sets")
    gap = (F.col("tick") - F.col("_before")) * F.lit(float(tick))
    rates = (with_previous(shown, keys, ["tick"], {"tick": "_before"}).withColumn("_gap", gap)
             .withColumn("fps", F.when(F.col("_gap") > 0, F.lit(1.0) / F.col("_gap"))))
    # rows without a rate are dropped first: the mean covers the last n rates, not the last n rows
    rates = stored(rates.filter(F.col("fps").isNotNull()).select(*keys, "tick", "frame_num", "fps"), "fps-rates")
    return (over_recent(rates, keys, "tick", {"fps": "avg_fps"}, n)
            .withColumn("footer", footer_text("frame_num", "avg_fps"))
            .select(*keys, "tick", "frame_num", "fps", "avg_fps", "footer"))


__all__ = [
    "best_frame", "buffer_stats", "buffer_status_text", "dedupe_displayed", "fixed", "frame_completeness",
    "frame_timeline", "grid_manifest", "is_valid", "last_write_wins", "latest_per_drone", "latest_per_drone_at", "poll_trace",
    "rolling_fps", "status_line", "sync_complete", "sync_latest", "sync_outcomes", "sync_sets", "tick_of",
]
