"""Alignment of live streams.

Arrivals are aggregated per (session, poll window, frame, drone) into cells, and beside that to one row per poll window: its
highest frame and the drones that have it. Only these rows reach the stateful operator keyed by session, which keeps one number,
the last shown frame; cells are joined back to what it says about their window and judged in the JVM. The state of that join
goes with the watermark. Running counters take one row per (session, poll window, drone) and keep two maps per session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from swarmframe.operators.sync import is_valid, tick_of

OUTPUT = "session_id long, closed_at timestamp, before long, shown long, members long"
COUNTS = "session_id long, drone_id int, as_of timestamp, packets long, failed long, total_bytes long, accepted long, dropped long"


def _interval(seconds: float) -> str:
    return f"{int(round(seconds * 1_000_000))} microseconds"


def stream_dedup(arrivals: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Each (session, drone, frame) once within the watermark; the first one is kept (a batch keeps the last)."""
    return (arrivals.withWatermark("arrival_ts", delay)
            .dropDuplicatesWithinWatermark(["session_id", "drone_id", "frame_num"]))


def stream_tick_max(arrivals: DataFrame, tick: float, delay: str = "0 seconds", n_drones: int = 8,
                    max_frame: int | None = None) -> DataFrame:
    """Highest frame number of each closed poll window per session."""
    return (arrivals.filter(is_valid(n_drones, max_frame)).withWatermark("arrival_ts", delay)
            .groupBy("session_id", F.window("arrival_ts", _interval(tick)))
            .agg(F.max("frame_num").alias("frame_num"))
            .select("session_id", tick_of(F.col("window.start"), tick).alias("tick"), "frame_num"))


def _replay(session_ttl: float | None) -> StatefulProcessor:
    # a local class travels to the workers with its code, so they need not have this package installed
    ttl_ms = None if session_ttl is None else int(session_ttl * 1000)
    columns = [field.split()[0] for field in OUTPUT.split(", ")]

    class _Replay(StatefulProcessor):
        """Shows the highest new frame of each window; counts what is late or passed over."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._shown = handle.getValueState("shown", "frame_num long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # one row per closed window
            ticks = pd.concat(list(rows), ignore_index=True).sort_values("closed_at", ignore_index=True)
            known = self._shown.get() if self._shown.exists() else None
            shown = -1 if known is None else int(known[0])
            peaks = ticks["peak"].cummax().clip(lower=shown)
            ticks["before"] = peaks.shift(1, fill_value=shown)
            ticks["shown"] = peaks
            ticks["session_id"] = key[0]
            self._shown.update((int(peaks.iloc[-1]),))
            if ttl_ms is not None:
                for timer in list(self._handle.listTimers()):
                    self._handle.deleteTimer(timer)
                self._handle.registerTimer(int(ticks["closed_at"].max().timestamp() * 1000) + ttl_ms)
            yield ticks[columns]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self._shown.clear()
            return iter(())

        def close(self) -> None:
            pass

    return _Replay()


def _judged(arrivals: DataFrame, tick: float, delay: str, n_drones: int, max_frame: int | None, session_ttl: float | None) -> DataFrame:
    """Cells of closed poll windows with ``before`` and ``shown``, the frames shown before and at the end of their window."""
    valid = arrivals.filter(is_valid(n_drones, max_frame)).withWatermark("arrival_ts", delay)
    window = F.window("arrival_ts", _interval(tick))
    cells = (valid.groupBy("session_id", window, "frame_num", "drone_id")
             .agg(F.max(F.struct("arrival_ts", "packet_id")).alias("_last"), F.count("*").alias("n"))
             .select("session_id", F.window_time("window").alias("closed_at"), tick_of(F.col("window.start"), tick).alias("tick"), "frame_num",
                     F.col("drone_id").cast("int").alias("drone_id"), F.col("_last.packet_id").alias("packet_id"),
                     # a number, so that there is one event time
                     F.unix_micros("_last.arrival_ts").alias("us"), "n"))
    bit = F.expr("shiftleft(1L, CAST(drone_id AS INT) - 1)")
    frames = (valid.groupBy("session_id", window, "frame_num").agg(F.bit_or(bit).alias("members"))
              .select("session_id", F.window_time("window").alias("closed_at"), "frame_num", "members"))
    ticks = (frames.groupBy("session_id", F.window("closed_at", _interval(tick)))
             .agg(F.max(F.struct("frame_num", "members")).alias("top"))
             .select("session_id", F.window_time("window").alias("closed_at"), F.col("top.frame_num").alias("peak"), "top.members"))
    walked = ticks.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_replay(session_ttl), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="closed_at")
    said = walked.select(F.col("session_id").alias("_session"), F.col("closed_at").alias("_closed"), "before", "shown", "members")
    return cells.join(said, (F.col("session_id") == F.col("_session")) & (F.col("closed_at") == F.col("_closed"))).drop("_session", "_closed")


def stream_sync(arrivals: DataFrame, tick: float, delay: str = "0 seconds", n_drones: int = 8,
                max_frame: int | None = None, session_ttl: float | None = None) -> DataFrame:
    """Cells of closed poll windows with what became of them.

    One row per (session, tick, frame, drone): ``kind`` displayed, superseded or late, the last packet of the
    cell, and ``n``, the number of arrivals it stands for. Displayed rows of one tick are the members of a newly
    shown set; ``n_drones`` (at most 64) is their number (null for other rows). Lateness is by frame number; ``delay`` only says
    how long a window waits for packets. A window comes out when the watermark passes its end; a finite input needs a
    later row to close the last one. ``session_ttl`` seconds after its last window a session is forgotten.
    """
    rows = _judged(arrivals, tick, delay, n_drones, max_frame, session_ttl)
    late, now = F.col("frame_num") <= F.col("before"), F.col("frame_num") == F.col("shown")
    kind = F.when(late, "late").when(now, "displayed").otherwise("superseded")
    return rows.select("session_id", "tick", kind.alias("kind"), "frame_num",
                       F.when(~late & now, F.bit_count("members")).cast("int").alias("n_drones"), "drone_id", "packet_id",
                       F.timestamp_micros("us").alias("arrival_ts"), "n")


def _counters() -> StatefulProcessor:
    columns = [field.split()[0] for field in COUNTS.split(", ")]
    counted = columns[3:]

    class _Counters(StatefulProcessor):
        """Adds up what each closed window brings to the drones of a session."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._totals = handle.getMapState("totals", "drone_id int", ", ".join(f"{c} long" for c in counted))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # at most one row per closed window, drone and kind
            new = pd.concat(list(rows), ignore_index=True).groupby("drone_id").agg({"as_of": "max", **dict.fromkeys(counted, "sum")})
            out = []
            for drone, row in new.iterrows():
                known = self._totals.getValue((int(drone),)) if self._totals.containsKey((int(drone),)) else (0,) * len(counted)
                total = tuple(int(a) + int(b) for a, b in zip(known, row[counted], strict=True))
                self._totals.updateValue((int(drone),), total)
                out.append((key[0], int(drone), row["as_of"], *total))
            yield pd.DataFrame(out, columns=columns)

        def close(self) -> None:
            pass

    return _Counters()


def stream_counts(packets: DataFrame, tick: float, delay: str = "0 seconds", n_drones: int = 8, max_frame: int | None = None,
                  session_ttl: float | None = None) -> DataFrame:
    """Running counters per (session, drone), kept in state: each row replaces the one before it for its drone.

    ``packets``: arrivals with ``failed`` and ``packet_bytes``. ``packets``, ``failed`` and ``total_bytes`` count all packets of closed
    poll windows, ``accepted`` and ``dropped`` (late by frame number) the good ones; ``as_of`` is the end of the last window counted.
    """
    zero = F.lit(0).cast("bigint")
    seen = (packets.filter(F.col("session_id").isNotNull() & F.col("drone_id").isNotNull()).withWatermark("arrival_ts", delay)
            .groupBy("session_id", F.window("arrival_ts", _interval(tick)), "drone_id")
            .agg(F.count("*").alias("packets"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("packet_bytes"), zero).alias("total_bytes"))
            .select("session_id", F.col("drone_id").cast("int").alias("drone_id"), F.window_time("window").alias("as_of"), "packets", "failed",
                    "total_bytes", zero.alias("accepted"), zero.alias("dropped")))
    late = F.col("frame_num") <= F.col("before")
    judged = (_judged(packets.filter(~F.col("failed")), tick, delay, n_drones, max_frame, session_ttl)
              .groupBy("session_id", "drone_id", F.window("closed_at", _interval(tick)))
              .agg(F.sum(F.when(late, zero).otherwise(F.col("n"))).alias("accepted"), F.sum(F.when(late, F.col("n")).otherwise(zero)).alias("dropped"))
              .select("session_id", "drone_id", F.window_time("window").alias("as_of"), zero.alias("packets"), zero.alias("failed"),
                      zero.alias("total_bytes"), "accepted", "dropped"))
    return seen.unionByName(judged).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_counters(), outputStructType=COUNTS, outputMode="Append", timeMode="None")


def stream_sets(synced: DataFrame) -> DataFrame:
    """Members of newly shown sets."""
    return synced.filter(F.col("kind") == "displayed").drop("kind", "n")


def stream_payloads(packets: DataFrame, tick: float, delay: str = "0 seconds", n_drones: int = 8, max_frame: int | None = None,
                    session_ttl: float | None = None) -> DataFrame:
    """The packets of newly shown sets, with all their columns, ``tick`` and ``n_drones``.

    ``packets``: arrivals with any payload. Only their keys pass the alignment; payloads wait in a join that is bounded in time, as a
    member arrived within the poll window of its set, so the state holds the packets of windows that are still open.
    """
    keys = packets.select("session_id", "packet_id", "drone_id", "frame_num", "arrival_ts")
    rows = _judged(keys, tick, delay, n_drones, max_frame, session_ttl).filter("frame_num > before AND frame_num = shown")
    members = rows.select(F.col("session_id").alias("_session"), F.col("packet_id").alias("_packet"), "closed_at", "tick",
                          F.bit_count("members").cast("int").alias("n_drones"))
    whole = packets.filter(is_valid(n_drones, max_frame)).withWatermark("arrival_ts", delay)
    within = (F.col("arrival_ts") <= F.col("closed_at")) & (F.col("arrival_ts") > F.col("closed_at") - F.expr(f"INTERVAL '{tick:.6f}' SECOND"))
    joined = whole.join(members, (F.col("session_id") == F.col("_session")) & (F.col("packet_id") == F.col("_packet")) & within)
    at = F.timestamp_micros(F.unix_micros("arrival_ts")).alias("arrival_ts")  # no longer the stream's event time
    return joined.select("tick", "n_drones", *[at if c == "arrival_ts" else F.col(c) for c in packets.columns])


def stream_late(synced: DataFrame) -> DataFrame:
    """Late arrivals per (session, tick, frame, drone)."""
    return synced.filter(F.col("kind") == "late").select("session_id", "tick", "frame_num", "drone_id", "n")
