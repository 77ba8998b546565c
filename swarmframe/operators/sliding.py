"""Alignment under a display that paces itself by its last new set.

A live display polls again once ``interval`` seconds have passed since it last showed a new set, so its polls are not on a
fixed grid. A poll happens when arrivals come in (all arrivals of one instant are in before it): the first instant of a session
is polled, and after a new set at ``t`` the next new set is shown at the first instant at or after ``t + interval`` by which a
higher frame than the shown one has come. Nothing else can change what is shown, as a poll returns the highest frame so far.

So each instant has one successor, whatever happened before it: the later of the first instant from ``t + interval`` on and the
next instant that raises the highest frame. What the display shows is the path of successors from the first instant of a
session. Successors come from running values in chunks. The path is found without walking a session:

1. instants are cut into chunks by time; inside each, one pass from its end finds where a path that enters at an instant leaves;
2. the instants at which chunks can be entered, with these exits, are contracted by pointer doubling, in as many rounds as
   the logarithm of the number of chunks that a session has;
3. one pass inside each chunk marks the path from the entry that turned out to be taken.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from swarmframe.operators.sync import SESSION, is_valid
from swarmframe.plans.lookup import micros
from swarmframe.plans.once import stored
from swarmframe.plans.scan import CHUNKS, chunked, running

#: Instants that one chunk is meant for.
CHUNK_ROWS = 200_000


def _n_chunks(rows: int, chunk_rows: int) -> int:
    return max(1, -(-rows // chunk_rows))


def _instants(arrivals: DataFrame, n_drones: int, max_frame: int | None, keys: Sequence[str]) -> DataFrame:
    valid = arrivals.filter(is_valid(n_drones, max_frame, keys))
    return valid.groupBy(*keys, micros("arrival_ts").alias("us")).agg(F.max("frame_num").alias("_top"))


def _successors(instants: DataFrame, interval: float, keys: Sequence[str], chunks: int) -> DataFrame:
    """(keys, ``us``, ``peak``, ``succ``): highest frame so far, and the next new set if a new set is shown here."""
    keys = list(keys)
    before = running(instants, keys, "us", {"_top": "_before"}, how="max", exclusive=True, chunks=chunks)
    peaks = before.select(*keys, "us", F.greatest("_before", "_top").alias("peak"), (-F.col("us")).alias("_down"),
                          F.when(F.col("_before").isNull() | (F.col("_top") > F.col("_before")), F.col("us")).alias("_raises"))
    raised = running(peaks, keys, "_down", {"_raises": "_raised"}, how="min", exclusive=True, chunks=chunks)
    rows = raised.select(*keys, "us", "peak", "_raised", (F.col("us") + F.lit(int(round(interval * 1_000_000)))).alias("_wake"))
    rows = stored(rows, "sliding-instants")
    # where a higher frame comes before the display is ready again, it shows at the first instant from then on
    waits = rows.filter(F.col("_raised") < F.col("_wake")).select(*keys, F.col("_wake").alias("_at"), F.lit(None).cast("bigint").alias("_is"))
    points = waits.unionByName(rows.select(*keys, F.col("us").alias("_at"), F.col("us").alias("_is")))
    points = points.groupBy(*keys, "_at").agg(F.max("_is").alias("_is")).withColumn("_down", -F.col("_at"))
    nexts = running(points, keys, "_down", {"_is": "_first"}, how="min", chunks=chunks).select(*keys, F.col("_at").alias("_wake"), "_first")
    found = rows.join(nexts, [*keys, "_wake"], "left")
    return found.select(*keys, "us", "peak", F.when(F.col("_raised") < F.col("_wake"), F.col("_first")).otherwise(F.col("_raised")).alias("succ"))


def _exits(columns: Sequence[str]):
    # local functions travel to the workers with their code
    def run(part: pd.DataFrame) -> pd.DataFrame:
        """Where the path from each instant of a chunk leaves it (null: it ends inside)."""
        part = part.sort_values("us", ignore_index=True)
        us, succ = part["us"].to_numpy(), part["succ"].fillna(-1).to_numpy(dtype=np.int64)
        at, out = np.searchsorted(us, succ), succ.copy()
        for i in np.flatnonzero((succ >= 0) & (succ <= us[-1]))[::-1].tolist():  # successors lie later, so theirs are known
            out[i] = out[at[i]]
        part["leaves"] = pd.Series(out).where(out >= 0).astype("Int64")
        return part[list(columns)]

    return run


def _marked(columns: Sequence[str]):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        """The instants of a chunk on the path from its entry, if it is entered."""
        part = part.sort_values("us", ignore_index=True)
        us, succ = part["us"].to_numpy(), part["succ"].fillna(-1).to_numpy(dtype=np.int64)
        on_path = part["entered"].notna().to_numpy()
        at = np.searchsorted(us, succ)
        i = int(on_path.argmax()) if on_path.any() else len(us)
        while i < len(us):
            on_path[i] = True
            i = int(at[i]) if 0 <= succ[i] <= us[-1] else len(us)
        return part.loc[on_path, list(columns)]

    return run


def _entries(exits: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The instants at which the path from ``starts`` enters a chunk, by pointer doubling over all possible entries."""
    keys = list(keys)
    targets = exits.filter(F.col("leaves").isNotNull()).select(*keys, F.col("leaves").alias("us"))
    possible = targets.unionByName(starts).distinct()
    jump = stored(exits.select(*keys, "us", F.col("leaves").alias("to")).join(possible, [*keys, "us"]).filter(F.col("to").isNotNull()),
                  "sliding-jumps")
    reached = starts
    while True:
        # ``reached`` holds the first 2^k entries of each path, ``jump`` leads 2^k entries on
        further = stored(reached.join(jump, [*keys, "us"]).select(*keys, F.col("to").alias("us")), "sliding-reached")
        if further.isEmpty():
            return reached
        reached = reached.unionByName(further)
        onward = jump.select(*keys, F.col("us").alias("to"), F.col("to").alias("_to"))
        jump = stored(jump.join(onward, [*keys, "to"]).select(*keys, "us", F.col("_to").alias("to")), "sliding-jumps")


def _shown(instants: DataFrame, interval: float, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    """(keys, ``us``, ``frame_num``) of every new set."""
    keys = list(keys)
    chunks = _n_chunks(instants.count(), chunk_rows)
    pointers = chunked(stored(_successors(instants, interval, keys, max(chunks, CHUNKS)), "sliding-successors"), "us", chunks)
    pointers = stored(pointers, "sliding-chunks")
    exits = stored(pointers.groupBy(*keys, "_chunk").applyInPandas(
        _exits([*keys, "us", "leaves"]), StructType([*[pointers.schema[c] for c in (*keys, "us")], StructField("leaves", LongType())])),
        "sliding-exits")
    starts = stored(pointers.groupBy(*keys).agg(F.min("us").alias("us")), "sliding-starts")
    entered = _entries(exits, starts, keys).withColumn("entered", F.lit(True))
    rows = pointers.join(entered, [*keys, "us"], "left")
    path = rows.groupBy(*keys, "_chunk").applyInPandas(_marked(pointers.columns), pointers.schema)
    return path.select(*keys, "us", F.col("peak").alias("frame_num"))


def sync_sliding(arrivals: DataFrame, interval: float = 0.5, n_drones: int = 8, keys: Sequence[str] = SESSION,
                 max_frame: int | None = None, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Replay of the buffer under the display's own pace -> (outcomes, sets).

    ``outcomes``: every arrival with ``outcome`` (displayed, superseded, late, invalid, or waiting: no new set came after it) and
    ``shown_at``, the time of the new set it belongs to. ``sets``: every new set with its time, frame, members (last write per
    drone) and their count.
    """
    keys = list(keys)
    instants = stored(_instants(arrivals, n_drones, max_frame, keys), "sliding-times")
    shown = stored(_shown(instants, interval, keys, chunk_rows), "sliding-shown")
    chunks = max(_n_chunks(instants.count(), chunk_rows), CHUNKS)
    marks = shown.select(*keys, "us", F.col("frame_num").alias("_shown"), F.col("us").alias("_shown_us"))
    lined = instants.select(*keys, "us", (-F.col("us")).alias("_down")).join(marks, [*keys, "us"], "left")
    lined = running(stored(lined, "sliding-line"), keys, "us", {"_shown": "_before"}, how="max", exclusive=True, chunks=chunks)
    lined = running(lined, keys, "_down", {"_shown": "_next", "_shown_us": "_next_us"}, how="min", chunks=chunks)
    facts = lined.select(*keys, F.col("us").alias("_us"), "_before", "_next", "_next_us")
    rows = arrivals.withColumn("_valid", is_valid(n_drones, max_frame, keys)).withColumn("_us", micros("arrival_ts"))
    joined = rows.join(facts, [*keys, "_us"], "left")
    frame = F.col("frame_num")
    outcome = (F.when(~F.col("_valid"), "invalid").when(frame <= F.col("_before"), "late").when(F.col("_next").isNull(), "waiting")
               .when(frame == F.col("_next"), "displayed").otherwise("superseded"))
    judged = joined.withColumn("outcome", outcome)
    outcomes = judged.select(*arrivals.columns, "outcome",
                             F.when(F.col("outcome") == "displayed", F.timestamp_micros("_next_us")).alias("shown_at"))
    members = (outcomes.filter("outcome = 'displayed'").groupBy(*keys, "shown_at", "frame_num", "drone_id")
               .agg(F.max(F.struct("arrival_ts", "packet_id")).alias("_last")))
    # at most n_drones members per set
    sets = (members.groupBy(*keys, "shown_at", "frame_num").agg(F.sort_array(F.collect_list(F.struct(
        F.col("drone_id"), F.col("_last.packet_id").alias("packet_id"), F.col("_last.arrival_ts").alias("arrival_ts")))).alias("drones"))
        .withColumn("n_drones", F.size("drones")))
    return outcomes, sets
