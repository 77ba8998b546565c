"""Sessions of streams that carry no session id: a rewind of the frame numbers starts a new one.

A restarted sender counts from the beginning again, while a packet that was overtaken is only a little behind. So an arrival
starts a session if its frame lies more than ``rewind`` below the highest frame of the session so far, and the new session's
highest frame is its own: a running maximum with resets.

What a stretch of arrivals does to the running maximum is a function with few pieces: after its first frame ``f`` the maximum is ``f``
unless it came in between ``f + 1`` and ``f + rewind``, so ``rewind + 1`` values say where the stretch ends and how often it resets
for any maximum that comes in. These functions compose. Chunks of time are reduced to theirs in parallel, the one row per
chunk is folded per stream, and a second pass over the chunks numbers their arrivals.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from swarmframe.plans.lookup import join_null_safe, micros
from swarmframe.plans.once import stored
from swarmframe.plans.scan import chunked

#: Arrivals that one chunk is meant for.
CHUNK_ROWS = 200_000
_LOCAL = ["_chunk", "_us"]


def _reduced(keys: Sequence[str], rewind: int):
    # local functions travel to the workers with their code
    def run(table: pa.Table) -> pa.Table:
        """The chunk as a function: its first frame, then highest frame and resets behind it per highest frame that may come in."""
        frames = table.sort_by([("_us", "ascending"), ("packet_id", "ascending"), ("frame_num", "ascending")]).column("frame_num").to_numpy()
        top = np.append(frames[0], frames[0] + np.arange(1, rewind + 1))
        resets = np.zeros(rewind + 1, dtype=np.int64)
        for f in frames[1:].tolist():
            falls = top > f + rewind
            resets += falls
            top = np.where(falls, f, np.maximum(top, f))
        row = {k: table.column(k).slice(0, 1) for k in (*keys, "_chunk")}
        return pa.table({**row, "_first": [int(frames[0])], "_tops": [top.tolist()], "_resets": [resets.tolist()]})

    return run


def _folded(keys: Sequence[str], rewind: int):
    def run(table: pa.Table) -> pa.Table:
        """Highest frame and session number that come into each chunk of a stream; one row per chunk."""
        table = table.sort_by("_chunk")
        came, numbers, top, number = [], [], None, 0
        for first, tops, resets in zip(*(table.column(c).to_pylist() for c in ("_first", "_tops", "_resets")), strict=True):
            came.append(top)
            numbers.append(number)
            if top is None:
                at, starts = 0, 1
            else:
                at, starts = (top - first if first < top <= first + rewind else 0), int(top > first + rewind)
            top, number = tops[at], number + starts + resets[at]
        return pa.table({**{k: table.column(k) for k in (*keys, "_chunk")}, "_top": pa.array(came, pa.int64()),
                         "_number": pa.array(numbers, pa.int64())})

    return run


def _numbered(columns: Sequence[str], rewind: int):
    def run(table: pa.Table) -> pa.Table:
        """Session numbers of a chunk's arrivals."""
        table = table.sort_by([("_us", "ascending"), ("packet_id", "ascending"), ("frame_num", "ascending")])
        top, number, out = table.column("_top")[0].as_py(), table.column("_number")[0].as_py(), []
        for f in table.column("frame_num").to_pylist():
            if top is None or top > f + rewind:
                top, number = f, number + 1
            elif f > top:
                top = f
            out.append(number)
        return table.select(list(columns)).append_column("session_no", pa.array(out, pa.int64()))

    return run


def recover_sessions(arrivals: DataFrame, rewind: int = 10, keys: Sequence[str] = ("drone_id",), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``session_no``, counted from 1 within each stream (``keys``) in order of arrival.

    Arrivals of one instant follow their packet ids. Rows without a time, frame or key are in no session (null). Chunks are reduced
    when this is called.
    """
    keys = list(keys)
    known = F.col("arrival_ts").isNotNull() & F.col("frame_num").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    good = arrivals.filter(known).withColumn("frame_num", F.col("frame_num").cast("bigint")).withColumn("_us", micros("arrival_ts"))
    n_chunks = max(1, -(-good.count() // chunk_rows))
    rows = stored(chunked(good, "_us", n_chunks), "session-chunks")
    named = [rows.schema[k] for k in (*keys, "_chunk")]
    reduced = rows.select(*keys, *_LOCAL, "packet_id", "frame_num").groupBy(*keys, "_chunk").applyInArrow(
        _reduced(keys, rewind), StructType([*named, StructField("_first", LongType()), StructField("_tops", ArrayType(LongType())),
                                            StructField("_resets", ArrayType(LongType()))]))
    # one row per stream and chunk
    folded = reduced.groupBy(*keys).applyInArrow(
        _folded(keys, rewind), StructType([*named, StructField("_top", LongType()), StructField("_number", LongType())]))
    entered = join_null_safe(rows, stored(folded, "session-entries"), [*keys, "_chunk"])
    columns = arrivals.columns
    fields = [good.schema[c] for c in columns]
    numbered = entered.groupBy(*keys, "_chunk").applyInArrow(_numbered(columns, rewind), StructType([*fields, StructField("session_no", LongType())]))
    return numbered.unionByName(arrivals.filter(~F.coalesce(known, F.lit(False))).withColumn("session_no", F.lit(None).cast("bigint")))
