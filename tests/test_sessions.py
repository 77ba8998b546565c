import datetime as dt
import random

import pytest

from swarmframe.operators.sessions import recover_sessions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "packet_id long, drone_id int, frame_num long, arrival_ts timestamp, note string"


def brute(rows, rewind):
    out, state = {}, {}
    for r in sorted((r for r in rows if None not in (r[1], r[2], r[3])), key=lambda r: (r[3], r[0])):
        top, number = state.get(r[1], (None, 0))
        if top is None or r[2] < top - rewind:
            top, number = r[2], number + 1
        top = max(top, r[2])
        state[r[1]] = (top, number)
        out[r[0]] = number
    return {r[0]: out.get(r[0]) for r in rows}


def trace(seed, n, drones=3, wild=False):
    rnd = random.Random(seed)
    rows, frame = [], dict.fromkeys(range(1, drones + 1), 0)
    for i in range(n):
        d = rnd.randint(1, drones)
        frame[d] = 0 if rnd.random() < 0.03 else frame[d] + rnd.choice([0, 1, 1, 2])
        f = rnd.randint(0, 30) if wild else max(0, frame[d] - rnd.choice([0, 0, 0, 1, 3, 5]))
        rows.append((i, d, f, T0 + dt.timedelta(milliseconds=rnd.randint(0, n * 4) if wild else i * 10), "x"))
    return rows


@pytest.mark.parametrize("seed,rewind,chunk_rows,wild", [(1, 5, 10, False), (2, 0, 7, False), (3, 3, 4, True), (4, 12, 25, True), (5, 10, 10_000, False)])
def test_chunks_number_sessions_like_a_replay(spark, seed, rewind, chunk_rows, wild):
    rows = trace(seed, 300, wild=wild)
    got = recover_sessions(spark.createDataFrame(rows, SCHEMA).repartition(4), rewind, chunk_rows=chunk_rows)
    assert got.columns == ["packet_id", "drone_id", "frame_num", "arrival_ts", "note", "session_no"]
    assert {r.packet_id: r.session_no for r in got.collect()} == brute(rows, rewind)


def test_a_rewind_across_a_chunk_boundary(spark):
    """Frames fall slowly: whether a chunk resets depends on what came before it."""
    frames = [20, 18, 16, 14, 12, 10, 8, 6, 4, 2, 0] * 3
    rows = [(i, 1, f, T0 + dt.timedelta(seconds=i), "x") for i, f in enumerate(frames)]
    for chunk_rows in (1, 2, 3, 5):
        got = recover_sessions(spark.createDataFrame(rows, SCHEMA), 5, chunk_rows=chunk_rows)
        assert {r.packet_id: r.session_no for r in got.collect()} == brute(rows, 5)


def test_unknown_rows_are_in_no_session(spark):
    rows = [(1, None, 5, T0, "x"), (2, 1, None, T0, "x"), (3, 1, 5, None, "x"), (4, 1, 5, T0, None), (5, 1, 5, T0, "same instant"), (6, 1, 0, T0, "x")]
    got = recover_sessions(spark.createDataFrame(rows, SCHEMA), 3)
    assert {r.packet_id: r.session_no for r in got.collect()} == {1: None, 2: None, 3: None, 4: 1, 5: 1, 6: 2}
    assert recover_sessions(spark.createDataFrame([], SCHEMA)).count() == 0
    whole = recover_sessions(spark.createDataFrame([(1, 1, 9, T0, "a"), (2, 2, 1, T0 + dt.timedelta(1), "b")], SCHEMA), 3, keys=())
    assert sorted(r.session_no for r in whole.collect()) == [1, 2]
