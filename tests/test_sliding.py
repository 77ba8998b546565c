import datetime as dt
import random

import pytest

from swarmframe.operators.sliding import sync_sliding
from swarmframe.schemas import ARRIVALS

T0 = dt.datetime(2024, 1, 1)


def brute(rows, interval, n_drones):
    """Instant by instant, as a display does it."""
    outcomes, sets = {}, []
    sessions = {r[0] for r in rows if r[0] is not None}
    good = [r for r in rows if r[0] is not None and r[2] is not None and 1 <= r[2] <= n_drones and r[3] is not None and r[3] >= 0 and r[4] is not None]
    for r in rows:
        if r not in good:
            outcomes[r[1]] = ("invalid", None)
    for session in sessions:
        buffer, shown, last = {}, -1, None
        mine = [r for r in good if r[0] == session]
        for at in sorted({r[4] for r in mine}):
            for r in sorted((r for r in mine if r[4] == at), key=lambda r: r[1]):
                if r[3] <= shown:
                    outcomes[r[1]] = ("late", None)
                else:
                    buffer[r[1]] = r
            top = max([r[3] for r in buffer.values()], default=-1)
            if top > shown and (last is None or (at - last).total_seconds() >= interval):
                members = {}
                for pid, r in sorted(buffer.items(), key=lambda p: (p[1][4], p[0])):
                    outcomes[pid] = ("displayed", at) if r[3] == top else ("superseded", None)
                    if r[3] == top:
                        members[r[2]] = pid
                sets.append((session, at, top, tuple(sorted(members.items()))))
                buffer, shown, last = {}, top, at
        for pid in buffer:
            outcomes[pid] = ("waiting", None)
    return outcomes, sorted(sets)


def check(spark, rows, interval, n_drones=3, **options):
    df = spark.createDataFrame(rows, ARRIVALS).repartition(3)
    outcomes, sets = sync_sliding(df, interval, n_drones=n_drones, **options)
    want_outcomes, want_sets = brute(rows, interval, n_drones)
    assert {r.packet_id: (r.outcome, r.shown_at) for r in outcomes.collect()} == want_outcomes
    got = sorted((r.session_id, r.shown_at, r.frame_num, tuple((d.drone_id, d.packet_id) for d in r.drones)) for r in sets.collect())
    assert got == want_sets and all(r.n_drones == len(r.drones) for r in sets.collect())


def trace(seed, n, sessions, step_ms=120):
    rnd = random.Random(seed)
    rows, at = [], {s: 0 for s in sessions}
    for pid in range(n):
        s = rnd.choice(sessions)
        at[s] += rnd.choice([0, 0, rnd.randint(0, step_ms), rnd.randint(0, step_ms), 900 if rnd.random() < 0.05 else 1])
        rows.append((s, pid, rnd.randint(1, 3), max(0, at[s] // 200 + rnd.choice([0, 0, 0, 1, -1, -3, 4 if rnd.random() < 0.1 else 0])),
                     T0 + dt.timedelta(milliseconds=at[s])))
    return rows


@pytest.mark.parametrize("seed,interval,chunk_rows", [(1, 0.5, 7), (2, 0.2, 3), (3, 3.0, 40), (4, 0.5, 10_000)])
def test_sliding_equals_replay(spark, seed, interval, chunk_rows):
    check(spark, trace(seed, 160, [1, 2]), interval, chunk_rows=chunk_rows)


def test_one_session_holds_all_rows(spark):
    check(spark, trace(8, 400, [5]), 0.5, chunk_rows=9)


def test_odd_rows(spark):
    at = [T0 + dt.timedelta(milliseconds=100 * k) for k in range(40)]
    rows = [(1, 1, 1, 5, at[0]), (1, 2, 2, 5, at[0]), (1, 3, 1, 6, at[1]), (1, 4, 2, 4, at[2]), (1, 5, 2, 6, at[5]), (1, 6, 3, 6, at[6]),
            (1, 7, 1, 9, at[30]), (1, 8, 1, 8, at[31]), (1, 9, 1, 9, at[31]), (1, 10, 1, 12, at[32]), (None, 11, 1, 3, at[3]), (1, 12, 9, 3, at[3]),
            (1, 13, None, 3, at[3]), (1, 14, 1, None, at[3]), (1, 15, 1, -1, at[3]), (1, 16, 1, 3, None), (2, 17, 1, 0, at[0])]
    check(spark, rows, 0.5)
    outcomes, sets = sync_sliding(spark.createDataFrame([], ARRIVALS))
    assert outcomes.count() == 0 and sets.count() == 0
