import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from swarmframe.operators import stats, sync
from swarmframe.plans.scan import chunked, running, with_previous
from swarmframe.schemas import ARRIVALS

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "session_id bigint, packet_id bigint, drone_id int, frame_num bigint, arrival_ts timestamp"


def replay(rows, n_drones, max_frame):
    """Buffer replayed packet by packet with a poll at the end of each second; the slow way, for comparison."""
    outcome, sets, shown, in_buffer, full_polls, members = {}, [], -1, {}, 0, []
    ticks = sorted({r[4] for r in rows})
    for tick in range(ticks[0], ticks[-1] + 1):
        for _, pid, drone, frame, at, order in sorted((r for r in rows if r[4] == tick), key=lambda r: (r[5], r[1])):
            if not 1 <= drone <= n_drones or not 0 <= frame <= max_frame:
                outcome[pid] = "invalid"
            elif frame <= shown:
                outcome[pid] = "late"
            else:
                in_buffer[(drone, frame)] = pid
                outcome[pid] = "superseded"
        if in_buffer:
            best = max(f for _, f in in_buffer)
            if best > shown:
                members = sorted((d, p) for (d, f), p in in_buffer.items() if f == best)
                sets.append((tick, best, tuple(members)))
                for r in rows:
                    if r[4] == tick and r[3] == best and outcome.get(r[1]) == "superseded":
                        outcome[r[1]] = "displayed"
            shown = best
            in_buffer = {(d, f): p for (d, f), p in in_buffer.items() if f == best}
            full_polls += len(members) == n_drones
    return outcome, sets, full_polls, {d for d, _ in members}


def traces(n=60, n_drones=3, max_frame=40):
    rnd = random.Random(7)
    out, pid = [], 0
    for session in range(n):
        base = 0
        for _ in range(rnd.randint(1, 60)):
            base += rnd.choice([0, 0, 1, 1, 2])
            pid += 1
            frame = max(-1, base + rnd.choice([0, 0, 0, 1, -1, -3, 5]))
            tick = rnd.randint(max(0, base - 2), base + 2)
            out.append((session, pid, rnd.choice([0, *range(1, n_drones + 1), n_drones + 1]), min(frame, max_frame + 1),
                        tick, rnd.randint(0, 999)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(s, p, d, f, T0 + dt.timedelta(seconds=t, milliseconds=ms))
                                  for s, p, d, f, t, ms in rows], SCHEMA)


@pytest.mark.parametrize("bounded", [True, False])
def test_replay_matches_brute_force(spark, bounded):
    n_drones, max_frame = 3, 40
    rows = traces()
    if not bounded:
        rows = [r for r in rows if 0 <= r[3] <= max_frame]
    df = table(spark, rows)
    origin = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    outcomes, sets = sync.sync_latest(df, 1.0, n_drones, max_frame=max_frame if bounded else None, origin_us=origin)
    got = {r.packet_id: r.outcome for r in outcomes.collect()}
    got_sets, stats_of = {}, {}
    for r in sets.collect():
        got_sets.setdefault(r.session_id, []).append((r.tick, r.frame_num, tuple((d.drone_id, d.packet_id) for d in r.drones)))
    for r in sync.buffer_stats(outcomes, sets, n_drones).collect():
        stats_of[(r.session_id, r.drone_id)] = r
    for session in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == session]
        want, want_sets, full_polls, last = replay(mine, n_drones, max_frame)
        assert {p: got[p] for p in want} == want
        assert sorted(got_sets.get(session, [])) == want_sets
        for d in range(1, n_drones + 1):
            s = stats_of[(session, d)]
            ours = [want[r[1]] for r in mine if r[2] == d]
            assert s.received == sum(o in ("displayed", "superseded") for o in ours)
            assert s.dropped == ours.count("late")
            assert s.frames_synchronized_reported == full_polls
            assert s.frames_synchronized == sum(len(m) == n_drones for _, _, m in want_sets)
            assert s.buffer_size == (d in last)
            assert s.current_frame == (want_sets[-1][1] + 1 if want_sets else 0)


def test_scenarios_with_eight_drones(spark):
    rows, pid = [], 0
    script = [(0, [(d, 0) for d in range(1, 9)]), (1, [(1, 2), (2, 2), (3, 1)]), (2, [(d, 1) for d in range(1, 9)]),
              (3, [(1, 0)])]
    for tick, items in script:
        for i, (d, f) in enumerate(items):
            pid += 1
            rows.append((1, pid, d, f, tick, i))
    origin = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    outcomes, sets = sync.sync_latest(table(spark, rows), 1.0, origin_us=origin)
    by_pid = {r.packet_id: r.outcome for r in outcomes.collect()}
    assert [by_pid[p] for p in range(1, 9)] == ["displayed"] * 8
    assert [by_pid[p] for p in (9, 10, 11)] == ["displayed", "displayed", "superseded"]
    assert {by_pid[p] for p in range(12, 21)} == {"late"}
    assert [(r.tick, r.frame_num, r.n_drones) for r in sets.orderBy("tick").collect()] == [(0, 0, 8), (1, 2, 2)]
    text = {r.drone_id: r.status for r in sync.buffer_status_text(outcomes, sets).collect()}
    assert text[1] == "rx=   2, drop=  2, buf= 1 [2]" and text[8] == "rx=   1, drop=  1, buf= 0 [empty]"
    grid = sync.grid_manifest(sets).filter("tick = 1").orderBy("drone_id").collect()
    assert [r.label for r in grid] == ["Drone 1 | Frame 0002", "Drone 2 | Frame 0002"] + ["NO DATA"] * 6
    assert [(r.frame_num) for r in sync.sync_complete(table(spark, rows)).orderBy("frame_num").collect()] == [0, 1]


def test_sessions_start_over(spark):
    rows = [(1, 1, 1, 50, 0, 0), (1, 2, 1, 0, 1, 0), (2, 3, 1, 0, 1, 0)]
    got = {r.packet_id: r.outcome for r in sync.sync_outcomes(table(spark, rows), 1.0).collect()}
    assert got == {1: "displayed", 2: "late", 3: "displayed"}


def test_duplicates_last_write_wins(spark):
    rows = [(1, 1, 1, 3, 0, 5), (1, 2, 1, 3, 0, 9), (1, 3, 1, 3, 0, 9), (1, 4, 2, 3, 0, 1)]
    df = table(spark, rows)
    assert sorted(r.packet_id for r in sync.last_write_wins(df).collect()) == [3, 4]
    _, sets = sync.sync_latest(df, 1.0)
    assert [d.packet_id for d in sets.first().drones] == [3, 4]
    assert sync.frame_completeness(df, 2).first().is_full
    assert sync.best_frame(df.filter("frame_num > 99")).count() == 0


def test_polls_and_rates(spark):
    rows = [(1, 1, 1, 5, 0, 0), (1, 2, 1, 4, 1, 0), (1, 3, 1, 6, 4, 0), (1, 4, 1, 6, 5, 0), (1, 5, 1, 9, 6, 0)]
    df = table(spark, rows)
    origin = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    polls = sync.poll_trace(df, 1.0, origin_us=origin)
    assert [(r.tick, r.frame_num) for r in polls.orderBy("tick").collect()] == [(0, 5), (1, 5), (4, 6), (5, 6), (6, 9)]
    assert [r.tick for r in sync.dedupe_displayed(polls).orderBy("tick").collect()] == [0, 4, 6]
    fps = sync.rolling_fps(sync.sync_sets(df, 1.0, origin_us=origin), 1.0, n=2).orderBy("tick").collect()
    assert [(r.fps, r.avg_fps) for r in fps] == [(0.25, 0.25), (0.5, 0.375)]
    assert fps[1].footer == "Synchronized Frame: 0009 | Display FPS: 0.4"


@pytest.mark.parametrize("step", [1, 1_000_003])
def test_chunked_scans_equal_plain_windows(spark, step):
    """Dense and sparse orders, null keys, a null order, one chunk and many."""
    rnd = random.Random(5)
    rows = [(rnd.choice([0, 1, 2, None]), i * step, rnd.randint(-50, 50)) for i in rnd.sample(range(2000), 300)] + [(1, None, 7)]
    df = spark.createDataFrame(rows, "k int, o bigint, v bigint")
    at = lambda o: -1 if o is None else o
    for chunks, how, exclusive in ((64, "sum", False), (5, "sum", True), (64, "max", True), (2, "min", False), (1, "max", False)):
        got = {(r.k, r.o): r.x for r in running(df, ["k"], "o", {"v": "x"}, how, exclusive, chunks).collect()}
        assert len(got) == len(rows)
        for k, o, _ in rows:
            before = [v for k2, o2, v in rows if k2 == k and (at(o2) < at(o) or (o2 == o and not exclusive))]
            assert got[(k, o)] == ({"sum": sum, "max": max, "min": min}[how](before) if before else None)
    for chunks in (3, 64):
        got = {(r.k, r.o): r.p for r in with_previous(df, ["k"], ["o"], {"v": "p"}, chunks).collect()}
        for k, o, _ in rows:
            before = [(at(o2), v) for k2, o2, v in rows if k2 == k and at(o2) < at(o)]
            assert got[(k, o)] == (max(before)[1] if before else None)
    total = running(df, [], "o", {"v": "x"}).orderBy(F.desc("o")).first().x
    assert total == sum(v for _, _, v in rows)
    assert running(df.limit(0), ["k"], "o", {"v": "x"}).collect() == []


def test_chunks_hold_about_as_many_rows_each(spark):
    rows = [(i * i * 1_000_000,) for i in range(4000)]
    sizes = [r["count"] for r in chunked(spark.createDataFrame(rows, "o bigint"), "o", 16).groupBy("_chunk").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)


def test_high_frames_and_incomplete_rows(spark):
    origin = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    df = spark.createDataFrame(
        [(1, i, 1, 300 * i, T0 + dt.timedelta(seconds=i)) for i in range(10)]
        + [(None, 50, 1, 5, T0), (1, 51, 1, 5000, None), (1, 52, None, 5000, T0), (1, 53, 1, None, T0)], SCHEMA)
    outcomes, sets = sync.sync_latest(df, 1.0, origin_us=origin)
    assert max(r.frame_num for r in sets.collect()) == 2700
    got = {r.packet_id: r.outcome for r in outcomes.collect()}
    assert {i: got[i] for i in (50, 51, 52, 53)} == dict.fromkeys((50, 51, 52, 53), "invalid") and got[9] == "displayed"
    shown = {d.packet_id for r in sets.collect() for d in r.drones}
    assert shown == {i for i, o in got.items() if o == "displayed"}
    log = spark.createDataFrame([(1, 1, 1, 20, T0), (1, 2, None, 20, T0), (None, 3, 1, 20, None)], SCHEMA)
    assert sorted(r.packet_id for r in stats.progress_sample(log, every=20, side="receiver").collect()) == [1, 2, 3]
    sized = log.withColumn("packet_bytes", F.lit(1024))
    assert stats.running_avg_kb(sized, every=20).count() == 3
    polls = spark.createDataFrame([(None, 1, 5), (None, 2, 5), (1, 1, 7)], "session_id bigint, tick bigint, frame_num bigint")
    assert sorted((r.session_id or 0, r.tick) for r in sync.dedupe_displayed(polls).collect()) == [(0, 1), (1, 1)]


def test_gaps_and_progress(spark):
    rnd = random.Random(11)
    rows, pid = [], 0
    for drone in (1, 2):
        at = 0
        for i in range(60):
            at += rnd.choice([1, 1, 2, 4, 5, 6, 30])
            pid += 1
            rows.append((1, pid, drone, i // 2 * rnd.choice([1, 1, 2]) % 50, at, 0))
    df = table(spark, rows)
    got = {(r.drone_id, r.silent_from): (r.back_at, r.gap_seconds, r.connection_no)
           for r in stats.connection_gaps(df, 5.0).collect()}
    want = {}
    for drone in (1, 2):
        times = [T0 + dt.timedelta(seconds=r[4]) for r in rows if r[2] == drone]
        n = 1
        for a, b in zip(times, times[1:]):
            if (b - a).total_seconds() > 5:
                n += 1
                want[(drone, a)] = (b, (b - a).total_seconds(), n)
    assert got == want and want
    gaps = {(r.drone_id, r.gap_from, r.gap_to, r.n_missing) for r in stats.frame_gaps(df, n_frames=60).collect()}
    missing = {(d, f) for d, a, b, _ in gaps for f in range(a, b + 1)}
    assert missing == {(d, f) for d in (1, 2) for f in range(60)} - {(r[2], r[3]) for r in rows}
    assert all(n == b - a + 1 for _, a, b, n in gaps)
    sampled = stats.progress_sample(df, every=4, side="receiver").collect()
    want = []
    for drone in (1, 2):
        last = None
        for r in [r for r in rows if r[2] == drone and r[3] % 4 == 0]:
            if r[3] != last:
                want.append(r[1])
            last = r[3]
    assert sorted(r.packet_id for r in sampled) == sorted(want)


def test_sender_and_receiver_counters(spark):
    log = spark.createDataFrame([(1, "sent", 2048), (1, "sent", 1024), (1, "failed", 9), (1, "idle", 9), (2, "idle", 9)],
                                "drone_id int, outcome string, packet_bytes bigint")
    rows = stats.drone_report(stats.sender_stats(log)).collect()
    assert (rows[0].sent, rows[0].failed, rows[0].total_bytes, rows[0].avg_kb) == (2, 1, 3072, 1.5)
    assert round(rows[0].success_pct, 3) == 66.667 and rows[1].success_pct == 0 and rows[1].avg_kb == 0
    log = spark.createDataFrame([(1, False), (1, False), (1, True)], "drone_id int, failed boolean")
    assert stats.receiver_stats(log).first().success_rate_reported == 75.0


def test_recent_rows_reach_over_chunks(spark):
    from swarmframe.plans.scan import over_recent

    rnd = random.Random(3)
    rows = [(k, i * rnd.choice([1, 1, 50]) + i, float(rnd.randint(0, 9))) for k in ("a", None) for i in range(1, 90)]
    rows = list({(k, o): (k, o, v) for k, o, v in rows}.values()) + [("b", 7, 1.0)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    for n, chunks in ((1, 9), (2, 100), (7, 25), (30, 100), (500, 16)):
        got = over_recent(df, ["k"], "o", {"v": "s"}, n, "sum", chunks)
        want = []
        for key in ("a", "b", None):
            line = sorted(r[1:] for r in rows if r[0] == key)
            want += [(str(key), o, v, sum(x for _, x in line[max(0, i - n + 1):i + 1])) for i, (o, v) in enumerate(line)]
        assert sorted((str(r.k), r.o, r.v, r.s) for r in got.collect()) == sorted(want)


def test_newest_row_at_many_times(spark):
    rnd = random.Random(5)
    # one drone holds most arrivals
    rows = [(1, i, rnd.choice([1, 1, 1, 1, 2, 3]), rnd.randint(0, 50), T0 + dt.timedelta(seconds=rnd.randint(0, 60))) for i in range(300)]
    rows += [(2, 900, 1, 5, T0), (1, 901, 1, 5, None)]
    times = [(1, T0 + dt.timedelta(seconds=s)) for s in (-5, 0, 0, 7, 30, 31, 60, 99)] + [(3, T0), (2, T0 + dt.timedelta(seconds=1)), (1, None)]
    got = sync.latest_per_drone_at(spark.createDataFrame(rows, ARRIVALS), spark.createDataFrame(times, "session_id long, at timestamp"))
    want = set()
    for session, at in times:
        for drone in (1, 2, 3):
            mine = [r for r in rows if r[0] == session and r[2] == drone and at is not None and r[4] is not None and r[4] <= at]
            if mine:
                want.add((session, at, *max(mine, key=lambda r: (r[4], r[1]))[1:5]))
    got = [(r.session_id, r["at"], r.packet_id, r.drone_id, r.frame_num, r.arrival_ts) for r in got.collect()]
    assert set(got) == want and len(got) == len(want)


def test_rates_and_counters_without_session_windows(spark):
    rows = [(1, i, i % 3 + 1, i // 3, T0 + dt.timedelta(seconds=i)) for i in range(200)]
    outcomes, sets = sync.sync_latest(spark.createDataFrame(rows, ARRIVALS), 1.0, n_drones=3)
    for plan in (sync.rolling_fps(sets, 1.0), sync.buffer_stats(outcomes, sets, 3)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        over = [line for line in text.splitlines() if "windowspecdefinition(session_id" in line]
        assert all("_chunk" in line for line in over)
