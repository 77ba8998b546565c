import datetime as dt
import os
import random

from pyspark.sql import functions as F

from swarmframe.operators import sync
from swarmframe.schemas import ARRIVALS
from swarmframe.streaming import (stream_counts, stream_dedup, stream_dropped, stream_late, stream_payloads, stream_sessions, stream_sets, stream_stats, stream_sync,
                                  stream_tick_max, write_sets)

T0 = dt.datetime(2024, 1, 1)
FAR = T0 + dt.timedelta(days=2)


def trace(n=400, seed=3):
    rnd = random.Random(seed)
    rows, base = [], 0
    for pid in range(n):
        base += rnd.choice([0, 0, 1])
        rows.append((rnd.randint(1, 2), pid, rnd.randint(0, 4), max(0, base // 2 + rnd.choice([0, 0, 1, -1, -4])),
                     T0 + dt.timedelta(milliseconds=250 * base + rnd.randint(0, 200))))
    return sorted(rows, key=lambda r: r[4])


def files(spark, rows, path, parts=5):
    """The rows as files in order of time, with distinct modification times, and one late row that closes all windows."""
    size = len(rows) // parts + 1
    chunks = [rows[i:i + size] for i in range(0, len(rows), size)] + [[(9, 10 ** 6, 1, 0, FAR)]]
    for i, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, ARRIVALS).coalesce(1).write.parquet(f"{path}/{i}")
        for name in os.listdir(f"{path}/{i}"):
            os.utime(f"{path}/{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return (spark.readStream.schema(ARRIVALS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
            .parquet(path))


def drain(spark, df, tmp_path, name):
    query = write_sets(df, str(tmp_path / name), str(tmp_path / f"{name}-cp"), every=None)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def test_stream_equals_batch(spark, tmp_path):
    rows = trace()
    live = files(spark, rows, str(tmp_path / "in"))
    synced = drain(spark, stream_sync(live, 1.0, n_drones=3, session_ttl=3600), tmp_path, "out")
    outcomes, sets = sync.sync_latest(spark.createDataFrame(rows, ARRIVALS), 1.0, n_drones=3)
    want = {(r.session_id, r.tick, r.frame_num, d.drone_id, d.packet_id, r.n_drones) for r in sets.collect() for d in r.drones}
    got = {(r.session_id, r.tick, r.frame_num, r.drone_id, r.packet_id, r.n_drones) for r in stream_sets(synced).collect()}
    assert got == want
    counts = {(r.session_id, r.drone_id): (r.received, r.dropped) for r in stream_dropped(synced).collect()}
    batch = outcomes.filter("outcome <> 'invalid'").groupBy("session_id", "drone_id").agg(
        F.count_if(F.col("outcome") != "late").alias("r"), F.count_if(F.col("outcome") == "late").alias("d")).collect()
    assert counts == {(r.session_id, r.drone_id): (r.r, r.d) for r in batch}
    assert stream_late(synced).agg(F.sum("n")).first()[0] == sum(r.d for r in batch)


def test_tick_max_dedup_sessions(spark, tmp_path):
    rows = trace(200, 5)
    live = files(spark, rows, str(tmp_path / "in"))
    peaks = drain(spark, stream_tick_max(live, 1.0, n_drones=3), tmp_path, "peaks")
    batch = sync.poll_trace(spark.createDataFrame(rows, ARRIVALS), 1.0, n_drones=3)
    assert peaks.groupBy("session_id").agg(F.max("frame_num")).collect() and peaks.count() == batch.count()
    unique = drain(spark, stream_dedup(live, "1 day"), tmp_path, "unique")
    assert unique.filter("session_id < 9").count() == len({(r[0], r[2], r[3]) for r in rows})
    runs = drain(spark, stream_sessions(live, "5 seconds", "1 second"), tmp_path, "runs").filter("session_id < 9")
    assert runs.agg(F.sum("packets")).first()[0] == len(rows)


def test_running_counters(spark, tmp_path):
    rows = trace(100, 6)
    live = files(spark, rows, str(tmp_path / "in")).select(
        "drone_id", (F.col("packet_id") % 5 == 0).alias("failed"), F.lit(10).cast("bigint").alias("packet_bytes"))
    seen = []
    query = (stream_stats(live).writeStream.outputMode("update").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "cp"))
             .foreachBatch(lambda df, i: seen.append({r.drone_id: (r.received, r.failed, r.total_bytes) for r in df.collect()})).start())
    query.awaitTermination()
    final = {}
    for update in seen:
        final.update(update)
    for d in range(5):
        mine = [r for r in rows if r[2] == d] + ([(9, 10 ** 6, 1, 0, FAR)] if d == 1 else [])
        assert final[d] == (len(mine), len([r for r in mine if r[1] % 5 == 0]), 10 * len(mine))


def test_a_session_is_forgotten_after_its_ttl(spark, tmp_path):
    """Frame 10, a long silence, then frame 3: late while the session is known, shown once it is forgotten."""
    rows = [(1, 1, 1, 10, T0), (2, 2, 1, 1, T0 + dt.timedelta(seconds=100)), (2, 3, 1, 2, T0 + dt.timedelta(seconds=200)),
            (1, 4, 1, 3, T0 + dt.timedelta(seconds=300))]
    live = files(spark, rows, str(tmp_path / "in"))
    for ttl, want in ((50, "displayed"), (10_000, "late"), (None, "late")):
        out = drain(spark, stream_sync(live, 1.0, n_drones=3, session_ttl=ttl), tmp_path, f"ttl-{ttl}")
        assert {r.packet_id: r.kind for r in out.filter("session_id = 1").collect()} == {1: "displayed", 4: want}


def test_counters_run_over_restarts(spark, tmp_path):
    """The state of the counters survives a restart from the checkpoint; every update is the total so far."""
    rows = trace(300, 11)
    half = [r for r in rows if r[4] < rows[150][4]]
    extended = spark.createDataFrame([], ARRIVALS).withColumn("failed", F.lit(True)).withColumn("packet_bytes", F.lit(1).cast("bigint")).schema

    def put(part, name):
        full = [(*r, r[1] % 7 == 0, 10) for r in part]
        spark.createDataFrame(full, extended).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        live = spark.readStream.schema(extended).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        df = stream_counts(live, 1.0, n_drones=3)
        write_sets(df, str(tmp_path / "out"), str(tmp_path / "cp"), every=None).awaitTermination()
        return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))

    put(half, "a")
    first = run().count()
    put([r for r in rows if r not in half] + [(9, 10 ** 6, 1, 0, FAR)], "b")
    updates = run()
    assert 0 < first < updates.count()
    names = ("packets", "failed", "total_bytes", "accepted", "dropped")
    got = {(r.session_id, r.drone_id): tuple(r[c] for c in names) for r in updates.groupBy("session_id", "drone_id").agg(
        *[F.max(c).alias(c) for c in names]).collect()}
    good = [r for r in rows if r[1] % 7]
    outcomes, _ = sync.sync_latest(spark.createDataFrame(good, ARRIVALS), 1.0, n_drones=3)
    judged = {(r.session_id, r.drone_id): (r.a, r.d) for r in outcomes.filter("outcome <> 'invalid'").groupBy("session_id", "drone_id").agg(
        F.count_if(F.col("outcome") != "late").alias("a"), F.count_if(F.col("outcome") == "late").alias("d")).collect()}
    want = {}
    for s, d in {(r[0], r[2]) for r in rows}:
        mine = [r for r in rows if (r[0], r[2]) == (s, d)]
        want[s, d] = (len(mine), sum(r[1] % 7 == 0 for r in mine), 10 * len(mine), *judged.get((s, d), (0, 0)))
    assert got == want


def test_payloads_come_with_their_sets_and_leave_the_state(spark, tmp_path):
    rows = trace(300, 12)
    live = files(spark, rows, str(tmp_path / "in"), parts=8).withColumn("payload", F.concat(F.lit("image "), F.col("packet_id")))
    df = stream_payloads(live, 1.0, n_drones=3)
    query = write_sets(df, str(tmp_path / "out"), str(tmp_path / "cp"), every=None)
    query.awaitTermination()
    _, sets = sync.sync_latest(spark.createDataFrame(rows, ARRIVALS), 1.0, n_drones=3)
    want = {(r.session_id, r.tick, r.frame_num, r.n_drones, d.drone_id, d.packet_id, d.arrival_ts, f"image {d.packet_id}")
            for r in sets.collect() for d in r.drones}
    got = [(r.session_id, r.tick, r.frame_num, r.n_drones, r.drone_id, r.packet_id, r.arrival_ts, r.payload)
           for r in spark.read.schema(df.schema).parquet(str(tmp_path / "out")).filter("session_id < 9").collect()]
    assert set(got) == want and len(got) == len(want)
    joins = [s for s in query.lastProgress["stateOperators"] if s["operatorName"] == "symmetricHashJoin"]
    # the last row closes all windows: nothing of them waits any longer
    assert len(joins) == 2 and all(s["numRowsTotal"] <= 4 for s in joins)
