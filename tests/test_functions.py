import math
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from swarmframe import functions as X


def _doubles():
    rnd = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308,
              1.7976931348623157e308, math.inf, -math.inf, math.nan, 0.1, 1 / 3, 1_700_000_000.25]
    values += [2.0 ** e for e in range(-1074, 1024, 37)] + [math.nextafter(2.0 ** e, 0) for e in range(-1000, 1024, 41)]
    values += [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(300)]
    return values


def _same(a, b):
    return (math.isnan(a) and math.isnan(b)) or struct.pack("<d", a) == struct.pack("<d", b)


def test_doubles_from_bytes(spark):
    values = _doubles()
    df = spark.createDataFrame([(i, b"\x07" + struct.pack("<d", v)) for i, v in enumerate(values)], "i int, b binary")
    got = df.select("i", X.f64_le("b", 1).alias("v"), X.f64_le("b", 2).alias("short")).orderBy("i").collect()
    assert all(_same(r.v, v) for r, v in zip(got, values))
    assert all(r.short is None for r in got)


def test_doubles_to_bytes(spark):
    values = _doubles()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = X.with_f64_bytes(df, {"v": "b"}).orderBy("i").collect()
    for r, v in zip(got, values):
        assert _same(struct.unpack("<d", bytes(r.b))[0], v), v


def test_u32(spark):
    values = [0, 1, 255, 256, 65536, 0x01020304, 2 ** 32 - 1]
    df = spark.createDataFrame([(v, struct.pack("<I", v)) for v in values], "v bigint, b binary")
    for r in df.select("v", "b", X.u32_le("b", 0).alias("x"), X.u32_bytes("v").alias("y")).collect():
        assert r.x == r.v and bytes(r.y) == bytes(r.b)


def test_rodrigues(spark):
    rnd = random.Random(2)
    vectors = [(0.0, 0.0, 0.0), (1e-17, 0.0, 0.0), (math.pi, 0.0, 0.0), (0.0, 0.0, math.pi / 2)]
    vectors += [tuple(rnd.uniform(-3, 3) for _ in range(3)) for _ in range(50)]
    df = spark.createDataFrame([(i, list(v)) for i, v in enumerate(vectors)], "i int, r array<double>")
    for row in df.select("i", X.rodrigues("r").alias("R")).collect():
        r = np.array(vectors[row.i])
        theta = np.linalg.norm(r)
        k = r / theta if theta > 1e-15 else np.zeros(3)
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        want = np.eye(3) if theta < 1e-15 else np.eye(3) + np.sin(theta) * cross + (1 - np.cos(theta)) * cross @ cross
        got = np.array(row.R)
        assert np.allclose(got, want, atol=1e-6)
        assert np.allclose(got @ got.T, np.eye(3), atol=1e-5)


def test_camera_texts(spark):
    cases = {
        "1 2 3 4 5 6 7 8 9": True, " 1\n2\t3 4 5 6 7 8 1e1 \n": True, "1 2 3": False, "": False,
        "1 2 3 4 5 6 7 8 x": False, "1 2 3 4 5 6 7 8 9 10": False, "1f 2 3 4 5 6 7 8 9": False,
        "1_0 2. .5 -4 +5 6 inf nan 9": True,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.K for r in df.select("t", X.parse_camera_matrix("t").alias("K")).collect()}
    for text, good in cases.items():
        assert (got[text] is not None) == good, text
    assert got["1_0 2. .5 -4 +5 6 inf nan 9"][0] == [10.0, 2.0, 0.5]
    assert got[" 1\n2\t3 4 5 6 7 8 1e1 \n"][2] == [7.0, 8.0, 10.0]


def test_distortion(spark):
    cases = {"1 2 3": [1, 2, 3, 0, 0], "1 2 3 4 5": [1, 2, 3, 4, 5], "1 2 3 4 5 6 7 8": [1, 2, 3, 4, 5], "": [0] * 5,
             None: [0] * 5, "1 x": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.d for r in df.select("t", X.parse_distortion("t").alias("d")).collect()}
    assert got == {k: v and [float(x) for x in v] for k, v in cases.items()}


def test_fixed_prints_like_python(spark):
    rnd = random.Random(3)
    values = [0.5, 1.5, 2.5, 2.675, 0.475, 1.005, -0.001, -0.0, 0.0, 99.995, 1e9 + 0.5, -2.5, 123456.785, 1e14,
              math.inf, -math.inf, math.nan]
    values += [rnd.uniform(-1000, 1000) for _ in range(500)] + [i / 200 for i in range(-400, 400)]
    values += [float(np.float32(rnd.uniform(-50, 50))) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select("i", *[X.fixed("v", p).alias(f"p{p}") for p in (0, 1, 2, 3)]).orderBy("i").collect()
    for row, v in zip(got, values):
        for p in (0, 1, 2, 3):
            assert row[f"p{p}"] == f"{v:.{p}f}", (v, p)


def test_labels_and_grid(spark):
    df = spark.createDataFrame([(d, d - 3, 5.0) for d in range(1, 9)], "d int, n int, c double")
    rows = df.select("d", X.grid_cell("d").alias("g"), X.detection_status("n").alias("s"), X.active_label(F.col("n") > 0)
                     .alias("a"), X.frame_key("d").alias("k"), X.sample_name(F.lit("D1"), X.frame_key("d")).alias("m"),
                     X.scale_box(F.struct(F.col("c").alias("x1"), F.col("c").alias("y1"), F.col("c").alias("x2"),
                                          F.col("c").alias("y2")), 0.75).alias("b")).collect()
    assert [(r.g.row, r.g.col, r.g.y, r.g.x) for r in rows] == [
        (i // 4, i % 4, i // 4 * 270, i % 4 * 480) for i in range(8)]
    assert [r.s for r in rows][:5] == ["NO TARGETS", "NO TARGETS", "NO TARGETS", "1 TARGETS", "2 TARGETS"]
    assert [r.a for r in rows][2:4] == ["INACTIVE", "ACTIVE"]
    assert rows[0].k == "0001" and rows[0].m == "D1_0001" and rows[0].b.x1 == 3.75


def test_overlay_without_calibration(spark):
    df = spark.createDataFrame([(1, 7, None)], "d int, f int, t string")
    row = df.select(X.overlay_text("d", "f", X.intrinsics(X.parse_camera_matrix("t")), X.position(
        F.lit(None).cast("array<float>"))).alias("o")).first().o
    assert row.line1 == "Drone 1 | Frame 0007" and row.line2 is None and row.line3 is None and row.line4 is None


def test_sql_names(spark):
    X.register(spark)
    values = [0.25, 0.475, 0.125, 0.999, 1.0, 0.005]
    df = spark.createDataFrame([(v, struct.pack("<d", v) + struct.pack("<I", i)) for i, v in enumerate(values)],
                               "v double, b binary")
    df.createOrReplaceTempView("coded")
    rows = spark.sql("SELECT v, f64_le(b, 0) AS w, u32_le(b, 8) AS u, detection_label(v) AS l FROM coded").collect()
    assert [r.w for r in rows] == values and [r.u for r in rows] == list(range(6))
    assert [r.l for r in rows] == [f"person {v:.2f}" for v in values]
    row = spark.sql("SELECT frame_key(7) k, sample_name('D1', '0003') s, grid_row(6) r, grid_col(6) c, "
                    "detection_status(3L) t, active_label(false) a, box_iou(0,0,2,2, 1,0,3,2) i").first()
    assert (row.k, row.s, row.r, row.c, row.t, row.a) == ("0007", "D1_0003", 1, 1, "3 TARGETS", "INACTIVE")
    assert abs(row.i - 1 / 3) < 1e-12


def test_sql_names_equal_the_column_functions(spark):
    """Every SQL name on a grid of values, nulls included."""
    X.register(spark)
    from swarmframe.functions.registry import DEFINITIONS

    head = struct.pack("<B3xIII", 3, 77, 4, 0)[:16] + struct.pack("<d", 12.5)
    packet = head + b"\xff\xd8\xff\xd9" + struct.pack("<6d", *range(6)) + struct.pack("<II", 17, 3) + b"1 2 3 4 5 6 7 8 9" + b".25"
    values = {
        "b BINARY": [packet, packet[:30], b"", None], "off INT": [0, 4, 99, None], "v BIGINT": [0, 4611686018427387904, -1, None],
        "v ARRAY<DOUBLE>": [[0.1, 0.2, 0.3], [0.0, 0.0, 0.0], None], "v ARRAY<FLOAT>": [[1.0, 2.0, 3.0], None],
        "s STRING": ["1 2 3 4 5 6 7 8 9", "0.5 x", "", None], "k ARRAY<ARRAY<FLOAT>>": [[[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]], None],
        "n BIGINT": [0, 7, 12345, None], "folder STRING": ["D1", None], "stem STRING": ["0001"], "drone INT": [1, 8], "frame BIGINT": [5, None],
        "fps DOUBLE": [0.25, 2.05, None], "active BOOLEAN": [True, False, None], "conf DOUBLE": [-0.05, 0.005, 0.125, 1.0, None],
        "sx DOUBLE": [2.0], "sy DOUBLE": [0.5, None]}
    box = [{"x1": 0.0, "y1": 0.0, "x2": 2.0, "y2": 2.0}, {"x1": 1.0, "y1": 0.0, "x2": 3.0, "y2": 2.0}]
    for name, (args, function) in DEFINITIONS.items():
        parts = [a.strip() for a in __import__("re").split(r",\s*(?![^<]*>)", args)]
        if name == "box_iou":
            rows = [(0.0, 0.0, 2.0, 2.0, 1.0, 0.0, 3.0, 2.0), (0.0,) * 8, (3.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0, 1.0)]
        else:
            def of(part):
                kind = part.split()[0]
                if kind == "box":
                    return box
                if kind == "intr":
                    return [{"fx": 1.5, "fy": 2.5, "cx": 3.0, "cy": None}]
                if kind == "pos":
                    return [{"tx": 1.0, "ty": -0.005, "tz": 2.0}, None]
                return values[part]
            import itertools
            rows = list(itertools.product(*[of(p) for p in parts]))
        df = spark.createDataFrame(rows, args)
        both = df.select(function(*[F.col(c) for c in df.columns]).alias("a"), F.expr(f"{name}({', '.join(df.columns)})").alias("b")).collect()
        assert [str(r.a) for r in both] == [str(r.b) for r in both], name
