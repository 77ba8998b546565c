"""Packet, calibration and function queries over the embeddings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmframe import functions as X
from swarmframe.functions.text import frame_key
from swarmframe.operators import calibration as C
from swarmframe.operators import packets as P
from swarmframe.queries.views import CALIBRATION, PACKETS, calibration, packets, vector_bytes
from swarmframe.session import scratch_path
from swarmframe.sources import (parse_extrinsic_xml, parse_intrinsic_xml, scan_captures, scan_extrinsics, scan_intrinsics, scan_packets,
                                stream_captures, write_captures, write_tree)
from swarmframe.streaming import write_sets


def _cells(matrix: str, prefix: str, places: int | None = None):
    out = []
    for i in range(3):
        for j in range(3):
            cell = F.get(F.get(matrix, F.lit(i)), F.lit(j)).cast("double")
            out.append((F.round(cell, places) + F.lit(0.0) if places is not None else cell).alias(f"{prefix}{i}{j}"))
    return out


def rodrigues(spark, sf):
    return calibration(spark, sf).select("vec_id", X.rodrigues("rvec").alias("R")).select("vec_id", *_cells("R", "r", 5))


def decoded_vectors(spark, sf):
    """Round trip of doubles through their bytes."""
    raw = vector_bytes(calibration(spark, sf).select("vec_id", "rvec", "tvec"))
    back = C.decode_vectors(raw, ["rvec", "tvec"])
    t = X.position(X.to_float32("tvec"))
    return back.select("vec_id", *[F.get("rvec", F.lit(i)).alias(f"r{i}") for i in range(3)],
                       *[t[n].cast("double").alias(n) for n in ("tx", "ty", "tz")])


def camera_matrix(spark, sf):
    return calibration(spark, sf).select("vec_id", X.parse_camera_matrix("k_text").alias("K")).select(
        "vec_id", *_cells("K", "k"))


def distortion(spark, sf):
    return calibration(spark, sf).select("vec_id", X.parse_distortion("dist_text").alias("d")).select(
        "vec_id", *[F.get("d", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("k1", "k2", "p1", "p2", "k3"))])


def intrinsics_text(spark, sf):
    known = calibration(spark, sf).select(
        "vec_id", "drone_id", "frame_num", X.intrinsics(X.parse_camera_matrix("k_text")).alias("intr"),
        X.position(X.to_float32("tvec")).alias("pos"))
    text = known.select("vec_id", X.overlay_text("drone_id", "frame_num", "intr", "pos").alias("o"))
    return text.select("vec_id", "o.line1", "o.line2", "o.line3", "o.line4")


def header_info(spark, sf):
    packed = P.pack_packets(packets(spark, sf)).select("packet_id", X.packet_info("packet").alias("i"))
    return packed.select("packet_id", *[F.col(f"i.{n}").alias(n) for n in (
        "drone_id", "frame_num", "jpeg_size", "ts", "total_size", "expected_size")])


def sections(spark, sf):
    packed = P.pack_packets(packets(spark, sf)).select("packet_id", X.packet_sections("packet").alias("s"))
    vectors = packed.select("packet_id", "s", *[X.decode_vec3(f"s.{v}").alias(v) for v in ("rvec", "tvec")])
    return vectors.select("packet_id", F.hex("s.jpeg").alias("jpeg"),
                          *[F.get(v, F.lit(i)).alias(f"{v[0]}{i}") for v in ("rvec", "tvec") for i in range(3)],
                          F.nullif("s.k_text", F.lit("")).alias("k_text"), F.col("s.dist_text").alias("dist_text"))


def headers(spark, sf):
    packed = P.pack_packets(packets(spark, sf)).select("packet_id", X.decode_header("packet").alias("h"), X.f64_le("packet", 16).alias("sent"))
    return packed.select("packet_id", *[F.col(f"h.{n}").alias(n) for n in ("drone_id", "frame_num", "jpeg_size", "ts")], "sent")


def sql_functions(spark, sf):
    """The functions by their SQL names."""
    X.register(spark)
    packed = P.pack_packets(packets(spark, sf)).select("packet_id", "packet")
    return packed.selectExpr(
        "packet_id", "u32_le(packet, 4) AS frame_num", "f64_le(packet, 16) AS sent", "decode_header(packet).jpeg_size AS jpeg_size",
        "packet_info(packet).total_size AS total_size", "decode_vec3(packet_sections(packet).rvec)[1] AS r1", "frame_key(packet_id) AS frame_key", "sample_name('D1', frame_key(packet_id)) AS sample",
        "detection_label(packet_id / 1024) AS label", "grid_cell(cast(packet_id % 8 + 1 AS INT)).x AS pixel_x",
        "detection_status(packet_id % 3) AS status", "active_label(packet_id % 2 = 0) AS state",
        "parse_camera_matrix('1 2 3 4 5 6 7 8 ' || packet_id)[2][2] AS k22", "parse_distortion('0.5 ' || packet_id)[1] AS p",
        "camera_position(array(1F, 2F, cast(packet_id AS FLOAT))).tz AS tz",
        "scale_box(named_struct('x1', 1D, 'y1', 2D, 'x2', 3D, 'y2', cast(packet_id AS DOUBLE)), 2D, 0.5D).y2 AS y2",
        "round(box_iou(0D, 0D, 2D, 2D, 1D, 0D, 3D, packet_id + 1D), 9) AS iou").withColumns(
            {c: F.col(c).cast("double") for c in ("k22", "p", "tz")})


def overlay_fractions(spark, sf):
    """Overlay lines of a matrix in eighths: ties of the rounding to whole numbers come up."""
    eighths = F.transform(X.parse_camera_matrix("k_text"), lambda row: F.transform(row, lambda v: v / 8))
    known = calibration(spark, sf).select("vec_id", "drone_id", "frame_num", X.intrinsics(eighths).alias("intr"), X.position("tvec").alias("pos"))
    return known.select("vec_id", X.overlay_text("drone_id", "frame_num", "intr", "pos").alias("o")).select("vec_id", "o.line2", "o.line3")


def round_trip(spark, sf):
    good, _ = P.decode_packets(P.pack_packets(packets(spark, sf)).drop("drone_id", "frame_num", "error_kind"))
    return _decoded(P.drop_wrong_drone(good))


def _written_captures(spark, sf) -> str:
    """The packets as captured streams, one per port."""
    path = scratch_path(spark, "captures")
    write_captures(P.pack_packets(packets(spark, sf)), path, stream=F.col("port_drone_id"), order=F.col("packet_id"))
    return path


def _captured(rows):
    """Captured packets decoded; the send time names the packet."""
    good, _ = P.decode_packets(rows.filter("framed").select(F.col("stream").cast("int").alias("port_drone_id"), "packet"))
    named = good.withColumn("packet_id", F.round((F.col("ts") - 1_700_000_000.25) * 8).cast("bigint"))
    return _decoded(P.drop_wrong_drone(named))


def captured(spark, sf):
    return _captured(scan_captures(spark, _written_captures(spark, sf), split_bytes=16_384, max_packet=4096))


def capture_stream(spark, sf):
    """The same files read as a stream into a table, then decoded."""
    live = stream_captures(spark, _written_captures(spark, sf), split_bytes=16_384, max_packet=4096)
    path = scratch_path(spark, "capture-rows")
    write_sets(live, path, scratch_path(spark, "capture-checkpoint"), every=None).awaitTermination()
    return _captured(spark.read.schema(live.schema).parquet(path))


def _decoded(good):
    t = X.position("t")
    return good.select(
        "packet_id", "drone_id", "frame_num", "ts", *_cells("K", "k"), *_cells("R", "r", 5),
        *[t[n].cast("double").alias(n) for n in ("tx", "ty", "tz")],
        *[F.get("dist", F.lit(i)).cast("double").alias(f"d{i}") for i in range(5)])


def _damaged(spark, sf):
    """Every way a packet can be broken, by packet id."""
    whole = P.pack_packets(packets(spark, sf)).drop("drone_id", "frame_num", "error_kind")
    size = F.length("packet")
    kind = F.col("packet_id") % 12
    head, body = X.slice_bytes("packet", 0, 24), X.slice_bytes("packet", 24, size)
    jpeg_end = (X.u32_le("packet", 8) + 24)
    texts = jpeg_end + 56
    return whole.select("packet_id", F.when(kind == 1, X.slice_bytes("packet", 0, 79))
                        .when(kind == 2, F.concat(F.lit(b"\x09"), X.slice_bytes("packet", 1, size)))
                        .when(kind == 3, F.concat(X.slice_bytes(head, 0, 4), X.u32_bytes(F.lit(1000)),
                                                  X.slice_bytes(head, 8, 16), body))
                        .when(kind == 4, F.concat(head, F.lit(b"\x00"), X.slice_bytes("packet", 25, size)))
                        .when(kind == 5, F.concat(X.slice_bytes(head, 0, 8), X.u32_bytes(F.lit(124)),
                                                  X.slice_bytes(head, 12, 12), F.lit(b"\xff\xd8" + b"\x01" * 120 + b"\xff\xd9"),
                                                  X.slice_bytes("packet", jpeg_end, 47)))
                        .when(kind == 6, F.concat(X.slice_bytes(head, 0, 8), X.u32_bytes(F.lit(124)),
                                                  X.slice_bytes(head, 12, 12), F.lit(b"\xff\xd8" + b"\x01" * 120 + b"\xff\xd9"),
                                                  X.slice_bytes("packet", jpeg_end, 55)))
                        .when(kind == 7, X.slice_bytes("packet", 0, size - 1))
                        .when(kind == 8, F.concat(X.slice_bytes("packet", 0, texts), F.lit(b"x"),
                                                  X.slice_bytes("packet", texts + 1, size)))
                        .when(kind == 9, F.concat(X.slice_bytes("packet", 0, size - 1), F.lit(b"\xff")))
                        .otherwise(F.col("packet")).alias("packet"))


def validated(spark, sf):
    return P.validate_packets(_damaged(spark, sf)).select("packet_id", "error_kind")


def outgoing(spark, sf):
    rows = packets(spark, sf)
    n = F.col("packet_id") % 7
    rows = (rows.withColumn("drone_id", F.when(n == 1, 0).otherwise(F.col("drone_id")))
            .withColumn("frame_num", F.when(n == 2, 1000).otherwise(F.col("frame_num")))
            .withColumn("jpeg", F.when(n == 3, F.lit(b"")).otherwise(F.col("jpeg")))
            .withColumn("rvec", F.when(n == 4, X.slice_bytes("rvec", 0, 23)).otherwise(F.col("rvec")))
            .withColumn("tvec", F.when(n == 5, F.concat("tvec", F.lit(b"\x00"))).otherwise(F.col("tvec"))))
    return P.validate_outgoing(rows).select("packet_id", "error_kind")


def _xml(spark, sf):
    """Calibration files as text: some elements missing, some of the wrong kind, some damaged."""
    raw = vector_bytes(calibration(spark, sf))
    n = F.col("vec_id")

    def node(name, body, attr=""):
        """In every fourth file the element lies deeper, with data of others around it, and its own data deeper still."""
        plain = F.concat(F.lit(f"<{name} type_id=\"m\"><rows>3</rows><data{attr}>\n  "), body, F.lit(f"\n</data></{name}>"))
        deep = F.concat(F.lit(f"<camera><data>7</data><part><{name} type_id=\"m\"><values><data{attr}>\n  "), body,
                        F.lit(f"\n</data></values><data>8</data></{name}></part></camera><{name}><data>9</data></{name}>"))
        return F.when(n % 4 == 0, deep).otherwise(plain)

    def blob(name):
        data = F.base64(F.concat(F.lit(b"\x01\x02\x03"), name))
        return node(name, F.concat(F.substring(data, 1, 10), F.lit("\n   "), F.substring(data, 11, 99)), ' type_id="binary"')

    intr = F.concat(
        F.lit("<?xml version=\"1.0\"?>\n<opencv_storage>\n"),
        F.when(n % 9 == 1, F.lit("")).otherwise(node("camera_matrix", F.col("k_text"))),
        F.when(n % 9 == 2, F.lit("")).otherwise(node("distortion_coefficients", F.col("dist_text"))),
        F.when(n % 9 == 3, F.lit("<open>")).otherwise(F.lit("</opencv_storage>")))
    extr = F.concat(
        F.lit("<?xml version=\"1.0\"?>\n<opencv_storage>\n"),
        F.when(n % 10 == 1, F.lit("")).when(n % 10 == 2, node("rvec", F.lit("0.1 0.2 0.3"))).otherwise(blob("rvec")),
        F.when(n % 10 == 3, F.lit("")).when(n % 10 == 4, node("tvec", F.lit("!!!"), ' type_id="binary"'))
        .otherwise(blob("tvec")),
        F.when(n % 10 == 5, F.lit("<open>")).otherwise(F.lit("</opencv_storage>")))
    return raw.select("vec_id", "drone_id", "frame_num", intr.alias("intr"), extr.alias("extr"))


def _intr(spark, sf):
    return parse_intrinsic_xml(_xml(spark, sf).select("vec_id", "drone_id", "frame_num", F.col("intr").alias("xml")))


def _extr(spark, sf):
    return parse_extrinsic_xml(_xml(spark, sf).select("vec_id", "drone_id", "frame_num", F.col("extr").alias("xml")))


def _scanned(spark, sf, kind: str, scan):
    """Calibration files written under their names and scanned; a name gives the vector back."""
    root = scratch_path(spark, f"{kind}-files")
    drone, key = F.col("drone_id").cast("string"), frame_key("frame_num")
    name = F.concat(F.lit(f"calibrations/{kind}rinsic/{kind}r_Drone"), drone, F.lit("_"), key, F.lit(".xml"))
    write_tree(_xml(spark, sf), root, name, F.col(f"{kind}r"))
    return scan(spark, root).withColumn("vec_id", F.col("frame_num") * 8 + F.col("drone_id") - 1)


def scanned_packets(spark, sf):
    """Packets at rest: written, scanned with the declared schema, their headers read."""
    path = scratch_path(spark, "packet-table")
    packed = P.pack_packets(packets(spark, sf))
    packed.select("session_id", "packet_id", "port_drone_id", F.timestamp_seconds(F.lit(1_700_000_000)).alias("arrival_ts"), "packet").write.parquet(path)
    rows = scan_packets(spark, path)
    return rows.select("session_id", "packet_id", F.col("port_drone_id").cast("bigint").alias("port_drone_id"), X.decode_header("packet").alias("h")).select(
        "session_id", "packet_id", "port_drone_id", "h.drone_id", "h.frame_num", "h.jpeg_size", "h.ts")


def intrinsic_xml(spark, sf):
    return _intrinsic_texts(_intr(spark, sf))


def _intrinsic_texts(rows):
    return rows.select("vec_id", "k_text", F.nullif("dist_text", F.lit("")).alias("dist_text"), "error_kind")


def extrinsic_xml(spark, sf):
    return _extrinsic_vectors(_extr(spark, sf))


def _extrinsic_vectors(files):
    rows = C.decode_vectors(files, ["rvec", "tvec"])
    return rows.select("vec_id", *[F.get(v, F.lit(i)).alias(f"{v[0]}{i}") for v in ("rvec", "tvec") for i in range(3)],
                       "error_kind")


def loaded(spark, sf):
    known = C.load_calibration(_intr(spark, sf).drop("vec_id"), _extr(spark, sf).drop("vec_id"))
    return known.select("drone_id", "frame_num", *_cells("K", "k"), *_cells("R", "r", 5),
                        *[F.get("t", F.lit(i)).cast("double").alias(f"t{i}") for i in range(3)],
                        *[F.get("dist", F.lit(i)).cast("double").alias(f"d{i}") for i in range(5)])


def compared(spark, sf):
    known = C.load_calibration(_intr(spark, sf).drop("vec_id"), _extr(spark, sf).drop("vec_id"))
    rows = C.compare_calibration(known, 5, [1, 2, 3, 4])
    return rows.select("drone_id", "loaded", *[F.col(n).cast("double").alias(n) for n in ("fx", "fy", "cx", "cy")],
                       *_cells("R", "r", 5), *[F.col(n).cast("double").alias(n) for n in ("tx", "ty", "tz")],
                       *[F.get("dist", F.lit(i)).cast("double").alias(f"d{i}") for i in range(5)], "n_loaded", "n_requested")


def manifest(spark, sf):
    cal = calibration(spark, sf)
    expected = cal.select("drone_id", "frame_num")
    n = F.col("vec_id")
    frames = cal.filter(n % 7 != 0).select("drone_id", "frame_num", F.when(n % 16 == 8, 0).otherwise(900).alias("length"))
    return C.frame_manifest(frames, _extr(spark, sf).filter(n % 15 != 8), _intr(spark, sf).filter(n % 15 != 9),
                            n_frames=1_000_000, expected=expected)


def _sql_r() -> str:
    """Rotation matrix cells, written out from the axis-angle formula."""
    axis = ["x", "y", "z"]
    cells = []
    for i in range(3):
        for j in range(3):
            base = f"(1 - cos(a)) * {axis[i]} * {axis[j]}"
            if i == j:
                base = f"cos(a) + {base}"
            else:
                k = 3 - i - j
                base += f" {'-' if (j - i) % 3 == 1 else '+'} sin(a) * {axis[k]}"
            cells.append(f"round(CAST(CAST({base} AS FLOAT) AS DOUBLE), 5) + 0.0 AS r{i}{j}")
    return ", ".join(cells)


_ANGLES = """
angles AS (
  SELECT *, rvec[1] / a AS x, rvec[2] / a AS y, rvec[3] / a AS z
  FROM (SELECT *, sqrt(rvec[1] * rvec[1] + rvec[2] * rvec[2] + rvec[3] * rvec[3]) AS a FROM {})) """

_K = ", ".join(f"CAST(CAST(k[{3 * i + j + 1}] AS FLOAT) AS DOUBLE) AS k{i}{j}" for i in range(3) for j in range(3))
_K_OR_NULL = ", ".join(f"CASE WHEN k_size > 0 THEN CAST(CAST(k[{3 * i + j + 1}] AS FLOAT) AS DOUBLE) END AS k{i}{j}"
                       for i in range(3) for j in range(3))
_D = "CAST(CAST(coalesce(d[{}], 0) AS FLOAT) AS DOUBLE)"
_KIND_I = "CASE WHEN vec_id % 9 = 3 THEN 'corrupt' END"
_KIND_E = """CASE vec_id % 10 WHEN 5 THEN 'corrupt' WHEN 1 THEN 'rvec_not_found' WHEN 2 THEN 'rvec_not_binary'
       WHEN 3 THEN 'tvec_not_found' WHEN 4 THEN 'tvec_bad_base64' END"""
_LOADED = CALIBRATION + f""",
loaded AS (
  SELECT * FROM texts WHERE vec_id % 9 NOT IN (1, 3) AND {_KIND_E} IS NULL)"""

_DIST = ", ".join(f"CASE WHEN vec_id % 9 = 2 THEN 0.0 ELSE {_D.format(i + 1)} END AS d{i}" for i in range(5))

_ROUND_TRIP = f"""WITH {PACKETS}, {_ANGLES.format('packets')}
SELECT packet_id, drone_id, frame AS frame_num, sent AS ts, {_K_OR_NULL}, {_sql_r()},
       tvec[1] AS tx, tvec[2] AS ty, tvec[3] AS tz, {', '.join(_D.format(i + 1) + f' AS d{i}' for i in range(5))}
FROM angles WHERE port = drone_id"""

_INTRINSIC_SQL = f"""WITH {CALIBRATION}
SELECT vec_id, CASE WHEN vec_id % 9 NOT IN (1, 3) THEN k_text END AS k_text,
       CASE WHEN vec_id % 9 NOT IN (2, 3) THEN nullif(dist_text, '') END AS dist_text, {_KIND_I} AS error_kind FROM texts"""
_EXTRINSIC_SQL = f"""WITH {CALIBRATION}
SELECT vec_id, {', '.join(f"CASE WHEN {_KIND_E} IS NULL THEN {v}[{i + 1}] END AS {v[0]}{i}" for v in ('rvec', 'tvec') for i in range(3))},
       {_KIND_E} AS error_kind FROM calibration"""

QUERIES = {
    "rodrigues": (rodrigues, f"WITH {CALIBRATION}, {_ANGLES.format('calibration')} SELECT vec_id, {_sql_r()} FROM angles"),
    "decode_vectors": (decoded_vectors, f"""WITH {CALIBRATION}
SELECT vec_id, rvec[1] AS r0, rvec[2] AS r1, rvec[3] AS r2, tvec[1] AS tx, tvec[2] AS ty, tvec[3] AS tz
FROM calibration"""),
    "camera_matrix": (camera_matrix, f"WITH {CALIBRATION} SELECT vec_id, {_K} FROM calibration"),
    "distortion": (distortion, f"""WITH {CALIBRATION}
SELECT vec_id, {', '.join(_D.format(i + 1) + f' AS {n}' for i, n in enumerate(('k1', 'k2', 'p1', 'p2', 'k3')))}
FROM calibration"""),
    "intrinsics_text": (intrinsics_text, f"""WITH {CALIBRATION}
SELECT vec_id, printf('Drone %d | Frame %04d', drone_id, frame_num) AS line1,
       printf('Intrinsic: fx=%d fy=%d', k[1], k[5]) AS line2, printf('Principal: cx=%d cy=%d', k[3], k[6]) AS line3,
       printf('Position: x=%.2f y=%.2f z=%.2f', tvec[1], tvec[2], tvec[3]) AS line4 FROM calibration"""),
    "packet_info": (header_info, f"""WITH {PACKETS}
SELECT packet_id, drone_id, frame AS frame_num, jpeg_size, sent AS ts, 80 + jpeg_size + k_size + dist_size AS total_size,
       80 + jpeg_size AS expected_size FROM packets"""),
    "packet_sections": (sections, f"""WITH {PACKETS}
SELECT packet_id, 'FFD8' || repeat('706978656C', CAST(vec_id % 9 AS INTEGER)) || 'FFD9' AS jpeg, rvec[1] AS r0, rvec[2] AS r1, rvec[3] AS r2,
       tvec[1] AS t0, tvec[2] AS t1, tvec[3] AS t2, CASE WHEN k_size > 0 THEN k_text END AS k_text, dist_text FROM packets"""),
    "decode_header": (headers, f"""WITH {PACKETS}
SELECT packet_id, drone_id, frame AS frame_num, jpeg_size, sent AS ts, sent FROM packets"""),
    "sql_functions": (sql_functions, f"""WITH {PACKETS}
SELECT packet_id, frame AS frame_num, sent, jpeg_size, 80 + jpeg_size + k_size + dist_size AS total_size,
       rvec[2] AS r1, printf('%04d', packet_id) AS frame_key, 'D1_' || printf('%04d', packet_id) AS sample,
       printf('person %.2f', packet_id / 1024.0::DOUBLE) AS label, packet_id % 4 * 480 AS pixel_x,
       CASE WHEN packet_id % 3 > 0 THEN packet_id % 3 || ' TARGETS' ELSE 'NO TARGETS' END AS status,
       CASE WHEN packet_id % 2 = 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS state, CAST(packet_id AS DOUBLE) AS k22,
       CAST(packet_id AS DOUBLE) AS p, CAST(packet_id AS DOUBLE) AS tz, packet_id * 0.5::DOUBLE AS y2,
       round(least(2, packet_id + 1) / (4 + 2 * (packet_id + 1) - least(2, packet_id + 1))::DOUBLE, 9) AS iou FROM packets"""),
    "overlay_fractions": (overlay_fractions, f"""WITH {CALIBRATION}
SELECT vec_id, printf('Intrinsic: fx=%.0f fy=%.0f', k[1] / 8.0::DOUBLE, k[5] / 8.0::DOUBLE) AS line2,
       printf('Principal: cx=%.0f cy=%.0f', k[3] / 8.0::DOUBLE, k[6] / 8.0::DOUBLE) AS line3 FROM calibration"""),
    "packet_roundtrip": (round_trip, _ROUND_TRIP),
    "capture_roundtrip": (captured, _ROUND_TRIP),
    "capture_stream": (capture_stream, _ROUND_TRIP),
    "validate_packets": (validated, f"""WITH {PACKETS}
SELECT packet_id, CASE packet_id % 12
  WHEN 1 THEN 'too_small' WHEN 2 THEN 'bad_drone' WHEN 3 THEN 'bad_frame' WHEN 4 THEN 'bad_jpeg'
  WHEN 5 THEN 'extrinsic_truncated' WHEN 6 THEN 'intrinsic_header_truncated'
  WHEN 7 THEN CASE WHEN k_size + dist_size > 0 THEN 'intrinsic_data_truncated' ELSE 'intrinsic_header_truncated' END
  WHEN 8 THEN CASE WHEN k_size > 0 THEN 'bad_k_text' WHEN dist_size > 0 THEN 'bad_dist_text' END
  WHEN 9 THEN CASE WHEN dist_size > 0 THEN 'bad_dist_text' WHEN k_size > 0 THEN 'bad_k_text' END
  END AS error_kind FROM packets"""),
    "validate_outgoing": (outgoing, """
SELECT vec_id AS packet_id, CASE vec_id % 7 WHEN 1 THEN 'bad_drone' WHEN 2 THEN 'bad_frame' WHEN 3 THEN 'empty_frame'
  WHEN 4 THEN 'bad_rvec' WHEN 5 THEN 'bad_tvec' END AS error_kind FROM embeddings"""),
    "scan_packets": (scanned_packets, f"""WITH {PACKETS}
SELECT 1::BIGINT AS session_id, packet_id, port AS port_drone_id, drone_id, frame AS frame_num, jpeg_size, sent AS ts FROM packets"""),
    "intrinsic_xml": (intrinsic_xml, _INTRINSIC_SQL),
    "scan_intrinsics": (lambda s, d: _intrinsic_texts(_scanned(s, d, "int", scan_intrinsics)), _INTRINSIC_SQL),
    "extrinsic_xml": (extrinsic_xml, _EXTRINSIC_SQL),
    "scan_extrinsics": (lambda s, d: _extrinsic_vectors(_scanned(s, d, "ext", scan_extrinsics)), _EXTRINSIC_SQL),
    "load_calibration": (loaded, f"""WITH {_LOADED}, {_ANGLES.format('loaded')}
SELECT drone_id, frame_num, {_K}, {_sql_r()}, tvec[1] AS t0, tvec[2] AS t1, tvec[3] AS t2, {_DIST} FROM angles"""),
    "compare_calibration": (compared, f"""WITH {_LOADED}, {_ANGLES.format('loaded')},
whole AS (SELECT *, {_sql_r()}, {_DIST} FROM angles)
SELECT w.drone_id, k IS NOT NULL AS loaded, CAST(CAST(k[1] AS FLOAT) AS DOUBLE) AS fx,
       CAST(CAST(k[5] AS FLOAT) AS DOUBLE) AS fy, CAST(CAST(k[3] AS FLOAT) AS DOUBLE) AS cx,
       CAST(CAST(k[6] AS FLOAT) AS DOUBLE) AS cy, tvec[1] AS tx, tvec[2] AS ty, tvec[3] AS tz,
       {', '.join(f'r{i}{j}' for i in range(3) for j in range(3))}, d0, d1, d2, d3, d4, count(k) OVER () AS n_loaded, count(*) OVER () AS n_requested
FROM (SELECT unnest([1, 2, 3, 4]) AS drone_id) w LEFT JOIN whole l ON l.drone_id = w.drone_id AND frame_num = 5
ORDER BY 1"""),
    "frame_manifest": (manifest, f"""WITH {CALIBRATION}
SELECT drone_id, frame_num, CASE WHEN vec_id % 7 = 0 THEN 'frame_missing' WHEN vec_id % 15 = 8 THEN 'extrinsic_missing'
  WHEN {_KIND_E} IS NOT NULL THEN 'extrinsic_error' WHEN vec_id % 15 = 9 THEN 'intrinsic_missing'
  WHEN {_KIND_I} IS NOT NULL THEN 'intrinsic_error' WHEN vec_id % 16 = 8 THEN 'pack_error' ELSE 'ok' END AS status
FROM calibration"""),
}
