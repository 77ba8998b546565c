import struct

from pyspark.sql import functions as F

from swarmframe import functions as X
from swarmframe.operators import packets as P

JPEG = b"\xff\xd8body\xff\xd9"


def golden(drone=1, frame=5, ts=1700000000.125, jpeg=JPEG, r=(0.1, 0.2, 0.3), t=(1.0, -2.5, 3.25), k="1 0 2 0 3 4 0 0 1",
           dist="0.1 0.2 0.3"):
    k, dist = k.encode(), dist.encode()
    return (struct.pack("<B3xII4xd", drone, frame, len(jpeg), ts) + jpeg + struct.pack("<3d", *r)
            + struct.pack("<3d", *t) + struct.pack("<II", len(k), len(dist)) + k + dist)


def _frame(spark, packets):
    return spark.createDataFrame([(i, p) for i, p in enumerate(packets)], "packet_id int, packet binary")


def test_header_is_24_bytes(spark):
    assert struct.calcsize("<B3xII4xd") == struct.calcsize("B I I d") == 24
    row = _frame(spark, [golden(), b"\x01" * 23]).select("packet_id", X.packet_info("packet").alias("i"),
                                                         X.decode_header("packet").alias("h")).orderBy("packet_id").collect()
    info = row[0].i
    assert (info.drone_id, info.frame_num, info.jpeg_size, info.ts) == (1, 5, len(JPEG), 1700000000.125)
    assert info.total_size == len(golden()) and info.expected_size == 80 + len(JPEG)
    assert row[0].h.frame_num == 5 and row[1].i is None


def test_error_kinds_in_order(spark):
    whole = golden()
    extr = 24 + len(JPEG)
    cases = [
        (whole, None), (whole[:79], "too_small"), (b"", "too_small"), (golden(drone=0), "bad_drone"),
        (golden(drone=9, frame=1000), "bad_drone"), (golden(frame=1000), "bad_frame"),
        (golden(jpeg=b"\x00\xd8body\xff\xd9"), "bad_jpeg"), (golden(jpeg=b"\xff\xd8bodyxx"), "bad_jpeg"),
        (golden(jpeg=b""), "bad_jpeg"),
        (golden(jpeg=b"\xff\xd8" + b"." * 90 + b"\xff\xd9")[:24 + 94 + 47], "extrinsic_truncated"),
        (golden(jpeg=b"\xff\xd8" + b"." * 90 + b"\xff\xd9")[:24 + 94 + 55], "intrinsic_header_truncated"),
        (whole[:-1], "intrinsic_data_truncated"), (golden(k="1 2"), "bad_k_text"), (golden(k=" "), "bad_k_text"),
        (golden(dist="0.1 x"), "bad_dist_text"), (whole[:-1] + b"\xff", "bad_dist_text"),
        (golden(k="", dist=""), None), (golden(k="") + b"trailing", None),
        (whole[:8] + struct.pack("<I", 2 ** 32 - 1) + whole[12:], "bad_jpeg"),
        (whole[:extr + 48] + struct.pack("<II", 2 ** 32 - 1, 2 ** 32 - 1) + whole[extr + 56:], "intrinsic_data_truncated"),
    ]
    got = P.validate_packets(_frame(spark, [c[0] for c in cases])).orderBy("packet_id").collect()
    assert [r.error_kind for r in got] == [c[1] for c in cases]


def test_decode(spark):
    good, bad = P.decode_packets(_frame(spark, [golden(), golden(k="", dist=""), golden(drone=0), golden(
        dist="1 2 3 4 5 6 7 8")]))
    rows = good.orderBy("packet_id").collect()
    assert [r.packet_id for r in rows] == [0, 1, 3]
    assert rows[0].K == [[1, 0, 2], [0, 3, 4], [0, 0, 1]] and rows[0].t == [1.0, -2.5, 3.25]
    assert [round(x, 6) for x in rows[0].dist] == [0.1, 0.2, 0.3, 0, 0]
    assert rows[1].K is None and rows[1].dist == [0.0] * 5
    assert rows[2].dist == [1, 2, 3, 4, 5]
    assert [(r.packet_id, r.error_kind) for r in bad.collect()] == [(2, "bad_drone")]
    assert "packet" in bad.columns and "packet" not in good.columns


def test_pack_is_byte_exact(spark):
    rows = [(1, 5, 1700000000.125, JPEG, struct.pack("<3d", .1, .2, .3), struct.pack("<3d", 1, -2.5, 3.25),
             "1 0 2 0 3 4 0 0 1", "0.1 0.2 0.3"),
            (8, 999, 0.0, JPEG, b"\0" * 24, b"\1" * 24, None, None),
            (9, 5, 1.0, JPEG, b"\0" * 24, b"\0" * 24, None, None), (1, 1000, 1.0, JPEG, b"\0" * 24, b"\0" * 24, None, None),
            (1, 5, 1.0, b"", b"\0" * 24, b"\0" * 24, None, None), (1, 5, 1.0, JPEG, b"\0" * 23, b"\0" * 24, None, None),
            (1, 5, 1.0, JPEG, b"\0" * 24, b"\0" * 25, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, drone_id int, frame_num bigint, ts double, jpeg binary, rvec binary, tvec binary, "
                               "k_text string, dist_text string")
    got = P.pack_packets(df).orderBy("i").collect()
    assert bytes(got[0].packet) == golden()
    assert bytes(got[1].packet)[-56:] == b"\0" * 24 + b"\1" * 24 + b"\0" * 8
    assert [r.error_kind for r in got] == [None, None, "bad_drone", "bad_frame", "empty_frame", "bad_rvec", "bad_tvec"]
    assert all(r.packet is None for r in got[2:])
    again = P.validate_packets(P.pack_packets(df).filter("packet IS NOT NULL").select("i", "packet"))
    assert again.filter(F.col("error_kind").isNotNull()).count() == 0


def test_wrong_drone(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "drone_id int, port_drone_id int")
    assert P.drop_wrong_drone(df).count() == 2
