import os
import random

import pytest
from pyspark.sql import functions as F

from swarmframe.operators import packets as P
from swarmframe.sources.captures import BROKEN, UNFINISHED, frame_size, frames, next_frame, scan_captures, stream_captures, write_captures
from test_packets import golden


def some_packets(seed, n, longest=300):
    """Bodies hold image markers and whole headers, as thumbnails inside an image do."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        body = bytes(rnd.randrange(256) for _ in range(rnd.randint(0, longest)))
        if i % 5 == 0:
            body += golden(frame=i)[:rnd.randint(20, 60)] + b"\xff\xd8\xff\xd9"
        out.append(golden(drone=i % 8 + 1, frame=i % 1200, jpeg=b"\xff\xd8" + body + b"\xff\xd9", k="" if i % 3 == 0 else "1 0 2 0 3 4 0 0 1"))
    return out


def rows_of(df):
    return sorted((r.path, r.offset, r.framed, bytes(r.packet)) for r in df.collect())


def expected(path, pieces):
    """(piece, framed) one after the other."""
    out, at = [], 0
    for piece, framed in pieces:
        out.append((str(path), at, framed, piece))
        at += len(piece)
    return out


def test_sizes_of_frames():
    whole = golden()
    assert frame_size(whole, 0) == len(whole)
    assert all(frame_size(whole[:n], 0) == UNFINISHED for n in range(len(whole)))
    assert frame_size(b"\x01\x01" + whole[2:], 0) == BROKEN
    assert frame_size(whole, 0, max_packet=5) == BROKEN
    assert frame_size(whole.replace(b"\xff\xd9", b"\xff\xd0"), 0) == BROKEN
    assert next_frame(b"", 0) is None and next_frame(b"\xff\xd8" * 50, 0) is None
    assert next_frame(b"xyz" + whole + whole, 0) == 3
    assert list(frames(whole + whole, True)) == [(0, len(whole), True), (len(whole), 2 * len(whole), True)]


@pytest.mark.parametrize("split", [37, 500, 10_000])
def test_any_split_gives_every_packet_once(spark, tmp_path, split):
    folder = tmp_path / "7"
    folder.mkdir()
    packets = some_packets(split, 60)
    (folder / "a.bin").write_bytes(b"".join(packets))
    (folder / "b.bin").write_bytes(b"")
    got = scan_captures(spark, str(tmp_path), split_bytes=split, max_packet=1000)
    assert rows_of(got) == expected(folder / "a.bin", [(p, True) for p in packets])
    assert {r.stream for r in got.collect()} == {"7"}


@pytest.mark.parametrize("split", [150, 10_000])
def test_damaged_bytes_come_out_beside_the_packets(spark, tmp_path, split):
    packets = some_packets(3, 30)
    damaged = [b"\x05\x05" + packets[4][2:], packets[9][:90]]  # a broken header, a packet without its end
    longer = packets[14][:8] + (900).to_bytes(4, "little") + packets[14][12:]  # a header that claims more than there is
    pieces = [(p, True) for p in packets[:4]] + [(damaged[0], False)] + [(p, True) for p in packets[5:9]] + [(damaged[1], False)]
    pieces += [(p, True) for p in packets[10:14]] + [(longer, False)] + [(p, True) for p in packets[15:]] + [(packets[0][:40], False)]
    (tmp_path / "a.bin").write_bytes(b"".join(p for p, _ in pieces))
    got = scan_captures(spark, str(tmp_path), split_bytes=split, max_packet=4000)
    assert rows_of(got) == expected(tmp_path / "a.bin", pieces)
    _, bad = P.decode_packets(got.select("offset", "packet"))
    assert {b.error_kind for b in bad.collect()} <= {"too_small", "bad_drone", "bad_frame", "bad_jpeg", "extrinsic_truncated",
                                                    "intrinsic_header_truncated", "intrinsic_data_truncated"}


def test_written_captures_read_back(spark, tmp_path):
    packets = some_packets(5, 80)
    df = spark.createDataFrame([(i % 3, i, p) for i, p in enumerate(packets)] + [(1, 500, None)], "port int, seq int, packet binary")
    for _ in range(2):  # a second job adds its files
        write_captures(df, str(tmp_path / "out"), F.col("port"), F.col("seq"))
    got = scan_captures(spark, str(tmp_path / "out"), split_bytes=1000, max_packet=1000)
    assert got.filter("framed").count() == got.count() == 160
    assert sorted(bytes(r.packet) for r in got.filter("stream = '2'").collect()) == sorted(packets[2::3] * 2)
    assert not [n for _, _, names in os.walk(tmp_path / "out") for n in names if n.startswith("_")]


def test_growing_files_are_read_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "in" / "3"
    folder.mkdir(parents=True)
    packets = some_packets(6, 40)
    whole = b"".join(packets)

    def run():
        live = stream_captures(spark, str(tmp_path / "in"), split_bytes=700, max_packet=1000)
        query = (live.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        query.awaitTermination()
        return [bytes(r.packet) for r in spark.read.schema(live.schema).parquet(str(tmp_path / "out")).collect()]

    cut = len(b"".join(packets[:17])) + 30  # inside packet 17
    (folder / "a.bin").write_bytes(whole[:cut])
    assert sorted(run()) == sorted(packets[:17])
    (folder / "a.bin").write_bytes(whole)
    (folder / "b.bin").write_bytes(packets[0])
    assert sorted(run()) == sorted([*packets, packets[0]])
    assert sorted(run()) == sorted([*packets, packets[0]])
