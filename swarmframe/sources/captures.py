"""Captured packet streams: files in which packets lie end to end, as they came over a connection.

A packet has no marker of its own; its length follows from its header and from two sizes behind the image. A file is
read in splits. A split holds the packets that *end* in its range, so a packet belongs to exactly one split and is whole in a file
that is still growing. To find its first packet a split looks back by at most ``max_packet`` bytes (some packets' worth), takes the first
position where ``CONFIRM`` packets follow each other, and goes on from there. Bytes that are no packet come out as one row without ``framed``,
together with the packet behind them or, at the end of a file, in its last split; of a damaged stretch that is longer than the look back
the part that no split can tell from a packet's end is left out.

The stream reader's offset is the number of bytes of each file. A batch reads what lies between two offsets; the cut-off end
of a growing file waits until its packet is whole. The writer puts each task's packets into one file, named when the job commits.
Folders are opened with ``pyarrow.fs``, so paths may be local or in an object store that it knows.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)

# this module's code travels with its classes, so workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, offset long, framed boolean, packet binary"
#: Packets in a row that make a position believable.
CONFIRM = 3
#: Longest packet, and longest calibration text in it.
MAX_PACKET = 4 << 20
MAX_TEXT = 1 << 16
# The packet layout in bytes.
HEADER, HEADER_SIZE = "<B3sII4sd", 24
TAIL, TAIL_SIZE = "<II", 8
VECTORS = 48
BROKEN, UNFINISHED = -1, 0


def frame_size(data: bytes, at: int, max_packet: int = MAX_PACKET) -> int:
    """Length of the packet that begins at ``at``; BROKEN if none can, UNFINISHED if the data end inside it."""
    if at + HEADER_SIZE > len(data):
        return UNFINISHED
    _, pad, _, jpeg, gap, _ = struct.unpack_from(HEADER, data, at)
    if pad != b"\0\0\0" or gap != b"\0\0\0\0" or not 4 <= jpeg <= max_packet:
        return BROKEN
    image = at + HEADER_SIZE
    if data[image:image + 2] != b"\xff\xd8"[:len(data) - image]:
        return BROKEN
    sizes = image + jpeg + VECTORS
    if sizes + TAIL_SIZE > len(data):
        return UNFINISHED
    k_size, dist_size = struct.unpack_from(TAIL, data, sizes)
    if data[image + jpeg - 2:image + jpeg] != b"\xff\xd9" or k_size > MAX_TEXT or dist_size > MAX_TEXT:
        return BROKEN
    end = sizes + TAIL_SIZE + k_size + dist_size
    return end - at if end <= len(data) else UNFINISHED


def next_frame(data: bytes, at: int, max_packet: int = MAX_PACKET) -> int | None:
    """The first position from ``at`` on at which whole packets follow each other (as many as the data hold)."""
    image = data.find(b"\xff\xd8", at + HEADER_SIZE)
    while image >= 0:
        begin = here = image - HEADER_SIZE
        for n in range(CONFIRM):
            size = frame_size(data, here, max_packet)
            if size == BROKEN or size == UNFINISHED and n == 0:
                break
            here += size
            if size == UNFINISHED or here == len(data):
                return begin
        else:
            return begin
        image = data.find(b"\xff\xd8", image + 1)
    return None


def frames(data: bytes, whole_start: bool, max_packet: int = MAX_PACKET) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, framed) of packets and of what lies between them. ``whole_start``: the data begin with a packet.

    The rest behind the last packet comes last, without ``framed``, if there is any.
    """
    at = 0 if whole_start else next_frame(data, 0, max_packet)
    while at is not None and at < len(data):
        size = frame_size(data, at, max_packet)
        if size > 0:
            yield at, at + size, True
            at += size
            continue
        # a damaged header may claim a long packet: whole packets behind it say so
        found = next_frame(data, at + 1, max_packet)
        yield at, len(data) if found is None else found, False
        at = found


def file_system(path: str):
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def _sizes(path: str) -> dict[str, int]:
    """Size of every capture file below a path; hidden names are not read."""
    from pyarrow import fs

    system, root = file_system(path)
    info = system.get_file_info(root)
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in files if f.type == fs.FileType.File and f.base_name[0] not in "._"}


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int
    last: bool


def _splits(path: str, begin: int, end: int, size: int, last: bool) -> list[Split]:
    cuts = [*range(begin, end, size), end]
    return [Split(path, a, b, last and b == end) for a, b in zip(cuts, cuts[1:], strict=False)]


class _Captures:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", 32 << 20))
        self.max_packet = int(options.get("maxpacket", MAX_PACKET))

    def rows(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        start = max(0, split.begin - self.max_packet)
        with system.open_input_file(split.path) as file:
            data = file.read_at(split.end - start, start)
        out: list[tuple] = []
        size, gap = 0, None
        for begin, end, framed in frames(data, start == 0, self.max_packet):
            if not framed:
                gap = (split.path, start + begin, False, data[begin:end])  # goes with the packet behind it
                continue
            if start + end > split.begin:
                out += [r for r in (gap, (split.path, start + begin, True, data[begin:end])) if r]
                size += end - begin
            gap = None
            if size > 8 << 20:
                yield self._batch(out)
                out, size = [], 0
        if gap is not None and split.last:
            out.append(gap)
        yield self._batch(out)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.bool_(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          names=["path", "offset", "framed", "packet"])


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.captures = _Captures(options)

    def partitions(self) -> list[Split]:
        c = self.captures
        return [s for path, size in sorted(_sizes(c.path).items()) for s in _splits(path, 0, size, c.split_bytes, last=True)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from self.captures.rows(partition)


class CaptureStreamReader(DataSourceStreamReader):
    """Offsets are sizes of files; what is read is what ends between two of them."""

    def __init__(self, options: dict[str, str]):
        self.captures = _Captures(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _sizes(self.captures.path)

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return [s for path, size in sorted(end.items()) if size > start.get(path, 0)
                for s in _splits(path, start.get(path, 0), size, self.captures.split_bytes, last=False)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from self.captures.rows(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


@dataclass
class Written(WriterCommitMessage):
    files: str


class CaptureWriter(DataSourceWriter):
    """Rows (``stream``, ``packet``) of a task, in their order, to one hidden file per stream; commit gives the files their names."""

    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"], uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = file_system(self.path)
        task, name, file, files = TaskContext.get().partitionId(), None, None, []
        for row in iterator:
            if row.packet is None:
                continue
            if row.stream != name:
                if file is not None:
                    file.close()
                name = row.stream
                system.create_dir(f"{root}/{name}", recursive=True)
                files.append((f"{root}/{name}/_{uuid.uuid4().hex}", f"{root}/{name}/part-{task:05d}-{len(files):03d}-{self.job}.bin"))
                file = system.open_output_stream(files[-1][0])
            file.write(row.packet)
        if file is not None:
            file.close()
        return Written(json.dumps(files))

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for hidden, named in (f for m in messages if m is not None for f in json.loads(m.files)):
            system.move(hidden, named)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for hidden, _named in (f for m in messages if m is not None for f in json.loads(m.files)):
            system.delete_file(hidden)


class CaptureSource(DataSource):
    """Spark format ``packet_capture``; options ``path``, ``splitBytes``, ``maxPacket``."""

    @classmethod
    def name(cls) -> str:
        return "packet_capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStreamReader:
        return CaptureStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options)


def _with_stream(rows: DataFrame) -> DataFrame:
    """``stream`` is the name of the folder that a capture lies in."""
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("stream"), "path", "offset", "framed", "packet")


def scan_captures(spark: SparkSession, path: str, split_bytes: int = 32 << 20, max_packet: int = MAX_PACKET) -> DataFrame:
    """Packets of captured streams: ``stream``, ``path``, ``offset``, ``framed``, ``packet``."""
    spark.dataSource.register(CaptureSource)
    return _with_stream(spark.read.format("packet_capture").option("splitBytes", split_bytes).option("maxPacket", max_packet).load(path))


def stream_captures(spark: SparkSession, path: str, split_bytes: int = 32 << 20, max_packet: int = MAX_PACKET) -> DataFrame:
    """The same, of files that grow and of files that are added, as a stream."""
    spark.dataSource.register(CaptureSource)
    return _with_stream(spark.readStream.format("packet_capture").option("splitBytes", split_bytes)
                        .option("maxPacket", max_packet).load(path))


def write_captures(df: DataFrame, path: str, stream: Column, order: Column, packet: str = "packet") -> None:
    """Write packets end to end, in ``order``, a folder per ``stream``; a long stream is written as several files."""
    df.sparkSession.dataSource.register(CaptureSource)
    rows = df.select(stream.cast("string").alias("stream"), order.alias("_order"), F.col(packet).alias("packet"))
    dealt = rows.repartitionByRange("stream", "_order").sortWithinPartitions("stream", "_order")
    dealt.select("stream", "packet").write.format("packet_capture").mode("append").save(path)
