"""Packing documents into training windows by the sum-of-squares rule.

Every input partition is packed by itself, as a stream: no shuffle, and memory is bounded by the open windows. A document
first fills whole windows; the rest of it, ``r`` ids, goes into the open window whose fill level ``h`` makes the sum of
the squared counts of partially filled windows least (``h = 0`` opens one). A level array holds the count of every level.
Windows still open at the end of a partition (or whenever more than ``max_open`` are) are laid end to end and cut anew at
the window size, so a partition pads one window at most.

Cases: a null or empty text is the end id alone; a null id is carried through; repeated rows are packed each; equal costs
go to the fuller level; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import shipped, texts_of
from .tokens import default_vocabulary, documents_ids

_FAR = np.iinfo(np.int64).max


class Levels:
    """Open windows by fill level. A piece is (document number, start in the document, its ids as bytes)."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0

    def best(self, r: int) -> int:
        """The level from which adding ``r`` ids keeps the sum of squares least (0: a new window)."""
        left = self.count[1:self.window - r + 1]
        change = np.where(left > 0, 1 - 2 * left, _FAR)
        change[:-1] += np.where(left[:-1] > 0, 2 * self.count[r + 1:self.window] + 1, 0)
        if not len(change):
            return 0
        h = len(change) - int(change[::-1].argmin())
        return h if change[h - 1] <= 2 * self.count[r] + 1 else 0

    def place(self, piece: tuple, r: int) -> list | None:
        """Add a piece of ``r`` ids; the window, if that fills it."""
        h = self.best(r)
        if h:
            pieces = self.open[h].pop()
            self.count[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + r == self.window:
            return pieces
        self.open[h + r].append(pieces)
        self.count[h + r] += 1
        self.n_open += 1
        return None

    def close(self) -> Iterator[list]:
        """All open windows, end to end and cut at the window size."""
        window, room = [], self.window
        for level in reversed(self.open):
            for pieces in level:
                for number, start, ids in pieces:
                    while ids:
                        part, ids = ids[:4 * room], ids[4 * room:]
                        window.append((number, start, part))
                        start, room = start + len(part) // 4, room - len(part) // 4
                        if not room:
                            yield window
                            window, room = [], self.window
        if window:
            yield window
        self.__init__(self.window)


def _pack_batches(window: int, vocabulary: str, max_open: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, n_windows = Levels(window), TaskContext.get().partitionId() << 40
        names: dict[int, tuple] = {}  # documents with an open piece: id and number of ids
        n_docs, rows, size = 0, [], 0

        def written(pieces: list) -> None:
            nonlocal n_windows, size
            offset = 0
            for number, start, ids in pieces:
                doc_id, n_tokens = names[number]
                rows.append((doc_id, start, len(ids) // 4, n_tokens, n_windows, offset, ids))
                offset += len(ids) // 4
                size += len(ids)
            n_windows += 1

        def flushed() -> pa.RecordBatch:
            nonlocal rows, size
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            rows, size = [], 0
            return out

        def settle() -> None:
            for pieces in levels.close():
                written(pieces)
            names.clear()

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, ids in zip(doc_ids, documents_ids(texts_of(batch.column(1)), vocabulary), strict=True):
                n_tokens, n_docs = len(ids) // 4, n_docs + 1
                names[n_docs] = (doc_id, n_tokens)
                whole = n_tokens - n_tokens % window
                for start in range(0, whole, window):
                    written([(n_docs, start, ids[4 * start:4 * (start + window)])])
                if whole == n_tokens:
                    del names[n_docs]
                elif full := levels.place((n_docs, whole, ids[4 * whole:]), n_tokens - whole):
                    written(full)
                    for number in {p[0] for p in full}:
                        del names[number]
                if levels.n_open > max_open:
                    settle()
                if size > 4_000_000:
                    yield flushed()
        settle()
        yield flushed()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024,
                   vocabulary: str | None = None, max_open: int = 8192) -> DataFrame:
    """Pieces (``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``) of all documents.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers, the end id 0 behind each document included.
    ``start`` counts the ids of the document before the piece, ``offset`` those of the sequence before it.
    """
    if window < 1:
        raise ValueError("window must be positive")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    arrow = pa.schema([*((n, pa.int64()) for n in names), ("ids", pa.binary())])
    run = _pack_batches(window, vocabulary or default_vocabulary(), max_open, arrow)
    return shipped(rows).mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", ids binary")
