"""Byte-pair ids of whole texts with a public vocabulary, as bytes (little-endian unsigned 32-bit ids).

The vocabulary's splitting rule always cuts at certain places that single bytes show, so texts are cut there into pieces and
each distinct piece meets the tokenizer once: workers keep the ids of the pieces they have met in a hash table of numpy
arrays (a piece is known by 96 bits of two hashes of its bytes), and a batch of texts becomes one gather. Texts are never shortened.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

#: Pieces that a worker keeps (about 40 bytes each) and the bytes of the longest one that is kept.
KEPT_PIECES, KEPT_BYTES = 1_000_000, 48
END_ID = b"\x00\x00\x00\x00"

_ENCODERS: dict[str, Encoder] = {}


def _bytes_where(test) -> np.ndarray:
    return np.array([bool(test(i)) for i in range(256)])


_ASCII_SPACE = frozenset((9, 10, 11, 12, 13, 28, 29, 30, 31, 32))
# white space beyond ASCII begins with one of four bytes in UTF-8; no cut before any of them
_NO_SPACE_NEXT = _bytes_where(lambda i: i not in _ASCII_SPACE and i not in (0xC2, 0xE1, 0xE2, 0xE3))
_ASCII_TEXT = _bytes_where(lambda i: i < 128 and i not in _ASCII_SPACE)
_ASCII_WORD = _bytes_where(lambda i: i < 128 and chr(i).isalnum())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _powers(multiplier: int) -> np.ndarray:
    return np.array([pow(multiplier, k, 1 << 64) for k in range(KEPT_BYTES)], dtype=np.uint64)


_POWERS = _powers(0x9E3779B97F4A7C15), _powers(0xC2B2AE3D27D4EB4F)


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts laid end to end (``starts`` and ``ends`` of the texts that are not empty).

    Before a space that text follows; before a line end that ASCII text precedes; before a full stop or comma that an
    ASCII letter or digit precedes.
    """
    before, after = data[:-1], data[1:]
    cut = np.zeros(len(data), dtype=bool)
    cut[:-1] = (before == 32) & _NO_SPACE_NEXT[after]
    cut[ends - 1] = False
    cut[1:] |= (after == 10) & _ASCII_TEXT[before] | ((after == 46) | (after == 44)) & _ASCII_WORD[before]
    cut[starts] = True
    return np.flatnonzero(cut)


_LOW = np.uint64(0xFFFFFFFF)


class _Pieces:
    """Hash table to places in an array of ids; open addressing, rows are (hash, half of a second hash and place).

    A place is 26 bits of position in the array and 6 bits of length, which is never 0 and at most ``KEPT_BYTES``.
    """

    def __init__(self, bits: int = 16):
        self.rows, self.bits, self.n = np.zeros((1 << bits, 2), dtype=np.uint64), bits, 0
        self.ids, self.n_ids = np.zeros(1 << 18, dtype=np.uint16), 0

    def _slots(self, first: np.ndarray) -> np.ndarray:
        return (first >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Place per piece, 0 where it is not known."""
        out, slot = np.zeros(len(first), dtype=np.uint64), self._slots(first)
        at = np.arange(len(first))
        while len(at):
            row = self.rows[slot]
            same = (row[:, 0] == first[at]) & ((row[:, 1] ^ second[at]) <= _LOW) & (row[:, 1] != 0)
            out[at[same]] = row[same, 1] & _LOW
            on = ~same & (row[:, 1] != 0)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, first: np.ndarray, second: np.ndarray, places: np.ndarray) -> None:
        """Add distinct pieces that are not there."""
        if 2 * (self.n + len(first)) > 1 << self.bits:
            old = self.rows[self.rows[:, 1] != 0]
            self.bits = int(2 * (self.n + len(first))).bit_length()
            self.rows = np.zeros((1 << self.bits, 2), dtype=np.uint64)
            self._put(old[:, 0], old[:, 1])
        self._put(first, second & ~_LOW | places)
        self.n += len(first)

    def _put(self, first: np.ndarray, values: np.ndarray) -> None:
        slot, at = self._slots(first), np.arange(len(first))
        while len(at):
            free = np.flatnonzero(self.rows[slot, 1] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.rows[slot[won]] = np.stack([first[at[won]], values[at[won]]], axis=1)
            on = np.ones(len(at), dtype=bool)
            on[won] = False
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def append(self, ids: np.ndarray) -> int:
        """Add ids to the array; their place."""
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.n_ids], np.zeros(max(len(self.ids), 2 * len(ids)), dtype=np.uint16)])
        place = self.n_ids
        self.ids[place:place + len(ids)] = ids
        self.n_ids += len(ids)
        return place


class Encoder:
    """Ids of texts; special tokens' strings count as ordinary text."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        n = self.tokenizer.get_vocab_size()
        if n > 1 << 16:
            raise ValueError("the table of pieces holds 16-bit ids")
        # in a byte-level vocabulary each character of a token stands for one byte
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], dtype=np.int64)
        self.pieces = _Pieces()

    def plain(self, text: str) -> bytes:
        """Ids of one text, without cutting it."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of pieces, one after the other, how many each has, and the order in which they come."""
        ids, counts = [], []
        # one space or line end, then no white space: many such are one text, told apart by their lengths in bytes
        words = [i for i, p in enumerate(pieces) if p[0] in " \n" and p.split() == [p[1:]]]
        for at in range(0, len(words), 1000):
            some = [pieces[i] for i in words[at:at + 1000]]
            own = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint16)
            sizes = np.array([len(p) if p.isascii() else len(p.encode()) for p in some])
            stops = np.searchsorted(np.cumsum(self.n_bytes[own]), np.cumsum(sizes)) + 1
            ids.append(own)
            counts.append(np.diff(stops, prepend=0))
        chosen = set(words)
        others = [i for i in range(len(pieces)) if i not in chosen]
        for e in self.tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False):
            ids.append(np.array(e.ids, dtype=np.uint16))
            counts.append(np.array([len(ids[-1])]))
        return np.concatenate(ids), np.concatenate(counts), words + others

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        n = np.array([len(r) for r in raw], dtype=np.int64)
        joined = b"".join(raw)
        if not joined:
            return [b""] * len(texts)
        data, ends = np.frombuffer(joined, dtype=np.uint8), np.cumsum(n)
        begins = cuts(data, (ends - n)[n > 0], ends[n > 0])
        lengths = np.diff(np.append(begins, len(data)))
        # hashes of the pieces; what is too long to keep is hashed by its beginning and not looked up
        place = np.arange(len(data)) - np.repeat(begins, lengths)
        np.minimum(place, KEPT_BYTES - 1, out=place)
        wide = data.astype(np.uint64) + np.uint64(1)
        first, second = (np.add.reduceat(wide * p[place], begins) for p in _POWERS)
        first = (first ^ (first >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        short = np.flatnonzero(lengths <= KEPT_BYTES)
        if self.pieces.n > KEPT_PIECES:
            self.pieces = _Pieces()
        places = np.zeros(len(begins), dtype=np.uint64)
        places[short] = self.pieces.find(first[short], second[short])
        missing = short[places[short] == 0]
        while len(missing):
            one = missing[np.unique(first[missing], return_index=True)[1]]
            new, counts, order = self._ids([joined[b:b + k].decode() for b, k in zip(begins[one].tolist(), lengths[one].tolist(), strict=True)])
            one = one[order]
            start = self.pieces.append(new)
            at = (start + np.cumsum(counts) - counts).astype(np.uint64) << np.uint64(6) | counts.astype(np.uint64)
            self.pieces.add(first[one], second[one], at)
            places[missing] = self.pieces.find(first[missing], second[missing])
            missing = missing[places[missing] == 0]
        kept_ids = self.pieces.n_ids
        counts = (places & np.uint64(63)).astype(np.int64)
        source = (places >> np.uint64(6)).astype(np.int64)
        for i in np.flatnonzero(lengths > KEPT_BYTES).tolist():  # encoded on the spot
            own = np.frombuffer(self.plain(joined[begins[i]:begins[i] + lengths[i]].decode()), dtype="<u4")
            counts[i], source[i] = len(own), self.pieces.append(own)
        stops = np.cumsum(counts)
        ids = self.pieces.ids[np.repeat(source - (stops - counts), counts) + np.arange(stops[-1])].astype("<u4").tobytes()
        self.pieces.n_ids = kept_ids
        # pieces, and so ids, up to the end of each text
        until = np.append(0, stops)[np.searchsorted(begins, ends)] * 4
        return [ids[a:b] for a, b in zip([0, *until[:-1].tolist()], until.tolist(), strict=True)]


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def documents_ids(texts: Iterable[str | None], vocabulary: str, at_once: int = 500_000) -> Iterable[bytes]:
    """Ids of each document with the end id 0 behind them (null: the end id alone), about half a megabyte of text at a time."""
    own, some, size = encoder(vocabulary), [], 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1])
        if size >= at_once:
            yield from (ids + END_ID for ids in own.encode(some))
            some, size = [], 0
    yield from (ids + END_ID for ids in own.encode(some))
