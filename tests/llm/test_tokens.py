import random
import zlib

import pytest

from swarmframe.llm import tokens as T
from swarmframe.llm.packing import Levels, pack_documents
from swarmframe.llm.token_files import find_documents, token_index, write_token_files

VOCABULARY = T.default_vocabulary()


def ids_of(text):
    return T.encoder(VOCABULARY).plain(text or "") + T.END_ID


def test_pieces_give_the_ids_of_the_whole_text():
    rng = random.Random(5)
    signs = list(" ..,,ab Z\n\n\t19'’_é日\xa0-́!s\x1c\r") + [" a", " the", ". ", ", ", " Où", "　", " x"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["x" * 90 + " y" * 3000, "<|endoftext|> a", "é" * 60 + " b. c,d\n" * 40, ""]
    for text, ids in zip(texts, T.documents_ids(texts, VOCABULARY, at_once=20_000), strict=True):
        assert ids == ids_of(text), repr(text)


def test_a_full_table_of_pieces_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "KEPT_PIECES", 50)
    texts = [f"word{i} and other{i} thing" for i in range(300)]
    assert list(T.documents_ids(texts, VOCABULARY, at_once=500)) == [ids_of(t) for t in texts]


ROWS = [(1, "one two three"), (2, ""), (3, None), (4, "word " * 3000), (5, "one two three"), (5, "one two three"), (None, "no id"), (6, "x")]


@pytest.mark.parametrize("window", [1, 7, 64])
def test_packing_puts_each_id_in_one_piece(docs_of, window):
    pieces = pack_documents(docs_of(ROWS), window=window, max_open=3).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p["length"] * 4 == len(p["ids"]) > 0
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in set(ROWS):
        own = sorted(by_doc[doc_id], key=lambda p: p["start"])
        copies = sum(1 for r in ROWS if r[0] == doc_id)
        assert sum(p["length"] for p in own) == copies * len(ids_of(text)) // 4
        for p in own:
            assert bytes(p["ids"]) == ids_of(text)[4 * p["start"]:4 * (p["start"] + p["length"])]
            assert p["doc_tokens"] == len(ids_of(text)) // 4
    short = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        short += at < window
    assert short <= 2  # one window of a partition at most


def test_the_level_chosen_has_the_least_sum_of_squares():
    rng = random.Random(3)
    levels = Levels(16)
    for i in range(400):
        r = rng.randint(1, 15)
        counts = levels.count[1:16].tolist()
        costs = {}
        for h in range(0, 17 - r):
            if h == 0 or counts[h - 1]:
                after = list(counts)
                if h:
                    after[h - 1] -= 1
                if h + r < 16:
                    after[h + r - 1] += 1
                costs[h] = sum(c * c for c in after)
        assert costs[levels.best(r)] == min(costs.values())
        levels.place((i, 0, bytes(4 * r)), r)


def test_empty_table_packs_to_nothing(docs_of):
    assert pack_documents(docs_of(ROWS).limit(0)).collect() == []


def test_token_files_round_trip(spark, docs_of, tmp_path):
    path = str(tmp_path / "tokens")
    write_token_files(docs_of(ROWS, 4), path)
    rows = token_index(spark, path).orderBy("start").collect()
    start = 0
    for row, (doc_id, text) in zip(rows, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        assert row.asDict() == {"doc_id": doc_id, "start": start, "n_tokens": len(ids_of(text)) // 4, "ids_crc32": zlib.crc32(ids_of(text))}
        start += row["n_tokens"]
    found = find_documents(spark, path, [4, 77]).collect()
    assert [r["doc_id"] for r in found] == [4] and len(found[0]["ids"]) == found[0]["n_tokens"]


def test_empty_token_files(spark, docs_of, tmp_path):
    path = str(tmp_path / "none")
    write_token_files(docs_of(ROWS).limit(0), path)
    assert token_index(spark, path).collect() == []
