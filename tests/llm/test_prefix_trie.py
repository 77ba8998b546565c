import hashlib
import math
import random
import re
import zlib

import pytest

from swarmframe.llm.prefix_trie import numbered_turns, prefix_trie, trie_nodes, with_family_openings

SCHEMA = "conv_id long, turn long, role string, text string, depth long, x long, y long, a string, block int, words string, n long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows, n_partitions=3):
    return spark.createDataFrame([(*r, 1, 2, 3, "a", 4, "w", 5) for r in rows], SCHEMA).repartition(n_partitions)


def paths_of(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))  # as SQL divides negative numbers
        out[c] = paths.get(base, [])[:h] + own[h:]
    return out


def brute(paths):
    nodes = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for name, members in nodes.items():
        below = [n for n in nodes if n[:len(name)] == name]
        children = [n for n in below if len(n) == len(name) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        saved = sum((len(nodes[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(name))))
        rows.append((min(members), len(name), min(nodes[name[:-1]]) if name else None, len(members), len(children), len(leaves), saved,
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def result(df):
    assert sorted(df.columns) == sorted(COLUMNS)
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def conversations(rng, n=60):
    rows = []
    for c in range(n):
        said = [(rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "c", "d  e\nf", "", None, "long " * 5])) for _ in range(rng.randint(0, 6))]
        rows += [(c, k, *turn) for k, turn in enumerate(said)]
    rows += [(100 + c, k, "user", f"same {k}") for c in range(30) for k in range(3)]  # one conversation many times
    rows += [(200, k, "user", f"same {k}") for k in range(40)]  # a long one that begins like it
    rows += [(201, k, "user", f"same {k}" if k < 37 else "else") for k in range(45)]
    rows += [(None, 0, "user", "nobody"), (300, None, "user", "first"), (300, -5, "user", "second"), (300, 1, "b", "tie"), (300, 1, "b", "tie"),
             (300, 1, "a", "tie"), (-20, 0, "user", "below"), (-21, 0, "user", "zero"), (-21, 1, "user", "zero")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_size": 2, "max_conversations": 5}, {"block_size": 7, "max_rows": 10}])
def test_trie_equals_brute_force(spark, sizes):
    rows = conversations(random.Random(4))
    assert result(prefix_trie(table(spark, rows), **sizes)) == brute(paths_of(rows))


def test_rebuilt_conversations_equal_brute_force(spark):
    rows = [(c, t, r, x) for c, t, r, x in conversations(random.Random(9), 90) if c not in (40, 60)]  # families without a base
    turns, ids = with_family_openings(numbered_turns(table(spark, rows)))
    paths = rebuilt(paths_of(rows))
    assert any(not turns for turns in paths.values())
    assert result(trie_nodes(turns, ids, block_size=4, max_conversations=8)) == brute(paths)


def test_every_conversation_one_longer_than_the_one_before(spark):
    """Paths of the trie hang below one another as deep as there are conversations."""
    rows = [(c, k, "user", f"t {k}") for c in range(25) for k in range(c)] + [(50, 0, "user", "t 0")]
    assert result(prefix_trie(table(spark, rows), block_size=8)) == brute(paths_of(rows))


def test_no_conversations(spark):
    assert result(prefix_trie(table(spark, []))) == []
    assert result(prefix_trie(table(spark, [(None, 1, "a", "b")]))) == []
