"""Prefix trie of conversations with vertical bitmaps.

Turns become numbers before they move: two hashes of role and text, a word count, a position. Conversations are cut into shards:
a range of conversation ids and a block of ``BLOCK`` positions, so neither many conversations nor a single endless one is too
large for a task. A shard indexes every (position, turn) as a bitset of its conversations. A node is a bitset of members; going
down, the turn of its first remaining member names a posting, and the intersection of parent and posting is the child. Popcounts give
members, the lowest bit the smallest member, the intersection with the bitset of conversations that end at a position the end list.

A node is named by its depth and the exclusive or of two hashes of each (position, turn) above it, so nodes of different shards
meet: members add up, end lists follow each other by the id ranges of the shards and are digested as a stream. A block below the first begins at the
nodes that the exclusive or of the blocks above it names.

Sums over subtrees need no walk. All nodes with one smallest member lie on one path down (once it is the smallest it stays so), so
the trie is a tree of such paths. Totals of paths are found by pointer doubling, in as many rounds as the logarithm of the
number of paths above one another; within a path a running sum from below, in chunks, adds what hangs at each node.

Cases: rows with a null conversation id take no part; a null turn comes first; turns of equal number follow role and a hash of the
text; a null role or text is empty; repeated rows are turns of their own; a conversation without turns is a member of the root; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.plans.scan import running

from .common import WORD_PATTERN, settled, shipped, text_or_empty

BLOCK = 256
SHARD_CONVERSATIONS = 4096
SHARD_ROWS = 65_536
NAME = ["depth", "x", "y"]
_PARTS = ("depth long, x long, y long, parent_x long, parent_y long, conv_id long, n_convs long, words long, shard long, ends string")


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(``conv_id``, ``pos``, ``turn_a``, ``turn_b``, ``words``): turns numbered from 0, as two hashes and a word count.

    Positions come from counts per (conversation, turn number) summed in chunks: no task numbers a whole conversation.
    """
    c = conversations
    raw = c.select(c[conv_col].cast("long").alias("conv_id"), c[turn_col].cast("long").alias("turn"),
                   c[role_col].cast("string").alias("role"), c[text_col].cast("string").alias("text")).where("conv_id IS NOT NULL")
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = raw.select("conv_id", "turn", role.alias("role"), F.xxhash64(role, text).alias("turn_a"),
                      F.xxhash64(F.lit(1), text, role).alias("turn_b"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words"))
    counts = running(rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")), ["conv_id"], "turn", {"n": "before"}, exclusive=True,
                     aggregated=True).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "before")
    among = Window.partitionBy("conv_id", "turn").orderBy("role", "turn_a", "turn_b")
    placed = rows.withColumn("place", F.row_number().over(among) - 1)
    joined = placed.join(counts, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")))
    return joined.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("place")).cast("long").alias("pos"), "turn_a", "turn_b", "words")


class Shard:
    """Bitsets of the conversations of one shard: postings per (position, turn), who goes on at a position, who ends there."""

    def __init__(self, block: int, block_size: int):
        self.first, self.begins_at = block == 0, block * block_size
        self.ids: list[int] = []
        self.turns: list[list[tuple[int, int, int]]] = []
        self.postings: dict[tuple[int, int], int] = {}
        self.present: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.starts: dict[tuple[int, int], int] = {}
        self.rows = 0

    def add(self, conv: int, start: tuple[int, int], last: bool, turns: list[tuple[int, int, int]]) -> None:
        """A conversation's turns (two hashes that hold the position too, and words) in this block, ids ascending."""
        bit = 1 << len(self.ids)
        self.ids.append(conv)
        self.turns.append(turns)
        self.starts[start] = self.starts.get(start, 0) | bit
        for k, (a, b, _) in enumerate(turns):
            self.postings[a, b] = self.postings.get((a, b), 0) | bit
            self.present[k] = self.present.get(k, 0) | bit
        if last:
            self.ends[len(turns)] = self.ends.get(len(turns), 0) | bit
        self.rows += len(turns) + 1

    def smallest(self, members: int) -> int:
        return (members & -members).bit_length() - 1

    def listed(self, members: int) -> str | None:
        out = []
        while members:
            k = self.smallest(members)
            out.append(str(self.ids[k]))
            members &= members - 1
        return ",".join(out) if out else None

    def nodes(self) -> Iterator[tuple]:
        """Nodes of the shard, depth first: depth, name, parent's name, smallest member, members, words, shard, end list."""
        shard = self.ids[0]
        if self.first:
            everyone = (1 << len(self.ids)) - 1
            yield (0, 0, 0, None, None, shard, len(self.ids), 0, shard, self.listed(everyone & self.ends.get(0, 0)))
        stack = [(members, 0, x, y) for (x, y), members in self.starts.items()]
        while stack:
            members, k, x, y = stack.pop()
            rest = members & self.present.get(k, 0)
            while rest:
                i = self.smallest(rest)
                a, b, words = self.turns[i][k]
                child = rest & self.postings[a, b]
                rest ^= child
                yield (self.begins_at + k + 1, x ^ a, y ^ b, x, y, self.ids[i], child.bit_count(), words, shard,
                       self.listed(child & self.ends.get(k + 1, 0)))
                stack.append((child, k + 1, x ^ a, y ^ b))


def _shard_nodes(block_size: int, max_conversations: int, max_rows: int):
    names = [field.split()[0] for field in _PARTS.split(", ")]
    types = [pa.string() if field.endswith("string") else pa.int64() for field in _PARTS.split(", ")]

    def record(shard: Shard) -> Iterator[pa.RecordBatch]:
        rows = list(shard.nodes())
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at:at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, current, turns = None, None, None, []
        for batch in batches:
            for at, conv, pos, a, b, words, start_x, start_y, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or (at, conv) != (block, current[0]):
                    if current is not None:
                        shard.add(*current, turns)
                    if shard is None or at != block or len(shard.ids) >= max_conversations or shard.rows >= max_rows:
                        if shard is not None:
                            yield from record(shard)
                        shard = Shard(at, block_size)
                    block, current, turns = at, (conv, (start_x, start_y), last), []
                if pos >= 0:
                    turns.append((a, b, words))
        if current is not None:
            shard.add(*current, turns)
            yield from record(shard)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end lists, which follow each other in order; nothing but the running digest is kept."""
    group, digest = None, None
    for batch in batches:
        out = []
        for depth, x, y, _, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, x, y) != group:
                if group is not None:
                    out.append((*group, digest.hexdigest()))
                group, digest = (depth, x, y), hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield _digest_rows(out)
    if group is not None:
        yield _digest_rows([(*group, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*NAME, "ends_sha256"])


def _sharded(turns: DataFrame, ids: DataFrame, block_size: int) -> DataFrame:
    """Turns and one row per conversation (position -1), with the name of the node its block begins at, in shard order."""
    pos, a, b = F.col("pos"), F.col("turn_a"), F.col("turn_b")
    items = turns.select("conv_id", "pos", F.xxhash64(pos, a, b).alias("a"), F.xxhash64(b, pos, a).alias("b"), "words")
    empty = F.lit(None).cast("long")
    items = items.unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("pos"), empty.alias("a"), empty.alias("b"),
                                         F.lit(0).cast("long").alias("words")))
    items = items.withColumn("block", F.floor(F.greatest(F.col("pos"), F.lit(0)) / block_size))
    blocks = items.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    # one row per conversation and block
    along = Window.partitionBy("conv_id").orderBy("block")
    above = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.bit_xor("a").over(above), F.lit(0)).alias("start_x"),
                           F.coalesce(F.bit_xor("b").over(above), F.lit(0)).alias("start_y"),
                           F.lead("block").over(along).isNull().alias("last"))
    rows = items.join(blocks, ["conv_id", "block"]).select("block", "conv_id", "pos", "a", "b", "words", "start_x", "start_y", "last")
    return rows.repartitionByRange("block", "conv_id").sortWithinPartitions("block", "conv_id", "pos")


def merged_nodes(turns: DataFrame, ids: DataFrame, block_size: int = BLOCK, max_conversations: int = SHARD_CONVERSATIONS,
                 max_rows: int = SHARD_ROWS) -> DataFrame:
    """(``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``words``, ``ends_sha256``) per node."""
    parts = settled(shipped(_sharded(turns, ids, block_size)).mapInArrow(_shard_nodes(block_size, max_conversations, max_rows), _PARTS))
    nodes = parts.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"),
                                     F.max("parent_x").alias("parent_x"), F.max("parent_y").alias("parent_y"))
    nodes = settled(nodes)
    ends = parts.where("ends IS NOT NULL").select(*NAME, "shard", "ends").repartition(*NAME).sortWithinPartitions(*NAME, "shard")
    digests = shipped(ends).mapInArrow(_digests, "depth long, x long, y long, ends_sha256 string")
    above = [(F.col("depth") - 1).alias("depth"), F.col("parent_x").alias("x"), F.col("parent_y").alias("y")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    whole = nodes.join(children, NAME, "left").join(digests, NAME, "left")
    parents = nodes.select((F.col("depth") + 1).alias("d"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    whole = whole.join(parents, (F.col("depth") == F.col("d")) & (F.col("parent_x") == F.col("px")) & (F.col("parent_y") == F.col("py")), "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "words",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def subtree_sums(nodes: DataFrame, values: dict[str, str]) -> DataFrame:
    """Add to nodes (``conv_id``, ``depth``, ``parent_conv_id``) the sum of each ``values[column] -> name`` over their subtrees.

    Paths are the nodes of one ``conv_id``. Every round doubles how far up a path's total has been carried.
    """
    columns = list(values)
    totals = nodes.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in columns])
    tops = nodes.where("parent_conv_id IS NULL OR parent_conv_id != conv_id").select(
        "conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("hangs_at"))
    paths = settled(tops.join(totals, "conv_id"))
    hung = paths.select("conv_id", F.col("up").alias("hung_on"), "hangs_at")
    while not paths.where("up IS NOT NULL").isEmpty():
        carried = paths.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        higher = paths.where("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("upper"))
        paths = settled(paths.join(carried, "conv_id", "left").join(higher, "up", "left").select(
            "conv_id", F.col("upper").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]))
    at_nodes = hung.where("hung_on IS NOT NULL").join(paths.select("conv_id", *columns), "conv_id").groupBy(
        F.col("hung_on").alias("conv_id"), F.col("hangs_at").alias("depth")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    own = nodes.join(at_nodes, ["conv_id", "depth"], "left").select(
        *[F.col(c) for c in nodes.columns if c not in columns], (-F.col("depth")).alias("_up"),
        *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns])
    summed = running(settled(own), ["conv_id"], "_up", values, how="sum")
    return summed.drop("_up", *columns)


def trie_nodes(turns: DataFrame, ids: DataFrame, **sizes: int) -> DataFrame:
    """The trie of numbered turns (as of ``numbered_turns``); ``ids`` (``conv_id``) names every conversation once, turnless ones too.

    One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (words that sharing saves in the subtree) and ``ends_sha256``.
    """
    nodes = merged_nodes(turns, ids, **sizes).withColumn("_leaf", (F.col("n_children") == 0).cast("long")).withColumn(
        "_saved", (F.col("n_convs") - 1) * F.col("words"))
    return subtree_sums(settled(nodes.drop("words")), {"_leaf": "n_leaves", "_saved": "saved_tokens"})


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", **sizes: int) -> DataFrame:
    """The trie of a conversation table as it stands."""
    turns = settled(numbered_turns(conversations, conv_col, turn_col, role_col, text_col))
    return trie_nodes(turns, turns.select("conv_id").distinct(), **sizes)


def with_family_openings(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of conversations rebuilt on the openings of their families.

    Conversation ``c`` takes the first ``h`` turns of conversation ``c - c % family``, then its own after its first ``h``, with
    ``h`` the crc32 of ``c`` as text modulo ``most``.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    h = F.crc32(F.col("conv_id").cast("string")) % most
    ids = turns.select("conv_id").distinct()
    openings = turns.where((F.col("conv_id") == base) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_a", "turn_b", "words"))).alias("opening"))  # at most ``most`` turns
    taken = ids.select("conv_id", base.alias("base"), h.alias("h")).join(openings, "base").select(
        "conv_id", F.inline(F.slice("opening", F.lit(1), F.col("h").cast("int"))))
    lengths = openings.select("base", F.size("opening").alias("n"))
    own = turns.select("*", base.alias("base"), h.alias("h")).where("pos >= h").join(lengths, "base", "left").select(
        "conv_id", (F.least(F.col("h"), F.coalesce("n", F.lit(0))) + F.col("pos") - F.col("h")).alias("pos"), "turn_a", "turn_b", "words")
    return taken.unionByName(own), ids
