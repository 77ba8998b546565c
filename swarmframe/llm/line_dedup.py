"""Lines that many documents share, dropped with DataFrame functions only.

Every line gets a 128-bit hash of its key (stripped, A-Z folded). Hashes are combined per (hash, salt) before they move, so
a line of every document is a few rows; those are range-partitioned by hash, sorted by hash and document, and streamed:
running sums give the number of documents, the first row the first occurrence. Decisions come back as a compressed
bitmap per document, ``drops``: only its non-zero words, each (word number, 63 bits). Texts are joined with the bitmaps
by (id, text hash) and filtered in place; they are never exploded.

``keep_copies`` changes the rule for copies: a document that would lose more than half of its characters is a copy of a text
that many hold, and of the copies that hold a line the first (least id, null last) keeps it, wherever the line stands in it.
So a text stays once however often it was copied; lines shared by documents with text of their own still go from all of them.

Cases: a null or empty text is one empty line; lines whose key is shorter than ``min_chars`` are kept always; repeated rows
count as documents each; null ids are matched by text; if every line goes, the text is empty; an empty table gives an empty
result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, fresh, settled, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BITS = 63


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the quick way where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE_CHARS)))


def _key_hashes(lines: Column, min_chars: int) -> Column:
    """Per line the hash of its key; null where the key is too short."""
    def one(line: Column) -> Column:
        trimmed = F.trim(line, F.lit(SPACE_CHARS))
        return F.when(F.char_length(trimmed) >= min_chars, F.unhex(F.md5(ascii_lower(trimmed))))
    return F.transform(lines, one)


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
                 salts: int = 16) -> DataFrame:
    """(``hash``, ``n_docs``, ``first_id``) of the lines that ``min_docs`` or more documents hold."""
    return _shared(_hashes(docs, id_col, text_col, min_chars), min_docs, salts)


def _hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"),
                       _key_hashes(F.split(text_or_empty(text_col), "\n"), min_chars).alias("hashes"), *more)


def _shared(hashes: DataFrame, min_docs: int, salts: int) -> DataFrame:
    lines = hashes.select("id", F.pmod(F.xxhash64("id", "text_key"), F.lit(salts)).alias("salt"),
                          F.explode(F.array_distinct("hashes")).alias("hash")).where("hash IS NOT NULL")
    some = lines.groupBy("hash", "salt").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    ranged = some.repartitionByRange("hash").sortWithinPartitions("hash", "first_id")
    of_hash = Window.partitionBy("hash")
    ordered = of_hash.orderBy(F.col("first_id").asc_nulls_last())
    return ranged.withColumns({"n_docs": F.sum("n").over(of_hash), "nth": F.row_number().over(ordered)}).where(
        (F.col("nth") == 1) & (F.col("n_docs") >= min_docs)).select("hash", "n_docs", "first_id")


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
                 salts: int = 16, keep_copies: bool = False) -> DataFrame:
    """(``id``, ``text_key``, ``drops``) of the documents that lose lines.

    ``drops``: array of (``word``, ``bits``); bit k of word w is set if line ``63 * w + k`` goes. Words without a bit are left out.
    With ``keep_copies``, the first of the documents that would lose most of their text keeps the lines that they share.
    """
    sizes = F.transform(F.split(text_or_empty(text_col), "\n"), F.char_length).alias("sizes")
    hashes = settled(_hashes(docs, id_col, text_col, min_chars, *[sizes] * keep_copies))
    shared = _shared(hashes, min_docs, salts).select("hash")
    # rows that repeat an id and a text get one bitmap
    lines = hashes.select("id", "text_key", *["sizes"] * keep_copies, F.posexplode("hashes").alias("pos", "hash")).where("hash IS NOT NULL")
    word, bit = F.floor(F.col("pos") / WORD_BITS).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % WORD_BITS).cast("int"))
    if keep_copies:
        total = F.aggregate("sizes", F.lit(0).cast("long"), lambda n, size: n + size)
        lines = lines.select("id", "text_key", "pos", "hash", F.get("sizes", F.col("pos")).alias("size"), total.alias("total"))
        hit = settled(lines.join(shared, "hash").distinct())
        kept = _first_copies(hit).select("id", "text_key", F.explode("places").alias("pos"))
        both = hit.select("id", "text_key", "pos", F.lit(False).alias("stays")).unionByName(kept.withColumn("stays", F.lit(True)))
        words = both.groupBy("id", "text_key", word.alias("word")).agg(
            F.bit_or(bit).alias("all"), F.coalesce(F.bit_or(F.when(F.col("stays"), bit)), F.lit(0).cast("long")).alias("stay"))
        words = words.select("id", "text_key", "word", F.col("all").bitwiseXOR(F.col("stay")).alias("bits")).where("bits <> 0")
    else:
        hit = lines.join(shared, "hash").select("id", "text_key", "pos").distinct()
        words = hit.groupBy("id", "text_key", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("id", "text_key").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def _first_copies(hit: DataFrame) -> DataFrame:
    """(``id``, ``text_key``, ``places``) per line of copies: the first copy that holds it, and where the line stands in it."""
    lost = hit.groupBy("id", "text_key").agg(F.sum("size").alias("lost"), F.max("total").alias("total"),
                                             F.collect_list(F.struct("hash", "pos")).alias("lines"))
    copies = lost.where(2 * F.col("lost") > F.col("total")).select("id", "text_key", F.inline("lines"))
    placed = copies.groupBy("id", "text_key", "hash").agg(F.collect_list("pos").alias("places"))
    holder = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "places")
    return placed.groupBy("hash").agg(F.min(holder).alias("first")).select("first.id", "first.text_key", "first.places")


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int | bool) -> DataFrame:
    """All rows and columns of ``docs`` with ``line_drops`` (null: none), ``n_lines``, ``n_dropped`` and ``kept_text``."""
    drops, n_lines, n_dropped, kept = fresh(docs, "line_drops", "n_lines", "n_dropped", "kept_text")
    bitmaps = drop_bitmaps(docs, id_col, text_col, **options)
    text = text_or_empty(text_col)
    joined = docs.join(bitmaps, F.col(id_col).cast("long").eqNullSafe(bitmaps["id"])
                       & (F.xxhash64(docs[text_col]) == bitmaps["text_key"]), "left")
    joined = joined.select(*[docs[c] for c in docs.columns], bitmaps["drops"].alias(drops))
    as_map = F.map_from_entries(F.col(drops))

    def stays(_: Column, i: Column) -> Column:
        bits = F.coalesce(F.try_element_at(as_map, F.floor(i / WORD_BITS).cast("int")), F.lit(0).cast("long"))
        return F.call_function("shiftright", bits, (i % WORD_BITS).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 0

    dropped = F.coalesce(F.aggregate(F.col(drops), F.lit(0).cast("long"), lambda n, d: n + F.bit_count(d["bits"])), F.lit(0).cast("long"))
    return joined.withColumns({
        n_lines: (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        n_dropped: dropped,
        kept: F.when(F.col(drops).isNull(), text).otherwise(
            F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))})
