"""Each operator of this subpackage as a query over its whole table, with the same result in SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster_report
from .common import held_out, scratch_folder, settled
from .exact_dedup import exact_duplicates
from .language import fit_language_model, predict_languages
from .line_dedup import drop_shared_lines
from .minhash import near_duplicate_groups
from .mixing import mix_sources
from .neighbours import nearest
from .packing import pack_documents
from .page_text import main_texts
from .prefix_trie import numbered_turns, trie_nodes, with_family_openings
from .simhash import simhash_groups
from .token_files import token_index, write_token_files
from .toxicity import fit_toxicity_model, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_table(spark, sf_dir, "documents"), window=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(_table(spark, sf_dir, "documents"), words=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the documents, by a hash of the id, is the snapshot; the other half is the batch that comes in."""
    docs = _table(spark, sf_dir, "documents")
    rows = exact_duplicates(docs, old=F.xxhash64("doc_id") % 2 == 0)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH hashed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM hashed WINDOW g AS (PARTITION BY text_sha256)
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, source,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
classed AS (
  SELECT *, (4 * (length(bin(size + 1)) - 1) + floor((size + 1) * 4 / 2.0::DOUBLE ** (length(bin(size + 1)) - 1)) - 4)::INT AS class,
         (('0x' || substr(h, 1, 6))::BIGINT % 16)::INT AS chunk
  FROM sized),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, chunk, size, h, doc_id) AS place FROM classed),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
capped AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
filled AS (SELECT *, cap / weight <= level AS is_full FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full OR max(CASE WHEN NOT is_full THEN level END) OVER () IS NULL THEN cap
              ELSE max(CASE WHEN NOT is_full THEN level END) OVER () * weight END AS target
  FROM filled),
joined AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
         ('0x' || substr(md5('offset ' || coalesce(p.source, '') || CASE WHEN p.source IS NULL THEN 'false' ELSE 'true' END), 1, 8))::BIGINT
           / 4294967296.0::DOUBLE AS u
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(e * place + u) - floor(e * (place - 1) + u))::BIGINT * size)::BIGINT AS taken
FROM joined
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_shared_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT d, doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT d) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key
GROUP BY d, doc_id
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_language_model(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity_model(docs, _table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_texts(_table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(_table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def _op11_round(i: int) -> str:
    return f"""
near{i} AS (
  SELECT r, vec_id, v, k, d FROM (
    SELECT r, vec_id, v, k, list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c) AS d FROM vectors, cent{i})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1),
sums{i} AS (
  SELECT k, j, sum(x::HUGEINT) AS s, count(*)::HUGEINT AS n
  FROM (SELECT k, unnest(v)::BIGINT AS x, unnest(range(64)) AS j FROM near{i}) GROUP BY k, j),
mean{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS c FROM sums{i} GROUP BY k),
cent{i + 1} AS (SELECT k, coalesce(m.c, o.c) AS c FROM cent{i} o LEFT JOIN mean{i} m USING (k))"""


OP11_SQL = f"""
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = 64),
cent0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v AS c
  FROM (SELECT sha256('2:' || vec_id) AS h, v FROM vectors ORDER BY h NULLS LAST, v LIMIT 40)),{",".join(map(_op11_round, range(6)))}
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM near5 JOIN cent5 USING (k)
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf_dir, "documents"), words=4, percent=80)


OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT r, s FROM (
    SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s
    FROM words)),
sets AS MATERIALIZED (SELECT r, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS k FROM shingles GROUP BY r),
classes AS MATERIALIZED (SELECT k, min(n) AS n, min(r) AS c FROM sets GROUP BY k),
first_shingles AS (SELECT c, n, s FROM classes JOIN shingles ON c = r),
links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM first_shingles a JOIN first_shingles b USING (s)
  WHERE a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c, c AS x FROM classes UNION SELECT c, b FROM reach JOIN both_ways ON x = a),
first_ids AS (SELECT c, min(doc_id) AS first_id FROM classes JOIN sets USING (k) JOIN words USING (r) GROUP BY c),
named AS (SELECT reach.c, min(first_id) AS component_id FROM reach JOIN first_ids f ON reach.x = f.c GROUP BY reach.c)
SELECT doc_id, coalesce(s.n, 0) AS n_shingles, CASE WHEN s.n > 0 THEN component_id ELSE doc_id END AS component_id,
       doc_id IS NOT DISTINCT FROM CASE WHEN s.n > 0 THEN component_id ELSE doc_id END AS kept
FROM words LEFT JOIN sets s USING (r) LEFT JOIN classes k ON s.k = k.k LEFT JOIN named ON k.c = named.c
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = with_family_openings(settled(numbered_turns(_table(spark, sf_dir, "conversations"))))
    return trie_nodes(turns, ids)


# crc32 of a decimal number, eight shifts for each byte
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda d: [ord(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, b: xor(xor(x, b) >> 1, 3988292384::BIGINT * (xor(x, b) & 1))), 4294967295::BIGINT)"""

OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 20 AS base, {_CRC32} % 4 AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT i.c, 0 AS part, pos, role, text FROM ids i JOIN turns t ON t.c = i.base AND pos < h
  UNION ALL
  SELECT i.c, 1, pos, role, text FROM ids i JOIN turns t ON t.c = i.c AND pos >= h),
placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, sha256(role || chr(0) || text) AS turn,
         len(regexp_extract_all(text, '[^ 	-]+')) AS words
  FROM rebuilt),
paths AS (
  SELECT c, 0 AS depth, '' AS path, 0 AS words FROM ids
  UNION ALL
  SELECT c, depth, sha256(string_agg(turn, ',') OVER (PARTITION BY c ORDER BY depth)) AS path, words FROM placed),
nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words FROM paths GROUP BY path, depth),
steps AS (SELECT DISTINCT p.path, q.path AS parent FROM paths p JOIN paths q ON p.c = q.c AND q.depth = p.depth - 1),
childless AS (SELECT n.*, s.parent, (SELECT count(*) FROM steps k WHERE k.parent = n.path) AS n_children
              FROM nodes n LEFT JOIN steps s ON n.path = s.path),
subtrees AS (
  SELECT a.path, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
  FROM childless n JOIN paths a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY a.path),
last_nodes AS (SELECT c, arg_max(path, depth) AS path FROM paths GROUP BY c),
ends AS (SELECT path, sha256(string_agg(c, ',' ORDER BY c)) AS ends_sha256 FROM last_nodes GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM childless n JOIN subtrees USING (path) LEFT JOIN nodes p ON n.parent = p.path LEFT JOIN ends e ON e.path = n.path
"""


QUERIES = {
    "op1_packing": (op1_packing, None),
    "op2_simhash": (op2_simhash, None),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_mixing": (op4_mixing, OP4_SQL),
    "op5_line_dedup": (op5_line_dedup, OP5_SQL),
    "op6_language": (op6_language, None),
    "op7_token_files": (op7_token_files, None),
    "op8_neighbours": (op8_neighbours, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_page_text": (op10_page_text, None),
    "op11_centroids": (op11_centroids, OP11_SQL),
    "op12_minhash": (op12_minhash, OP12_SQL),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
