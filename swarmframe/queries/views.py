"""Camera-fleet tables derived from the given test tables, once for Spark and once as SQL for the check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmframe.functions.bytes import with_f64_bytes
from swarmframe.functions.text import frame_key
from swarmframe.operators.dataset import union_scans
from swarmframe.operators.sync import tick_of

HOUR = 3600.0
ORIGIN = "2024-01-01 00:00:00"
ORIGIN_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the tables hold UTC wall-clock times
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# -- arrivals from events -------------------------------------------------------------------------------------

def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals_of(table(spark, sf_dir, "events"))


def arrivals_of(events: DataFrame) -> DataFrame:
    late = F.when(F.col("event_id") % 7 == 0, 2).otherwise(0)
    at = F.col("ts").cast("timestamp")
    return events.select(
        # a session lasts ten days
        (F.floor(tick_of(at, HOUR, ORIGIN_US) / 240) + 1).cast("bigint").alias("session_id"), F.col("event_id").alias("packet_id"),
        (F.col("user_id") % 8 + 1).cast("int").alias("drone_id"),
        F.greatest(F.lit(0).cast("bigint"), tick_of(at, HOUR, ORIGIN_US) - late).alias("frame_num"),
        at.alias("arrival_ts"), (F.col("event_type") == "error").alias("failed"),
        F.round(F.col("value") * 1024).cast("bigint").alias("packet_bytes"))


def good_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals(spark, sf_dir).filter(~F.col("failed"))


ARRIVALS = """
arrivals AS (
  SELECT CAST((epoch_us(ts) - 1704067200000000) // 3600000000 // 240 + 1 AS BIGINT) AS session_id, event_id AS packet_id, CAST(user_id % 8 + 1 AS BIGINT) AS drone_id,
         greatest(0, (epoch_us(ts) - 1704067200000000) // 3600000000
                     - CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END) AS frame_num,
         ts AS arrival_ts, (epoch_us(ts) - 1704067200000000) // 3600000000 AS tick,
         event_type = 'error' AS failed, CAST(round(value * 1024) AS BIGINT) AS packet_bytes
  FROM events),
good AS (SELECT * FROM arrivals WHERE NOT failed)"""

# The replay as written down for a poll at the end of each tick: running maximum over ticks.
REPLAY = ARRIVALS + """,
peaks AS (SELECT session_id, tick, max(frame_num) AS peak FROM good GROUP BY ALL),
polls AS (
  SELECT session_id, tick, max(peak) OVER w AS shown,
         coalesce(max(peak) OVER (PARTITION BY session_id ORDER BY tick
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before
  FROM peaks WINDOW w AS (PARTITION BY session_id ORDER BY tick)),
outcomes AS (
  SELECT g.*, p.shown, p.before,
         CASE WHEN frame_num <= before THEN 'late' WHEN frame_num = shown THEN 'displayed'
              ELSE 'superseded' END AS outcome
  FROM good g JOIN polls p USING (session_id, tick)),
members AS (
  SELECT session_id, tick, frame_num, drone_id, arg_max(packet_id, (arrival_ts, packet_id)) AS packet_id
  FROM outcomes WHERE outcome = 'displayed' GROUP BY ALL),
sets AS (
  SELECT session_id, tick, frame_num, count(*) AS n_drones, list(drone_id) AS drones FROM members GROUP BY ALL)"""


# -- calibration from embeddings ------------------------------------------------------------------------------

def _scaled(i: int) -> Column:
    # whole numbers, so that both engines print the same text
    return F.round(F.get("embedding", F.lit(i)).cast("double") * 1_000_000).cast("bigint")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, drone_id, frame_num, rvec and tvec (doubles), k_text (9 numbers), dist_text (0 to 7 numbers)."""
    vec = table(spark, sf_dir, "embeddings")
    dist = F.slice(F.array(*[_scaled(i) for i in range(15, 22)]).cast("array<string>"), F.lit(1),
                   (F.col("vec_id") % 8).cast("int"))
    return vec.select(
        "vec_id", (F.col("vec_id") % 8 + 1).cast("int").alias("drone_id"),
        F.floor(F.col("vec_id") / 8).cast("bigint").alias("frame_num"), "label",
        F.array(*[F.get("embedding", F.lit(i)).cast("double") for i in range(3)]).alias("rvec"),
        F.array(*[F.get("embedding", F.lit(i)).cast("double") for i in range(3, 6)]).alias("tvec"),
        F.concat_ws(" ", F.array(*[_scaled(i) for i in range(6, 15)]).cast("array<string>")).alias("k_text"),
        F.concat_ws(" ", dist).alias("dist_text"))


def vector_bytes(df: DataFrame, columns: tuple[str, ...] = ("rvec", "tvec")) -> DataFrame:
    """Replace arrays of three doubles by their 24 bytes."""
    flat = df.select("*", *[F.get(c, F.lit(i)).alias(f"_{c}{i}") for c in columns for i in range(3)])
    coded = with_f64_bytes(flat, {f"_{c}{i}": f"_{c}{i}_bytes" for c in columns for i in range(3)})
    return coded.select(*[F.concat(*[f"_{c}{i}_bytes" for i in range(3)]).alias(c) if c in columns else F.col(c)
                          for c in df.columns])


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing rows for the packer: a small marked JPEG body, a send time and the calibration of each vector."""
    cal = vector_bytes(calibration(spark, sf_dir))
    return cal.select(
        F.lit(1).cast("bigint").alias("session_id"), F.col("vec_id").alias("packet_id"), "drone_id",
        (F.col("frame_num") % 1000).alias("frame_num"),
        (F.lit(1_700_000_000.25) + F.col("vec_id") / 8).alias("ts"),
        F.concat(F.lit(b"\xff\xd8"), F.encode(F.repeat(F.lit("pixel"), (F.col("vec_id") % 9).cast("int")), "UTF-8"),
                 F.lit(b"\xff\xd9")).alias("jpeg"),
        "rvec", "tvec", F.when(F.col("vec_id") % 10 != 3, F.col("k_text")).alias("k_text"),
        F.col("dist_text"), ((F.col("vec_id") % 8 + F.when(F.col("vec_id") % 21 == 0, 1).otherwise(0)) % 8 + 1)
        .cast("int").alias("port_drone_id"))


def _scaled_sql(i: int) -> str:
    return f"CAST(round(CAST(embedding[{i + 1}] AS DOUBLE) * 1000000) AS BIGINT)"


CALIBRATION = f"""
calibration AS (
  SELECT vec_id, CAST(vec_id % 8 + 1 AS BIGINT) AS drone_id, vec_id // 8 AS frame_num, label,
         [{', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE)' for i in range(3))}] AS rvec,
         [{', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE)' for i in range(3, 6))}] AS tvec,
         [{', '.join(_scaled_sql(i) for i in range(6, 15))}] AS k,
         list_slice([{', '.join(_scaled_sql(i) for i in range(15, 22))}], 1, vec_id % 8) AS d
  FROM embeddings),
texts AS (SELECT *, array_to_string(k, ' ') AS k_text, array_to_string(d, ' ') AS dist_text FROM calibration)"""

PACKETS = CALIBRATION + """,
packets AS (
  SELECT *, vec_id AS packet_id, frame_num % 1000 AS frame, 1700000000.25 + vec_id / 8 AS sent,
         4 + 5 * (vec_id % 9) AS jpeg_size, CASE WHEN vec_id % 10 <> 3 THEN length(k_text) ELSE 0 END AS k_size,
         length(dist_text) AS dist_size,
         (vec_id % 8 + CASE WHEN vec_id % 21 = 0 THEN 1 ELSE 0 END) % 8 + 1 AS port
  FROM texts)"""


# -- labelled images from documents and labels ----------------------------------------------------------------

def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")

    def scan(rows: DataFrame, suffix: str) -> DataFrame:
        folder = F.concat(F.lit("D"), (F.col("doc_id") % 8 + 1).cast("string"))
        return rows.select(folder.alias("folder"), frame_key("doc_id").alias("stem"), F.lit(suffix).alias("suffix")) \
            .withColumn("path", F.concat("folder", F.lit("/"), "stem", "suffix"))

    return union_scans(scan(docs.filter(F.col("doc_id") % 5 != 0), ".png"),
                       scan(docs.filter((F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 7 == 0)), ".jpg"))


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "labels").select("doc_id")
    folder = F.concat(F.lit("D"), (F.col("doc_id") % 8 + 1).cast("string"))
    return found.select(folder.alias("folder"), frame_key("doc_id").alias("stem")).withColumn(
        "path", F.concat("folder", F.lit("/labels/"), "stem", F.lit(".txt")))


IMAGES = """
images AS (
  SELECT folder, stem, suffix, folder || '/' || stem || suffix AS path FROM (
    SELECT 'D' || (doc_id % 8 + 1) AS folder, printf('%04d', doc_id) AS stem, '.png' AS suffix
    FROM documents WHERE doc_id % 5 <> 0
    UNION ALL
    SELECT 'D' || (doc_id % 8 + 1), printf('%04d', doc_id), '.jpg'
    FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0)),
label_files AS (
  SELECT 'D' || (doc_id % 8 + 1) AS folder, printf('%04d', doc_id) AS stem,
         'D' || (doc_id % 8 + 1) || '/labels/' || printf('%04d', doc_id) || '.txt' AS path FROM labels),
labelled AS (
  SELECT i.*, l.path AS label_path,
         CASE WHEN folder = 'D7' THEN 'val' WHEN folder = 'D8' THEN 'test' ELSE 'train' END AS split
  FROM images i LEFT JOIN label_files l USING (folder, stem))"""


# -- boxes from lineitem --------------------------------------------------------------------------------------

def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    merged = line.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"),
        F.max("l_discount").alias("d"), F.max("l_extendedprice").alias("e"), F.max("l_tax").alias("t"))
    return merged.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("bigint").alias("box_id"),
        (F.col("l_linenumber") % 3).cast("int").alias("cls"), (F.col("p") % 11 == 0).alias("_mistaken"), (F.col("p") % 1440).cast("double").alias("x1"),
        (F.col("s") * 37 % 810).cast("double").alias("y1"), (F.col("q") + 20).alias("_size"),
        (F.col("d") * 100).alias("_shift"), (0.1 + (F.col("e") % 1000) / 1112).alias("conf"), "t")


def truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("image_id", "box_id", "cls", "x1", "y1", (F.col("x1") + F.col("_size")).alias("x2"),
                                        (F.col("y1") + F.col("_size")).alias("y2"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _boxes(spark, sf_dir).filter(F.col("t") != 0).withColumn("x1", F.col("x1") + F.col("_shift"))
    # some detections name another class; class 3 has no truth
    moved = moved.withColumn("cls", F.when(F.col("_mistaken"), F.col("cls") + 1).otherwise(F.col("cls")))
    return moved.select("image_id", "box_id", "cls", "x1", "y1", (F.col("x1") + F.col("_size")).alias("x2"),
                        (F.col("y1") + F.col("_size")).alias("y2"), "conf")


BOXES = """
merged AS (
  SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS box_id, CAST(l_linenumber % 3 AS INTEGER) AS cls,
         max(l_partkey) % 11 = 0 AS mistaken,
         CAST(max(l_partkey) % 1440 AS DOUBLE) AS x1, CAST(max(l_suppkey) * 37 % 810 AS DOUBLE) AS y1,
         max(l_quantity) + 20 AS size, max(l_discount) * 100 AS shift,
         0.1::DOUBLE + (max(l_extendedprice) % 1000) / 1112 AS conf, max(l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
truth AS (SELECT image_id, box_id, cls, x1, y1, x1 + size AS x2, y1 + size AS y2 FROM merged),
det AS (
  SELECT image_id, box_id, cls + CAST(mistaken AS INTEGER) AS cls, x1 + shift AS x1, y1, x1 + shift + size AS x2, y1 + size AS y2, conf
  FROM merged WHERE tax <> 0)"""

IOU = """
overlapping AS (
  SELECT *, CASE WHEN ua > 0 THEN ia / ua ELSE 0 END AS iou FROM (
    SELECT d.image_id, d.cls, d.box_id AS det_id, t.box_id AS truth_id, d.conf, ia,
           (d.x2 - d.x1) * (d.y2 - d.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - ia AS ua
    FROM det d JOIN truth t USING (image_id, cls),
         LATERAL (SELECT greatest(least(d.x2, t.x2) - greatest(d.x1, t.x1), 0)
                         * greatest(least(d.y2, t.y2) - greatest(d.y1, t.y1), 0) AS ia)))"""


# -- users, tokens and requests from customer and orders ------------------------------------------------------

def _address(key: Column) -> Column:
    return F.concat(F.lit("customer."), F.lpad(key.cast("string"), 9, "0"), F.lit("@example.com"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = ts(ORIGIN)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), _address(F.col("c_custkey")).alias("email"),
        F.concat(F.lit("h"), F.col("c_nationkey").cast("string")).alias("password_hash"),
        F.col("c_name").alias("full_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role"),
        at.alias("created_at"), at.alias("updated_at"))


def revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("token"), at.alias("blacklisted_at"),
        (at + F.expr("INTERVAL 60 MINUTES")).alias("expires_at"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    at = F.col("o_orderdate").cast("timestamp")
    target = who + key % 3
    route = F.element_at(F.array(*[F.lit(r) for r in ("add_user", "view_by_id", "view_by_email", "delete_user")]),
                         (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("request_id"), F.concat(F.lit("t"), key.cast("string")).alias("token"),
        (key % 13 != 0).alias("token_valid"),
        F.timestamp_micros(F.unix_micros(at) + (key % 7) * 600_000_000).alias("exp"),
        F.when(key % 17 != 0, who).alias("user_id"), _address(who).alias("email"),
        F.when(who % 5 == 0, "admin").otherwise("user").alias("role"), route.alias("route"),
        target.alias("target_id"), _address(target).alias("target_email"),
        (at + F.expr("INTERVAL 30 MINUTES")).alias("at"))


def sign_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"), F.when(key % 19 == 0, "nobody").otherwise(_address(F.col("o_custkey") * 2)).alias("email"),
        F.repeat(F.lit("x"), (key % 13 + 4).cast("int")).alias("password"),
        F.concat(F.lit("h"), key.cast("string")).alias("password_hash"),
        F.repeat(F.lit("n"), (key % 11 + 1).cast("int")).alias("full_name"),
        F.when(key % 3 == 0, "admin").alias("role"))


def removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 3).alias("id"))


def logouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens being revoked: some known, some repeated, some expired."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"), F.concat(F.lit("t"), F.floor(key / 2).cast("string")).alias("token"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 45 MINUTES")).alias("expires_at"))


_ADDRESS = "'customer.' || lpad(CAST({} AS VARCHAR), 9, '0') || '@example.com'"

ACCESS = f"""
users AS (
  SELECT c_custkey AS id, {_ADDRESS.format('c_custkey')} AS email, 'h' || c_nationkey AS password_hash,
         c_name AS full_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role,
         TIMESTAMP '{ORIGIN}' AS created_at, TIMESTAMP '{ORIGIN}' AS updated_at
  FROM customer),
revoked AS (
  SELECT 't' || o_orderkey AS token, o_orderdate AS blacklisted_at, o_orderdate + INTERVAL 60 MINUTE AS expires_at
  FROM orders WHERE o_orderstatus = 'F'),
requests AS (
  SELECT o_orderkey AS request_id, 't' || o_orderkey AS token, o_orderkey % 13 <> 0 AS token_valid,
         o_orderdate + to_minutes(CAST(o_orderkey % 7 * 10 AS INTEGER)) AS exp,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS user_id, {_ADDRESS.format('o_custkey')} AS email,
         CASE WHEN o_custkey % 5 = 0 THEN 'admin' ELSE 'user' END AS role,
         (['add_user', 'view_by_id', 'view_by_email', 'delete_user'])[o_orderkey % 4 + 1] AS route,
         o_custkey + o_orderkey % 3 AS target_id, {_ADDRESS.format('(o_custkey + o_orderkey % 3)')} AS target_email,
         o_orderdate + INTERVAL 30 MINUTE AS asked_at
  FROM orders),
sign_ups AS (
  SELECT o_orderkey AS seq,
         CASE WHEN o_orderkey % 19 = 0 THEN 'nobody' ELSE {_ADDRESS.format('(o_custkey * 2)')} END AS email,
         o_orderkey % 13 + 4 AS password_size, 'h' || o_orderkey AS password_hash,
         repeat('n', CAST(o_orderkey % 11 + 1 AS INTEGER)) AS full_name,
         CASE WHEN o_orderkey % 3 = 0 THEN 'admin' ELSE 'user' END AS role
  FROM orders),
removals AS (SELECT o_orderkey AS seq, o_custkey * 3 AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
logouts AS (
  SELECT o_orderkey AS seq, 't' || (o_orderkey // 2) AS token, o_orderdate + INTERVAL 45 MINUTE AS expires_at
  FROM orders)"""
