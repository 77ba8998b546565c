"""Detection queries over the boxes view."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmframe.functions.geometry import scale_box
from swarmframe.functions.text import detection_label
from swarmframe.operators import detections as D
from swarmframe.queries.views import ARRIVALS, BOXES, IOU, arrivals, detections, truth_boxes, ts


def _both(spark, sf):
    return detections(spark, sf), truth_boxes(spark, sf)


def filtered(spark, sf):
    return D.filter_conf(detections(spark, sf)).select("image_id", "box_id", F.round("conf", 9).alias("conf"))


def labels(spark, sf):
    box = F.struct("x1", "y1", "x2", "y2")
    return detections(spark, sf).select(
        "image_id", "box_id", scale_box(box, 0.75).alias("b"),
        scale_box(box, F.lit(480 / 1920), F.lit(270 / 1080)).alias("g"), detection_label("conf").alias("label")).select(
        "image_id", "box_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.round("g.x1", 6).alias("grid_x"), "label")


def matched(spark, sf):
    return D.match_boxes(*_both(spark, sf)).select("image_id", "det_id", "truth_id", F.round("iou", 9).alias("iou"))


def best(spark, sf):
    return D.best_detections(detections(spark, sf), 2).select("image_id", "box_id", "rank")


def suppressed(spark, sf):
    return D.nms(_shifted(spark, sf)).select("image_id", "box_id")


def _shifted(spark, sf):
    """Five orders share an image, and boxes are enlarged, so that suppression has something to do."""
    det = detections(spark, sf)
    return det.select(
        F.floor(F.col("image_id") / 5).cast("bigint").alias("image_id"),
        (F.col("image_id") % 5 * 100 + F.col("box_id")).alias("box_id"), "cls", "x1", "y1",
        (F.col("x2") + 400).alias("x2"), (F.col("y2") + 400).alias("y2"), "conf")


def _crowded(spark, sf):
    """Twenty orders share an image and boxes are enlarged, so that detections compete for truth boxes."""
    def merged(boxes):
        return boxes.withColumns({"box_id": F.col("image_id") % 20 * 100 + F.col("box_id"), "image_id": F.floor(F.col("image_id") / 20).cast("bigint"),
                                  "x2": F.col("x2") + 600, "y2": F.col("y2") + 600})

    return merged(detections(spark, sf)), merged(truth_boxes(spark, sf))


def greedy(spark, sf):
    return D.greedy_matches(*_crowded(spark, sf)).select("image_id", "cls", "det_id", "truth_id", F.round("iou", 9).alias("iou"))


def greedy_metrics(spark, sf):
    rows = D.detection_metrics(*_crowded(spark, sf), rule="greedy")
    return rows.select("cls", "n_truth", "n_det", "n_tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "ap50", "map")])


def curve(spark, sf):
    det, truth = _both(spark, sf)
    points = D.precision_recall_curve(D.label_detections(det, truth), truth)
    return points.select("cls", F.round("conf", 9).alias("conf"), "tp", "fp",
                         F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def metrics(spark, sf):
    rows = D.detection_metrics(*_both(spark, sf))
    return rows.select("cls", "n_truth", "n_det", "n_tp",
                       *[F.round(c, 9).alias(c) for c in ("precision", "recall", "ap50", "map")])


def mean_metrics(spark, sf):
    rows = D.detection_metrics(*_both(spark, sf), class_mean=True).where("cls IS NULL")
    return rows.select("n_truth", "n_det", "n_tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "ap50", "map")])


def dashboard(spark, sf):
    det = detections(spark, sf).select(
        (F.floor(F.col("image_id") / 8) % 3 + 1).cast("bigint").alias("session_id"), (F.col("image_id") % 8 + 1).cast("int").alias("drone_id"),
        (F.col("image_id") % 720).alias("frame_num"), "conf")
    return D.camera_dashboard(det, arrivals(spark, sf), ts("2024-01-20 12:00:00"), active_within=1800).select(
        "session_id", "drone_id", "title", "frame_num", "detections", "status", "state")


def dashboard_at(spark, sf):
    """The cards every twelve hours."""
    det = detections(spark, sf).select(
        (F.floor(F.col("image_id") / 8) % 3 + 1).cast("bigint").alias("session_id"), (F.col("image_id") % 8 + 1).cast("int").alias("drone_id"),
        (F.col("image_id") % 720).alias("frame_num"), "conf")
    seen = arrivals(spark, sf)
    half_day = F.timestamp_micros(F.unix_micros("arrival_ts") - F.pmod(F.unix_micros("arrival_ts"), F.lit(43_200_000_000)))
    cards = D.camera_dashboard_at(det, seen, seen.select("session_id", half_day.alias("at")).distinct(), active_within=1800)
    return cards.select("session_id", F.col("at").cast("timestamp_ntz").alias("at"), "drone_id", "title", "frame_num", "detections", "status", "state")


# each detection's truth box, then the most confident detection of each truth box
_VOC = f"""
{BOXES}, {IOU},
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, det_id ORDER BY iou DESC, truth_id) AS rn
                 FROM overlapping WHERE iou >= 0.5) WHERE rn = 1)"""
_HITS = _VOC + """,
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, truth_id ORDER BY conf DESC, det_id) AS place
                 FROM best) WHERE place = 1)"""
_LEVELS = """
levels AS (SELECT CAST(unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS DOUBLE) AS level)"""
_VOC_LEVELS = _VOC + "," + _LEVELS + """,
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, image_id, cls, truth_id ORDER BY conf DESC, det_id)
                 AS place FROM best JOIN levels ON iou >= level) WHERE place = 1)"""
# detections one after the other, each with the truth boxes that are taken so far
_GREEDY = f"""
{BOXES.replace("truth AS (", "one_truth AS (").replace("det AS (", "one_det AS (")},
truth AS (
  SELECT image_id // 20 AS image_id, image_id % 20 * 100 + box_id AS box_id, cls, x1, y1, x2 + 600 AS x2, y2 + 600 AS y2 FROM one_truth),
det AS (
  SELECT image_id // 20 AS image_id, image_id % 20 * 100 + box_id AS box_id, cls, x1, y1, x2 + 600 AS x2, y2 + 600 AS y2, conf FROM one_det),
{IOU}, {_LEVELS},
wishes AS (
  SELECT level, image_id, cls, det_id, conf, list(truth_id ORDER BY iou DESC, truth_id) AS wanted
  FROM overlapping JOIN levels ON iou >= level GROUP BY ALL),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY level, image_id, cls ORDER BY conf DESC, det_id) AS place FROM wishes),
walk AS (
  SELECT level, image_id, cls, place, det_id, conf, wanted[1] AS truth_id, [wanted[1]] AS taken FROM queue WHERE place = 1
  UNION ALL
  SELECT q.level, q.image_id, q.cls, q.place, q.det_id, q.conf, q.got, CASE WHEN q.got IS NULL THEN q.taken ELSE list_append(q.taken, q.got) END
  FROM (SELECT q.*, w.taken, list_filter(q.wanted, lambda t: NOT list_contains(w.taken, t))[1] AS got
        FROM walk w JOIN queue q ON q.level = w.level AND q.image_id = w.image_id AND q.cls = w.cls AND q.place = w.place + 1) q),
hits AS (SELECT level, image_id, cls, det_id, truth_id, conf FROM walk WHERE truth_id IS NOT NULL)"""
_CURVES = """,
per_conf AS (
  SELECT level, a.cls, a.conf, n, coalesce(tp, 0) AS tp
  FROM (SELECT cls, conf, count(*) AS n FROM det GROUP BY ALL) a CROSS JOIN levels
  LEFT JOIN (SELECT level, cls, conf, count(*) AS tp FROM hits GROUP BY ALL) b USING (level, cls, conf)),
totals AS (SELECT cls, count(*) AS n_truth FROM truth GROUP BY ALL),
curve AS (
  SELECT level, cls, conf, CAST(sum(tp) OVER w AS BIGINT) AS tp, sum(tp) OVER w * 1.0::DOUBLE / sum(n) OVER w AS precision,
         n_truth
  FROM per_conf JOIN totals USING (cls) WINDOW w AS (PARTITION BY level, cls ORDER BY conf DESC)),
grid AS (SELECT unnest(range(0, 101)) AS r),
reach AS (SELECT level, cls, tp * 100 // n_truth AS reached, max(precision) AS p FROM curve GROUP BY ALL),
ap AS (
  SELECT level, cls, sum(p) / 101 AS ap FROM (
    SELECT level, cls, r, coalesce(max(p), 0) AS p FROM reach JOIN grid ON reached >= r GROUP BY ALL) GROUP BY ALL)"""

_AT_CONF = """,
at_conf AS (
  SELECT cls, CAST(sum(n) AS BIGINT) AS n_det, CAST(sum(tp) AS BIGINT) AS n_tp FROM per_conf
  WHERE level = 0.5 AND conf >= 0.25 GROUP BY cls),
metrics AS (
  SELECT cls, coalesce(n_truth, 0) AS n_truth, coalesce(n_det, 0) AS n_det, coalesce(n_tp, 0) AS n_tp,
         coalesce(n_tp * 1.0::DOUBLE / n_det, 0) AS precision, coalesce(n_tp * 1.0::DOUBLE / n_truth, 0) AS recall,
         coalesce((SELECT max(ap) FROM ap WHERE ap.cls = c.cls AND level = 0.5), 0) AS ap50,
         coalesce((SELECT sum(ap) / 10 FROM ap WHERE ap.cls = c.cls), 0) AS map
  FROM (SELECT cls FROM truth UNION SELECT cls FROM det) c LEFT JOIN totals USING (cls) LEFT JOIN at_conf USING (cls))"""

_METRICS = _VOC_LEVELS + _CURVES + _AT_CONF

_RANKED = f"""
{BOXES},
big AS (
  SELECT image_id // 5 AS image_id, cls, image_id % 5 * 100 + box_id AS box_id, x1, y1, x2 + 400 AS x2, y2 + 400 AS y2, conf
  FROM det),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, box_id) AS place FROM big),
conflicts AS (
  SELECT b.image_id, b.cls, a.place AS better, b.place AS worse FROM ranked a JOIN ranked b
  ON a.image_id = b.image_id AND a.cls = b.cls AND a.place < b.place,
     LATERAL (SELECT greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)
                     * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS ia)
  WHERE ia / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - ia) > 0.45),
beaten AS (SELECT image_id, cls, worse, list(better) AS better FROM conflicts GROUP BY ALL),
walk AS (
  SELECT image_id, cls, 1::BIGINT AS place, [1::BIGINT] AS kept FROM ranked WHERE place = 1
  UNION ALL
  SELECT r.image_id, r.cls, r.place,
         CASE WHEN list_has_any(w.kept, coalesce(b.better, [])) THEN w.kept ELSE list_append(w.kept, r.place) END
  FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.cls = w.cls AND r.place = w.place + 1
  LEFT JOIN beaten b ON b.image_id = r.image_id AND b.cls = r.cls AND b.worse = r.place),
kept AS (SELECT image_id, cls, unnest(kept) AS place FROM (
  SELECT image_id, cls, arg_max(kept, place) AS kept FROM walk GROUP BY ALL))"""

QUERIES = {
    "filter_conf": (filtered, f"WITH {BOXES} SELECT image_id, box_id, round(conf, 9) AS conf FROM det WHERE conf >= 0.25"),
    "detection_label": (labels, f"""WITH {BOXES}
SELECT image_id, box_id, round(x1 * 0.75::DOUBLE, 6) AS x1, round(y1 * 0.75::DOUBLE, 6) AS y1,
       round(x2 * 0.75::DOUBLE, 6) AS x2, round(y2 * 0.75::DOUBLE, 6) AS y2, round(x1 * 0.25::DOUBLE, 6) AS grid_x,
       printf('person %.2f', conf) AS label FROM det"""),
    "match_boxes": (matched, f"""WITH {BOXES}, {IOU}
SELECT image_id, det_id, truth_id, round(iou, 9) AS iou FROM overlapping WHERE iou >= 0.5"""),
    "best_detections": (best, f"""WITH {BOXES}
SELECT image_id, box_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, box_id) AS rank FROM det) WHERE rank <= 2"""),
    "nms": (suppressed, f"WITH RECURSIVE {_RANKED} SELECT image_id, box_id FROM kept JOIN ranked USING (image_id, cls, place)"),
    "precision_recall_curve": (curve, f"""WITH {_HITS},
flagged AS (
  SELECT d.cls, d.conf, count(*) AS n, count(h.det_id) AS tp
  FROM det d LEFT JOIN hits h ON h.image_id = d.image_id AND h.cls = d.cls AND h.det_id = d.box_id GROUP BY ALL)
SELECT cls, round(conf, 9) AS conf, CAST(sum(tp) OVER w AS BIGINT) AS tp, CAST(sum(n - tp) OVER w AS BIGINT) AS fp,
       round(sum(tp) OVER w * 1.0::DOUBLE / sum(n) OVER w, 9) AS precision,
       round(coalesce(sum(tp) OVER w * 1.0::DOUBLE / nullif((SELECT count(*) FROM truth t WHERE t.cls = flagged.cls), 0), 0), 9) AS recall
FROM flagged WINDOW w AS (PARTITION BY cls ORDER BY conf DESC)"""),
    "detection_metrics": (metrics, f"""WITH {_METRICS}
SELECT cls, n_truth, n_det, n_tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(ap50, 9) AS ap50,
       round(map, 9) AS map FROM metrics"""),
    "greedy_matches": (greedy, f"""WITH RECURSIVE {_GREEDY}
SELECT image_id, cls, det_id, truth_id, round(iou, 9) AS iou FROM hits JOIN overlapping USING (image_id, cls, det_id, truth_id) WHERE level = 0.5"""),
    "detection_metrics_greedy": (greedy_metrics, f"""WITH RECURSIVE {_GREEDY} {_CURVES} {_AT_CONF}
SELECT cls, n_truth, n_det, n_tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(ap50, 9) AS ap50,
       round(map, 9) AS map FROM metrics"""),
    "detection_metrics_mean": (mean_metrics, f"""WITH {_METRICS}
SELECT CAST(sum(n_truth) AS BIGINT) AS n_truth, CAST(sum(n_det) AS BIGINT) AS n_det, CAST(sum(n_tp) AS BIGINT) AS n_tp,
       round(avg(precision) FILTER (WHERE n_truth > 0), 9) AS precision, round(avg(recall) FILTER (WHERE n_truth > 0), 9) AS recall,
       round(avg(ap50) FILTER (WHERE n_truth > 0), 9) AS ap50, round(avg(map) FILTER (WHERE n_truth > 0), 9) AS map
FROM metrics"""),
    "confusion_matrix": (lambda s, d: D.confusion_matrix(*_both(s, d)), f"""WITH {_VOC},
confident AS (SELECT * FROM det WHERE conf >= 0.25),
any_class AS (
  SELECT d.image_id, d.cls AS pred_cls, t.cls AS true_cls, d.box_id AS det_id, t.box_id AS truth_id, d.conf, ia,
         (d.x2 - d.x1) * (d.y2 - d.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - ia AS ua
  FROM confident d JOIN truth t USING (image_id),
       LATERAL (SELECT greatest(least(d.x2, t.x2) - greatest(d.x1, t.x1), 0)
                       * greatest(least(d.y2, t.y2) - greatest(d.y1, t.y1), 0) AS ia)),
nearest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, det_id ORDER BY ia / ua DESC, truth_id) AS rn
                 FROM any_class WHERE ua > 0 AND ia / ua >= 0.5) WHERE rn = 1),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, truth_id ORDER BY conf DESC, det_id) AS place
                 FROM nearest) WHERE place = 1)
SELECT true_cls, pred_cls, count(*) AS n FROM hits GROUP BY ALL
UNION ALL SELECT cls, -1, count(*) FROM truth t WHERE NOT EXISTS (
  SELECT 1 FROM hits h WHERE h.image_id = t.image_id AND h.truth_id = t.box_id) GROUP BY cls
UNION ALL SELECT -1, cls, count(*) FROM confident d WHERE NOT EXISTS (
  SELECT 1 FROM hits h WHERE h.image_id = d.image_id AND h.det_id = d.box_id) GROUP BY cls"""),
    "camera_dashboard_at": (dashboard_at, f"""WITH {ARRIVALS}, {BOXES},
times AS (SELECT DISTINCT session_id, time_bucket(INTERVAL 12 HOUR, arrival_ts, TIMESTAMP '2024-01-01') AS at_time FROM arrivals),
rows AS (
  SELECT session_id, drone_id, arrival_ts, arg_max(frame_num, packet_id) AS frame_num FROM arrivals GROUP BY ALL),
asked AS (SELECT DISTINCT t.session_id, t.at_time, a.drone_id FROM times t JOIN arrivals a ON a.session_id = t.session_id),
last AS (
  SELECT a.session_id, a.at_time, a.drone_id, r.frame_num, r.arrival_ts AS last_at
  FROM asked a ASOF JOIN rows r ON a.session_id = r.session_id AND a.drone_id = r.drone_id AND a.at_time >= r.arrival_ts),
hits AS (
  SELECT image_id // 8 % 3 + 1 AS session_id, image_id % 8 + 1 AS drone_id, image_id % 720 AS frame_num, count(*) AS n
  FROM det WHERE conf >= 0.25 GROUP BY ALL)
SELECT l.session_id, at_time AS "at", l.drone_id, printf('Camera %03d', l.drone_id) AS title, l.frame_num, coalesce(n, 0) AS detections,
       CASE WHEN n > 0 THEN n || ' TARGETS' ELSE 'NO TARGETS' END AS status,
       CASE WHEN at_time - last_at <= INTERVAL 1800 SECOND THEN 'ACTIVE' ELSE 'INACTIVE' END AS state
FROM last l LEFT JOIN hits h ON h.session_id = l.session_id AND h.drone_id = l.drone_id AND h.frame_num = l.frame_num"""),
    "camera_dashboard": (dashboard, f"""WITH {ARRIVALS}, {BOXES},
last AS (
  SELECT session_id, drone_id, arg_max(frame_num, (arrival_ts, packet_id)) AS frame_num, max(arrival_ts) AS last_at
  FROM arrivals WHERE arrival_ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL),
n AS (
  SELECT l.session_id, l.drone_id, count(d.box_id) AS n FROM last l
  LEFT JOIN det d ON d.image_id % 8 + 1 = l.drone_id AND d.image_id // 8 % 3 + 1 = l.session_id AND d.image_id % 720 = l.frame_num AND d.conf >= 0.25 GROUP BY ALL)
SELECT session_id, drone_id, printf('Camera %03d', drone_id) AS title, frame_num, n AS detections,
       CASE WHEN n > 0 THEN n || ' TARGETS' ELSE 'NO TARGETS' END AS status,
       CASE WHEN TIMESTAMP '2024-01-20 12:00:00' - last_at <= INTERVAL 1800 SECOND THEN 'ACTIVE' ELSE 'INACTIVE' END AS state
FROM last JOIN n USING (session_id, drone_id)"""),
}
