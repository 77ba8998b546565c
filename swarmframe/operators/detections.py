"""Detection tables: filtering, matching against truth, suppression and quality metrics.

Matching follows the published VOC rule: a detection belongs to the truth box it overlaps most, and of the
detections that belong to one truth box the most confident is right. With the rule ``greedy`` a detection whose best box is taken
gets its next best: images of bounded size are folded in place, crowded ones go through rounds of aggregations. Average precision is
the 101-point COCO interpolation. Boxes of crowded images are filed in a grid, so an image of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.functions.geometry import box_iou
from swarmframe.functions.text import active_label, detection_status
from swarmframe.operators.sync import latest_per_drone, latest_per_drone_at
from swarmframe.plans.boxes import CELLS, COORDS, filed, is_real, overlapping, searching, split_pairs
from swarmframe.plans.lookup import join_null_safe, micros
from swarmframe.plans.once import stored
from swarmframe.plans.scan import chunks_for, running

# The COCO thresholds .50:.05:.95.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
#: Images and classes of more pairs are matched greedily in rounds. It only chooses the plan.
PAIR_LIMIT = 2048
#: Fixed: the bits of a long that name levels.
_BITS = 62


def filter_conf(det: DataFrame, conf: float = 0.25) -> DataFrame:
    """Keep detections with at least this confidence."""
    return det.filter(F.col("conf") >= conf)


def best_detections(det: DataFrame, k: int) -> DataFrame:
    """The ``k`` most confident detections of each image (Spark keeps k per image before the shuffle)."""
    w = Window.partitionBy("image_id").orderBy(F.desc("conf"), "box_id")
    return det.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _keys(class_aware: bool) -> list[str]:
    return ["image_id", "cls"] if class_aware else ["image_id"]


def _split_pairs(det: DataFrame, truth: DataFrame, iou: float, class_aware: bool) -> list[DataFrame]:
    """Pairs of images (and classes) of bounded size, then those of crowded ones, if there are any."""
    keys = _keys(class_aware)
    carry = [] if class_aware else ["cls"]
    a_carry, b_carry = ["box_id", "conf", *carry], ["box_id", *carry]
    if iou <= 0:
        raise ValueError("the IoU threshold must be above 0")
    found = split_pairs(det.select(*keys, *COORDS, *a_carry), truth.select(*keys, *COORDS, *b_carry), keys, iou, a_carry, b_carry)
    return [part.select(*keys, F.col("_a_box_id").alias("det_id"), F.col("_b_box_id").alias("truth_id"),
                        F.col("_a_conf").alias("conf"), "iou",
                        *[F.col(f"_{s}_cls").alias(n) for s, n in (("a", "pred_cls"), ("b", "true_cls"))
                          if not class_aware]) for part in found if part is not None]


def _pairs(det: DataFrame, truth: DataFrame, iou: float, class_aware: bool) -> DataFrame:
    return reduce(DataFrame.unionByName, _split_pairs(det, truth, iou, class_aware))


def match_boxes(det: DataFrame, truth: DataFrame, iou: float = 0.5, class_aware: bool = True) -> DataFrame:
    """Pairs of one image (and class) with IoU >= ``iou``: det_id, truth_id, conf, iou.

    Boxes with a null, NaN or infinite coordinate, or without area, match nothing; a null image or class neither.
    Boxes per image are counted when this is called.
    """
    return _pairs(det, truth, iou, class_aware)


def best_matches(det: DataFrame, truth: DataFrame, iou: float = 0.5, class_aware: bool = True) -> DataFrame:
    """The truth box each detection overlaps most (ties: lowest truth id), where the overlap reaches ``iou``.

    Copies of a box are boxes: each detection has its row.
    """
    pairs = _pairs(det, truth, iou, class_aware)
    keys = _keys(class_aware)
    extra = [] if class_aware else ["pred_cls", "true_cls"]
    best = pairs.groupBy(*keys, "det_id", *extra[:1]).agg(
        F.max(F.struct(F.col("iou"), (-F.col("truth_id")).alias("_n"), "conf", "truth_id", *extra[1:])).alias("_b"))
    return best.select(*keys, "det_id", *extra[:1],
                       *[F.col(f"_b.{c}").alias(c) for c in ("truth_id", "conf", "iou", *extra[1:])])


def true_positives(best: DataFrame, thresholds: Sequence[float], class_aware: bool = True) -> DataFrame:
    """The right detection of every matched truth box at each IoU threshold."""
    keys = _keys(class_aware)
    extra = [] if class_aware else ["true_cls"]
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = best.withColumn("iou_threshold", F.explode(F.filter(levels, lambda t: t <= F.col("iou"))))
    rest = [c for c in ("det_id", "conf", "iou", "pred_cls") if c in best.columns]
    top = rows.groupBy(*keys, "truth_id", *extra, "iou_threshold").agg(F.max(F.struct(
        F.col("conf").alias("_c"), (-F.col("det_id")).alias("_d"), *rest)).alias("_t"))
    return top.select(*keys, "truth_id", *extra, "iou_threshold", *[F.col(f"_t.{c}").alias(c) for c in rest])


def _assigned(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one pairs of ``edges`` (keys, det_id, truth_id, conf, iou): most confident detections choose first.

    Deferred acceptance: every detection asks for its best truth box, a box keeps the most confident one that asks, and the
    pairs that were turned down go. A group (one set of keys) in which nothing was turned down is settled. The edges of a round
    are written to the shared folder; a round is two aggregations, whatever the size of an image.
    """
    keys = list(keys)
    columns = [*keys, "det_id", "truth_id", "conf", "iou"]
    left, settled = stored(edges.select(*columns), "greedy-edges"), []
    while not left.isEmpty():
        choice = F.max(F.struct("iou", (-F.col("truth_id")).alias("_t"), "truth_id", "conf"))
        asked = left.groupBy(*keys, "det_id").agg(choice.alias("_a")).select(
            *keys, "det_id", F.col("_a.truth_id").alias("truth_id"), F.col("_a.conf").alias("conf"), F.col("_a.iou").alias("iou"))
        first = F.max(F.struct("conf", (-F.col("det_id")).alias("_d"), "det_id", "iou"))
        kept = asked.groupBy(*keys, "truth_id").agg(first.alias("_k"), F.count("*").alias("_n"))
        # one row per truth box that was asked for
        kept = stored(kept.select(*keys, "truth_id", F.col("_k.det_id").alias("det_id"), F.col("_k.conf").alias("conf"),
                                  F.col("_k.iou").alias("iou"), "_n"), "greedy-kept")
        open_groups = kept.filter("_n > 1").select(*keys).distinct()
        settled.append(kept.join(open_groups, keys, "left_anti").select(*columns))
        # a box that holds a detection turns down every less confident one, now or later
        holders = kept.select(*keys, "truth_id", F.struct(F.col("conf").alias("c"), (-F.col("det_id")).alias("d")).alias("_holds"))
        rest = left.join(open_groups, keys, "left_semi").join(holders, [*keys, "truth_id"], "left")
        mine = F.struct(F.col("conf").alias("c"), (-F.col("det_id")).alias("d"))
        left = stored(rest.filter(F.col("_holds").isNull() | (mine >= F.col("_holds"))).select(*columns), "greedy-edges")
    return reduce(DataFrame.unionByName, settled) if settled else left


def greedy_matches(det: DataFrame, truth: DataFrame, iou: float = 0.5) -> DataFrame:
    """One-to-one pairs per image and class: detections choose in falling confidence (ties: lower id), each the free truth box
    it overlaps most.

    A detection whose best box is taken gets its next best, as long as the overlap reaches ``iou``; ties of overlap go to the
    lower truth id. Ids name the boxes of an image and class. Null and NaN confidences match nothing. Rounds run when this is called.
    """
    return _greedy(det, truth, [iou]).drop("_levels")


def _greedy(det: DataFrame, truth: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Greedy pairs at each of up to ``_BITS`` ascending ``levels`` of overlap; bit i of ``_levels`` says that it is one at level i.

    The pairs of a group (an image and class) are walked by falling confidence, then overlap, and kept at the levels at which
    neither box is taken: one fold for all levels. Crowded groups, those of more than ``PAIR_LIMIT`` pairs and those in which a
    detection's id has several confidences are settled in rounds instead.
    """
    keys = _keys(True)
    columns = [*keys, "det_id", "truth_id", "conf", "iou", "_levels"]
    reached = reduce(Column.bitwiseOR, [F.when(F.col("iou") >= float(t), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, t in enumerate(levels)])
    direct, *crowded = [_sure(part).withColumn("_levels", reached) for part in _split_pairs(det, truth, levels[0], True)]
    rank = F.struct("conf", (-F.col("det_id")).alias("_d"), "iou", (-F.col("truth_id")).alias("_t"), "det_id", "truth_id", "_levels")
    groups = direct.groupBy(*keys).agg(F.sort_array(F.collect_list(rank), asc=False).alias("_pairs"))

    def free(kept: Column, pair: Column) -> Column:
        taken = F.aggregate(kept, F.lit(0).cast("bigint"), lambda bits, k: F.when(
            k["det_id"].eqNullSafe(pair["det_id"]) | k["truth_id"].eqNullSafe(pair["truth_id"]), bits.bitwiseOR(k["_levels"])).otherwise(bits))
        return pair["_levels"].bitwiseAND(F.bitwise_not(taken))

    kept = F.aggregate("_pairs", F.slice("_pairs", 1, 0), lambda acc, pair: F.concat(
        acc, F.filter(F.array(pair.withField("_levels", free(acc, pair))), lambda p: p["_levels"] != 0)))
    ids = F.size(F.array_distinct(F.transform("_pairs", lambda p: p["det_id"])))
    confs = F.size(F.array_distinct(F.transform("_pairs", lambda p: F.xxhash64(p["det_id"], p["conf"]))))
    is_open = (F.size("_pairs") > PAIR_LIMIT) | (ids != confs)
    rows = stored(groups.select(*keys, is_open.alias("_open"), F.inline(F.when(is_open, F.col("_pairs")).otherwise(kept))).select("_open", *columns),
                  "greedy-pairs")
    done, left = rows.filter(~F.col("_open")).select(*columns), rows.filter("_open").select(*columns)
    if not crowded and left.isEmpty():
        return done
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda i: F.getbit("_levels", i) == 1)
    edges = reduce(DataFrame.unionByName, [left, *crowded]).withColumn("_level", F.explode(bits))
    found = _assigned(edges, [*keys, "_level"])
    return done.unionByName(found.withColumn("_levels", F.expr("shiftleft(1L, _level)")).select(*columns))


def _sure(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("conf").isNotNull() & ~F.isnan(F.col("conf").cast("double")))


def _is_greedy(rule: str) -> bool:
    if rule not in ("voc", "greedy"):
        raise ValueError(f"no matching rule {rule!r}")
    return rule == "greedy"


def label_detections(det: DataFrame, truth: DataFrame, iou: float = 0.5, rule: str = "voc") -> DataFrame:
    """Every detection with ``is_tp``, by the published VOC rule or by greedy matching (``rule``)."""
    hits = greedy_matches(det, truth, iou) if _is_greedy(rule) else true_positives(best_matches(det, truth, iou), [iou])
    hits = hits.select("image_id", "cls", F.col("det_id").alias("box_id"), F.lit(True).alias("_hit"))
    return det.join(hits, ["image_id", "cls", "box_id"], "left").withColumn(
        "is_tp", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _falling(points: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Running sums over falling confidence; one row per key and confidence, cut into as many chunks as the (written) rows need."""
    down = points.select(*keys, (-F.col("conf")).alias("_down"), *values)
    sums = running(down, keys, "_down", values, chunks=chunks_for(points.count()))
    return sums.select(*keys, (-F.col("_down")).alias("conf"), *values.values())


def _truth_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy("cls").agg(F.count("*").alias("n_truth"))


def precision_recall_curve(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """One operating point per class and distinct confidence: tp, fp, precision and recall at that threshold.

    ``matches``: detections with ``is_tp`` (see ``label_detections``). Equal confidences are merged before the
    running sum, which is cut into chunks of confidence, so one class may hold all rows. The merged points are
    written to the shared folder when this is called.
    """
    points = stored(matches.groupBy("cls", "conf").agg(F.count("*").alias("n"), F.count_if("is_tp").alias("hit")),
                    "curve-points")
    sums = _falling(points, ["cls"], {"n": "n_det", "hit": "tp"})
    # one row per class; a class without truth has false detections only
    return (join_null_safe(sums, _truth_counts(truth), ["cls"], "left")
            .select("cls", "conf", "tp", (F.col("n_det") - F.col("tp")).alias("fp"),
                    (F.col("tp") / F.col("n_det")).alias("precision"),
                    F.coalesce(F.col("tp") / F.col("n_truth"), F.lit(0.0)).alias("recall")))


def average_precision(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """101-point interpolated average precision of each curve.

    A point with recall R lifts the recall levels 0..floor(100 R), so the best precision per level is taken
    first; what is left for the window is at most 101 rows per curve.
    """
    levels = (curve.withColumn("_level", F.floor(F.col("tp") * 100 / F.col("n_truth")))
              .groupBy(*keys, "_level").agg(F.max("precision").alias("_p")))
    up = Window.partitionBy(*keys).orderBy("_level")
    down = Window.partitionBy(*keys).orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, 0)
    steps = levels.select(*keys, F.max("_p").over(down).alias("_best"),
                          (F.col("_level") - F.coalesce(F.lag("_level").over(up), F.lit(-1))).alias("_width"))
    return steps.groupBy(*keys).agg((F.sum(F.col("_best") * F.col("_width")) / 101.0).alias("ap"))


def _hits(rows: DataFrame, levels: Sequence[float], is_hit: Callable[[int], Column]) -> DataFrame:
    """cls, conf, iou_threshold, hit: how many ``rows`` of a class and confidence are right at each level; one row per class and confidence moves."""
    sums = rows.groupBy("cls", "conf").agg(*[F.count_if(is_hit(i)).alias(f"_n{i}") for i in range(len(levels))])
    counts = F.array(*[F.struct(F.lit(float(t)).alias("iou_threshold"), F.col(f"_n{i}").alias("hit")) for i, t in enumerate(levels)])
    return sums.select("cls", "conf", F.inline(counts)).where("hit > 0")


def detection_metrics(det: DataFrame, truth: DataFrame, conf: float = 0.25, iou: float = 0.5,
                      thresholds: Sequence[float] = THRESHOLDS, class_mean: bool = False, rule: str = "voc") -> DataFrame:
    """Per class: precision and recall at ``conf`` and ``iou``, AP50 and the mean AP over ``thresholds``.

    ``rule``: voc, or greedy (matched anew at each threshold, all thresholds in the same fold or rounds).

    Classes without truth or without detections have zeros. With ``class_mean`` one more row, of class null, has the
    sums of the counts and the means of the rates over the classes that have truth. Matching runs when this is called; its counts per confidence are written to the shared folder.
    """
    levels = sorted({*thresholds, iou, 0.5})
    if _is_greedy(rule):
        parts = [levels[i:i + _BITS] for i in range(0, len(levels), _BITS)]
        right = [_hits(_greedy(det, truth, part), part, lambda i: F.getbit("_levels", F.lit(i)) == 1) for part in parts]
    else:
        # of a truth box only the confidence of its right detection counts: one maximum per threshold, no row per threshold moves
        best = best_matches(det, truth, levels[0]).groupBy("image_id", "cls", "truth_id").agg(
            *[F.max(F.when(F.col("iou") >= t, F.col("conf"))).alias(f"_{i}") for i, t in enumerate(levels)])
        # maxima fall as thresholds rise, so equal ones follow each other: each is listed once
        tops = F.array(*[F.struct(F.col(f"_{i}").alias("conf"), (~F.col(f"_{i}").eqNullSafe(F.col(f"_{i - 1}")) if i else F.lit(True)).alias("_first"))
                         for i in range(len(levels))])
        rows = best.select("cls", *[f"_{i}" for i in range(len(levels))], F.inline(tops)).where("_first AND conf IS NOT NULL")
        right = [_hits(rows, levels, lambda i: F.col(f"_{i}") == F.col("conf"))]
    right = stored(reduce(DataFrame.unionByName, right), "metric-hits")
    found = stored(det.groupBy("cls", "conf").agg(F.count("*").alias("n")), "metric-found")
    counts = _truth_counts(truth)
    # interpolated precision is reached where a right detection comes in, so only those points are followed per
    # threshold; how many detections lie above them does not depend on the threshold
    tp = _falling(right, ["cls", "iou_threshold"], {"hit": "tp"})
    above = _falling(found, ["cls"], {"n": "n_det"})
    curve = tp.join(above, ["cls", "conf"]).join(counts, "cls").withColumn("precision", F.col("tp") / F.col("n_det"))
    wanted = [float(t) for t in thresholds]
    ap = (average_precision(curve, ["cls", "iou_threshold"]).groupBy("cls").agg(
        F.max(F.when(F.col("iou_threshold") == 0.5, F.col("ap"))).alias("ap50"),
        (F.sum(F.when(F.col("iou_threshold").isin(*wanted), F.col("ap"))) / len(wanted)).alias("map")))
    n_det = found.filter(F.col("conf") >= conf).groupBy("cls").agg(F.sum("n").alias("n_det"))
    n_tp = (right.filter((F.col("iou_threshold") == iou) & (F.col("conf") >= conf)).groupBy("cls")
            .agg(F.sum("hit").alias("n_tp")))
    zero = F.lit(0).cast("bigint")
    classes = counts.join(found.select("cls").distinct().where("cls IS NOT NULL"), "cls", "full")
    rows = (classes.join(n_det, "cls", "left").join(n_tp, "cls", "left").join(ap, "cls", "left")
            .select("cls", F.coalesce("n_truth", zero).alias("n_truth"), F.coalesce("n_det", zero).alias("n_det"), F.coalesce("n_tp", zero).alias("n_tp"),
                    F.coalesce(F.col("n_tp") / F.col("n_det"), F.lit(0.0)).alias("precision"),
                    F.coalesce(F.col("n_tp") / F.col("n_truth"), F.lit(0.0)).alias("recall"),
                    F.coalesce("ap50", F.lit(0.0)).alias("ap50"), F.coalesce("map", F.lit(0.0)).alias("map")))
    if not class_mean:
        return rows
    has_truth = F.col("n_truth") > 0
    mean = rows.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("n_truth", "n_det", "n_tp")],
                    *[F.coalesce(F.avg(F.when(has_truth, F.col(c))), F.lit(0.0)).alias(c) for c in ("precision", "recall", "ap50", "map")])
    return rows.unionByName(mean.withColumn("cls", F.lit(None).cast(rows.schema["cls"].dataType)))


def confusion_matrix(det: DataFrame, truth: DataFrame, conf: float = 0.25, iou: float = 0.5) -> DataFrame:
    """Counts per (true_cls, pred_cls); -1 is the background: missed truth boxes and false detections."""
    det = filter_conf(det, conf)
    hits = true_positives(best_matches(det, truth, iou, False), [iou], False)
    matched = hits.groupBy(F.col("true_cls").cast("int").alias("true_cls"),
                           F.col("pred_cls").cast("int").alias("pred_cls")).agg(F.count("*").alias("n"))

    def rest(df: DataFrame, side: str, other: str) -> DataFrame:
        total = df.groupBy(F.col("cls").cast("int").alias(side)).agg(F.count("*").alias("_all"))
        used = matched.groupBy(side).agg(F.sum("n").alias("_used"))
        return (total.join(used, side, "left")
                .withColumn("n", F.col("_all") - F.coalesce("_used", F.lit(0))).filter(F.col("n") > 0)
                .select(side, F.lit(-1).alias(other), "n"))

    return matched.unionByName(rest(truth, "true_cls", "pred_cls")).unionByName(rest(det, "pred_cls", "true_cls"))


def _cards(last: DataFrame, det: DataFrame, at: Column, conf: float, active_within: float, keys: Sequence[str], more: Sequence[str]) -> DataFrame:
    """Cards of cameras whose newest rows are ``last``; detections are counted per frame before they meet them."""
    frame = [*keys, "frame_num"]
    hits = filter_conf(det, conf).join(last.select(*frame).distinct(), frame, "left_semi").groupBy(*frame).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0).cast("bigint"))
    active = micros(at) - micros("arrival_ts") <= int(active_within * 1_000_000)
    return last.join(hits, frame, "left").select(
        *keys, *more, F.format_string("Camera %03d", F.col("drone_id").cast("int")).alias("title"), "frame_num",
        n.alias("detections"), detection_status(n).alias("status"), active_label(active).alias("state"))


def camera_dashboard(det: DataFrame, arrivals: DataFrame, as_of: Column, conf: float = 0.25,
                     active_within: float = 5.0, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """One card per camera: detections in its latest frame, status labels, and whether it is still sending."""
    light = arrivals.select(*keys, "drone_id", "frame_num", "arrival_ts", "packet_id")
    return _cards(latest_per_drone(light, as_of, keys), det, as_of, conf, active_within, [*keys, "drone_id"], [])


def camera_dashboard_at(det: DataFrame, arrivals: DataFrame, times: DataFrame, conf: float = 0.25, active_within: float = 5.0,
                        keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The cards at each of a table of times (keys, ``at``)."""
    light = arrivals.select(*keys, "drone_id", "frame_num", "arrival_ts", "packet_id")
    return _cards(latest_per_drone_at(light, times, keys), det, F.col("at"), conf, active_within, [*keys, "drone_id"], ["at"])


def _suppress_in_rows(det: DataFrame, iou: float) -> DataFrame:
    """Suppression by folding the ranked boxes of each image; images here are small."""
    keys = ["image_id", "cls"]
    rest = [c for c in det.columns if c not in [*keys, "_conf", "_id"]]
    packed = F.struct((-F.col("_conf")).alias("_order"), "_id", *COORDS, *[c for c in rest if c not in COORDS])
    ordered = det.groupBy(*keys).agg(F.sort_array(F.collect_list(packed)).alias("_boxes"))

    def overlaps(kept: Column, box: Column) -> Column:
        return box_iou(*[kept[c] for c in COORDS], *[box[c] for c in COORDS]) > iou

    kept = F.aggregate("_boxes", F.slice("_boxes", 1, 0), lambda acc, box: F.when(
        F.exists(acc, lambda k: overlaps(k, box)), acc).otherwise(F.concat(acc, F.array(box))))
    return ordered.select(*keys, F.explode(kept).alias("_box")).select(
        *keys, *[F.col(f"_box.{c}").alias(c) for c in rest])


def _suppress_in_rounds(det: DataFrame, iou: float) -> DataFrame:
    """Same result for crowded images, in rounds that never list the pairs of an image.

    Boxes are filed in the grid of ``plans.boxes``, and every cell has one leader, its best box. A box that leads
    all cells it could overlap into is kept, and removes what it overlaps; a cell has at most one such box, so a
    round handles each remaining box a bounded number of times. Rounds go on until no box is left. The state of
    each round is written to the shared folder, so a lost executor costs one round.
    """
    keys = ["image_id", "cls"]
    box = [*keys, *COORDS]
    rank = F.struct(F.col("_conf").alias("c"), (-F.col("_id")).alias("b"), *[(-F.col(c)).alias(c) for c in COORDS])
    left = stored(filed(det.select(*box, "_conf", "_id")).withColumn("_rank", rank), "nms-left")
    kept_boxes = None
    while not left.isEmpty():
        looking = searching(left.drop(*CELLS), iou)
        leaders = left.groupBy(*keys, *CELLS).agg(F.max("_rank").alias("_lead"))
        best = (looking.select(*box, *CELLS).join(leaders, [*keys, *CELLS])
                .groupBy(*box).agg(F.max("_lead").alias("_lead")))
        kept = stored(left.join(best, box).filter(F.col("_lead") == F.col("_rank")).drop("_lead"), "nms-kept")
        kept_boxes = kept.select(*box) if kept_boxes is None else kept_boxes.unionByName(kept.select(*box))
        removed = (overlapping(looking, kept, keys, [], []).filter(F.col("iou") > iou)
                   .select(*keys, *[F.col(f"_a_{c}").alias(c) for c in COORDS]))
        out = removed.unionByName(kept.select(*box)).distinct()
        left = stored(left.join(out, box, "left_anti"), "nms-left")
    rows = det.drop("_conf", "_id")
    return rows.limit(0) if kept_boxes is None else rows.join(kept_boxes, box, "left_semi").select(*rows.columns)


def nms(det: DataFrame, iou: float = 0.45, group_limit: int = 2000) -> DataFrame:
    """Per image and class, most confident first: drop boxes with IoU above ``iou``.

    One rule for images of any size: null and NaN confidences rank last, ties go to the lower box id (null last), then to
    the smaller coordinates. Boxes with a null, NaN or infinite coordinate, or without area, overlap nothing and stay, as
    all boxes do with ``iou`` of 1 or more. Of equal boxes the best stays; rows may share a box id.
    ``group_limit`` only chooses the plan: images with more boxes of a class are resolved in distributed rounds, which run
    when this is called; finding them is one pre-aggregated count.
    """
    if iou <= 0:
        raise ValueError("the IoU threshold must be above 0")
    if iou >= 1:
        return det
    keys = ["image_id", "cls"]
    lowest = F.lit(float("-inf"))
    conf = F.coalesce(F.when(~F.isnan(F.col("conf").cast("double")), F.col("conf").cast("double")), lowest)
    ranked = det.filter(is_real()).withColumns({"_conf": conf, "_id": F.coalesce(F.col("box_id").cast("bigint"), F.lit(2 ** 63 - 1))})
    # a copy of a better box always goes: whatever removes the one removes the other
    rest = [c for c in ranked.columns if c not in [*keys, *COORDS]]
    top = ranked.groupBy(*keys, *COORDS).agg(F.max(F.struct(F.col("_conf").alias("_c"), (-F.col("_id")).alias("_i"), *rest)).alias("_top"))
    boxes = top.select(*keys, *COORDS, *[F.col(f"_top.{c}").alias(c) for c in rest]).select(*ranked.columns)
    hot = boxes.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > group_limit).select(*keys)
    without = det.filter(~is_real())
    if hot.isEmpty():
        return without.unionByName(_suppress_in_rows(boxes, iou)).select(*det.columns)
    return (without.unionByName(_suppress_in_rows(boxes.join(hot, keys, "left_anti"), iou))
            .unionByName(_suppress_in_rounds(boxes.join(hot, keys, "left_semi"), iou)).select(*det.columns))


__all__ = [
    "average_precision", "best_detections", "best_matches", "camera_dashboard", "camera_dashboard_at", "confusion_matrix",
    "detection_metrics", "filter_conf", "greedy_matches", "label_detections", "match_boxes", "nms",
    "precision_recall_curve", "true_positives",
]
