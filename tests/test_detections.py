import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from swarmframe.operators import detections as D
from swarmframe.plans.boxes import grid_pairs
from swarmframe.schemas import BOXES, DETECTIONS


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def crowd(n, seed, images=3, spread=60, copies=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rnd.uniform(-spread, spread), rnd.uniform(-spread, spread)
        w, h = rnd.choice([4, 8, 16, 40]) * rnd.uniform(0.8, 1.3), rnd.choice([4, 8, 16, 40]) * rnd.uniform(0.8, 1.3)
        rows.append((rnd.randint(1, images), i, rnd.randint(0, 1), x, y, x + w, y + h, rnd.randint(0, 20) / 20))
        if copies and rnd.random() < 0.2:
            rows.append((*rows[-1][:1], n + i, *rows[-1][2:7], rnd.randint(0, 20) / 20))
    return rows


def boxes(spark, rows, conf=True):
    return spark.createDataFrame(rows if conf else [r[:7] for r in rows], DETECTIONS if conf else BOXES)


def greedy(rows, limit):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[1])):
        if all(k[0] != r[0] or k[2] != r[2] or iou(k[3:7], r[3:7]) <= limit for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


@pytest.mark.parametrize("threshold", [0.1, 0.45, 0.5, 0.9, 1.0])
def test_grid_finds_all_pairs(spark, threshold):
    a, b = crowd(150, 1), crowd(150, 2)
    got = [(r._a_box_id, r._b_box_id) for r in grid_pairs(boxes(spark, a), boxes(spark, b, False), ["image_id", "cls"], threshold,
                                                          ["box_id"], ["box_id"]).collect()]
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] == y[2] and iou(x[3:7], y[3:7]) >= threshold}
    assert set(got) == want and len(got) == len(want)


INF, NAN = float("inf"), float("nan")
# kept at IoU 0.45, in an image by themselves: (rows as box_id, x1, y1, x2, y2, conf), ids that stay
RULES = {
    "null coordinate": ([(1, 0, 0, 10, 10, .9), (2, 0, 0, 10, 10, .8), (3, None, 0, 10, 10, .7)], [1, 3]),
    "infinite coordinate": ([(1, 0, 0, 10, 10, .9), (2, 0, 0, INF, 10, .8), (3, -INF, 0, INF, 10, .7)], [1, 2, 3]),
    "NaN coordinate": ([(1, 0, 0, NAN, 10, .9), (2, 0, 0, 10, 10, .8)], [1, 2]),
    "null confidence": ([(1, 0, 0, 10, 10, None), (2, 0, 0, 10, 11, .1)], [2]),
    "NaN confidence": ([(1, 0, 0, 10, 10, NAN), (2, 0, 0, 10, 11, .1)], [2]),
    "null and NaN tie": ([(1, 0, 0, 10, 10, NAN), (2, 0, 0, 10, 11, None)], [1]),
    "repeated id": ([(1, 0, 0, 10, 10, .9), (1, 0, 0, 10, 11, .8), (1, 50, 50, 60, 60, .7), (2, 0, 0, 11, 10, .6)], [1, 1]),
    "repeated row": ([(1, 0, 0, 10, 10, .9), (1, 0, 0, 10, 10, .9)], [1]),
    "no area": ([(1, 5, 5, 5, 9, .9), (2, 5, 5, 5, 9, .8)], [1, 2]),
}


@pytest.mark.parametrize("limit", [10_000, 0])
@pytest.mark.parametrize("case", RULES)
def test_nms_follows_one_rule_at_any_size(spark, case, limit):
    rows, want = RULES[case]
    det = boxes(spark, [(1, i, 0, *[None if v is None else float(v) for v in rest]) for i, *rest in rows])
    assert sorted(r.box_id for r in D.nms(det, 0.45, group_limit=limit).collect()) == want


@pytest.mark.parametrize("limit", [10_000, 0])
def test_nothing_overlaps_more_than_all(spark, limit):
    det = boxes(spark, [(1, 1, 0, 0.0, 0.0, 9.0, 9.0, .9), (1, 2, 0, 0.0, 0.0, 9.0, 9.0, .8)])
    assert D.nms(det, 1.0, group_limit=limit).count() == 2


@pytest.mark.parametrize("n", [1, 3000])
def test_matching_does_not_depend_on_the_size_of_the_image(spark, n):
    far = [(1, 1000 + i, 0, 1000.0 + 20 * i, 0.0, 1010.0 + 20 * i, 10.0, .5) for i in range(n)]
    det = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0, .9), (1, 2, 0, 0.0, 0.0, 10.0, 10.0, .8), (1, 3, 0, 0.0, 0.0, INF, 10.0, .7),
           (1, 4, 0, None, 0.0, 10.0, 10.0, .6)]
    truth = [(1, 7, 0, 0.0, 0.0, 10.0, 10.0), (1, 8, 0, 0.0, 0.0, INF, 10.0)]
    ddf, tdf = boxes(spark, det + far), spark.createDataFrame(truth, BOXES)
    for found in (D.best_matches(ddf, tdf), D.match_boxes(ddf, tdf)):
        assert sorted((r.det_id, r.truth_id) for r in found.collect()) == [(1, 7), (2, 7)]


def test_classes_without_truth_or_detections_stay(spark):
    det = boxes(spark, [(1, 1, 0, 0.0, 0.0, 10.0, 10.0, .9), (1, 2, 1, 0.0, 0.0, 10.0, 10.0, .8)])
    truth = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 5, 2, 0.0, 0.0, 10.0, 10.0)], BOXES)
    rows = {r.cls: (r.n_truth, r.n_det, r.n_tp, r.precision, r.recall, round(r.map, 6)) for r in D.detection_metrics(det, truth, class_mean=True).collect()}
    assert rows == {0: (1, 1, 1, 1.0, 1.0, 1.0), 1: (0, 1, 0, 0.0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0, 0.0), None: (2, 2, 1, 0.5, 0.5, 0.5)}
    curve = D.precision_recall_curve(D.label_detections(det, truth), truth).collect()
    assert sorted((r.cls, r.tp, r.fp, r.recall) for r in curve) == [(0, 1, 0, 1.0), (1, 0, 1, 0.0)]


@pytest.mark.parametrize("limit", [10_000, 20])
def test_nms(spark, limit):
    rows = crowd(200, 3, images=2)
    rows.append((1, 9000, 0, 5.0, 5.0, 5.0, 9.0, 0.3))
    got = D.nms(boxes(spark, rows), 0.45, group_limit=limit)
    assert got.columns == boxes(spark, rows).columns
    assert sorted(r.box_id for r in got.collect()) == sorted(greedy(rows, 0.45))


def test_nms_chain_in_rounds(spark):
    """Each box overlaps the next one only, in falling order of confidence: every second box stays."""
    rows = [(1, i, 0, 10.0 * i, 0.0, 10.0 * i + 28, 10.0, 1 - i / 10) for i in range(6)]
    want = greedy(rows, 0.45)
    assert want == {0, 2, 4} and {r.box_id for r in D.nms(boxes(spark, rows), 0.45, group_limit=2).collect()} == want


def voc(det, truth, threshold):
    best = {}
    for d in det:
        cands = [(iou(d[3:7], t[3:7]), -t[1]) for t in truth if t[0] == d[0] and t[2] == d[2]]
        cands = [c for c in cands if c[0] >= 0.5]
        if cands:
            best[d[1]] = max(cands)
    hits = {}
    for d in sorted(det, key=lambda d: (-d[7], d[1])):
        if d[1] in best and best[d[1]][0] >= threshold:
            hits.setdefault(best[d[1]][1], d[1])
    return set(hits.values())


def test_matching_and_metrics(spark):
    truth = crowd(120, 4, spread=40)
    rnd = random.Random(9)
    det = [(r[0], i, r[2], r[3] + rnd.uniform(-2, 2), r[4] + rnd.uniform(-2, 2), r[5] + rnd.uniform(-2, 2), r[6] + rnd.uniform(-2, 2),
            rnd.randint(0, 40) / 40) for i, r in enumerate(truth) if rnd.random() < 0.8]
    det += [(1, 5000 + i, 0, 500.0 + i, 0.0, 510.0 + i, 10.0, 0.5) for i in range(5)]
    ddf, tdf = boxes(spark, det), boxes(spark, truth, False)
    want = {(d[1], t[1]) for d in det for t in truth if d[0] == t[0] and d[2] == t[2] and iou(d[3:7], t[3:7]) >= 0.5}
    assert {(r.det_id, r.truth_id) for r in D.match_boxes(ddf, tdf, 0.5).collect()} == want
    hits = voc(det, truth, 0.5)
    marked = D.label_detections(ddf, tdf, 0.5)
    assert {r.box_id for r in marked.filter("is_tp").collect()} == hits
    curve = {(r.cls, r.conf): (r.tp, r.fp) for r in D.precision_recall_curve(marked, tdf).collect()}
    for cls in (0, 1):
        for c in {d[7] for d in det if d[2] == cls}:
            above = [d[1] for d in det if d[2] == cls and d[7] >= c]
            tp = len([d for d in above if d in hits])
            assert curve[(cls, c)] == (tp, len(above) - tp)
    metrics = {r.cls: r for r in D.detection_metrics(ddf, tdf, 0.25, 0.5).collect()}
    for cls in (0, 1):
        n = len([t for t in truth if t[2] == cls])
        aps = []
        for level in D.THRESHOLDS:
            at = voc(det, truth, level)
            points = []
            for c in {d[7] for d in det if d[2] == cls}:
                above = [d[1] for d in det if d[2] == cls and d[7] >= c]
                tp = len([d for d in above if d in at])
                points.append((tp * 100, tp / len(above)))
            aps.append(sum(max([p for r, p in points if r >= k * n], default=0.0) for k in range(101)) / 101)
        assert metrics[cls].ap50 == pytest.approx(aps[0]) and metrics[cls].map == pytest.approx(sum(aps) / 10)
        above = [d[1] for d in det if d[2] == cls and d[7] >= 0.25]
        assert metrics[cls].recall == pytest.approx(len([d for d in above if d in hits]) / n)
        assert metrics[cls].precision == pytest.approx(len([d for d in above if d in hits]) / len(above))


def test_average_precision_by_hand(spark):
    """Three truth boxes; right, wrong, right by falling confidence: precision 1 up to 1/3, 2/3 up to 2/3, then 0."""
    truth = [(1, i, 0, 100.0 * i, 0.0, 100.0 * i + 10, 10.0) for i in range(3)]
    det = [(1, 10, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 11, 0, 50.0, 50.0, 60.0, 60.0, 0.8), (1, 12, 0, 100.0, 0.0, 110.0, 10.0, 0.7)]
    row = D.detection_metrics(boxes(spark, det), spark.createDataFrame(truth, BOXES)).first()
    want = (34 * 1 + 33 * 2 / 3) / 101
    assert row.ap50 == pytest.approx(want) and row.map == pytest.approx(want)
    assert (row.n_truth, row.n_det, row.n_tp) == (3, 3, 2)


def test_confusion(spark):
    truth = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 100.0, 0.0, 110.0, 10.0), (1, 2, 0, 200.0, 0.0, 210.0, 10.0)]
    det = [(1, 10, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 11, 0, 100.0, 0.0, 110.0, 10.0, 0.8), (1, 12, 1, 300.0, 0.0, 310.0, 10.0, 0.7),
           (1, 13, 0, 0.0, 0.0, 10.0, 9.0, 0.6), (1, 14, 0, 200.0, 0.0, 210.0, 10.0, 0.1)]
    got = {(r.true_cls, r.pred_cls): r.n for r in D.confusion_matrix(
        boxes(spark, det), spark.createDataFrame(truth, BOXES)).collect()}
    assert got == {(0, 0): 1, (1, 0): 1, (0, -1): 1, (-1, 0): 1, (-1, 1): 1}


def test_best_and_filter(spark):
    df = boxes(spark, crowd(60, 6))
    top = D.best_detections(df, 3)
    assert top.groupBy("image_id").count().filter("count <> 3").count() == 0
    assert D.filter_conf(df, 0.5).filter("conf < 0.5").count() == 0
    with pytest.raises(ValueError):
        D.match_boxes(df, df, 0.0)


def test_dashboard(spark):
    t = dt.datetime(2024, 1, 1)
    arrivals = spark.createDataFrame(
        [(1, i, d, f, t + dt.timedelta(seconds=s)) for i, (d, f, s) in enumerate([(1, 1, 0), (1, 2, 8), (2, 5, 2), (3, 9, 99)])],
        "session_id bigint, packet_id bigint, drone_id int, frame_num bigint, arrival_ts timestamp")
    det = spark.createDataFrame([(1, 1, 2, 0.9), (1, 1, 2, 0.25), (1, 1, 2, 0.1), (1, 1, 1, 0.9), (1, 2, 4, 0.9)],
                                "session_id bigint, drone_id int, frame_num bigint, conf double")
    as_of = F.lit("2024-01-01 00:00:10").cast("timestamp")
    got = [(r.title, r.frame_num, r.status, r.state) for r in D.camera_dashboard(det, arrivals, as_of).orderBy("drone_id").collect()]
    assert got == [("Camera 001", 2, "2 TARGETS", "ACTIVE"), ("Camera 002", 5, "NO TARGETS", "INACTIVE")]


def replayed(det, truth, limit):
    """Detections one after the other, each with the best free truth box."""
    out = set()
    for key in {(d[0], d[2]) for d in det}:
        free = {t[1]: t for t in truth if (t[0], t[2]) == key}
        for d in sorted((d for d in det if (d[0], d[2]) == key), key=lambda d: (-d[7], d[1])):
            wanted = sorted((-iou(d[3:7], t[3:7]), i) for i, t in free.items() if iou(d[3:7], t[3:7]) >= limit)
            if wanted:
                out.add((*key, d[1], wanted[0][1]))
                del free[wanted[0][1]]
    return out


@pytest.mark.parametrize("limit,spread,images", [(0.2, 20, 2), (0.5, 60, 3), (0.1, 8, 1)])
def test_greedy_matching_equals_a_replay(spark, limit, spread, images):
    det, truth = crowd(140, 7, images, spread), crowd(120, 8, images, spread)
    got = D.greedy_matches(boxes(spark, det), boxes(spark, truth, False), limit)
    assert {(r.image_id, r.cls, r.det_id, r.truth_id) for r in got.collect()} == replayed(det, truth, limit)
    assert D.greedy_matches(boxes(spark, det), boxes(spark, truth[:0] or [(99, 1, 0, 0.0, 0.0, 1.0, 1.0)], False), limit).count() == 0


def test_next_best_box_in_a_chain(spark):
    """Each detection overlaps its own box best but the next one too; the first takes over all of the chain."""
    truth = [(1, i, 0, 10.0 * i, 0.0, 10.0 * i + 20, 10.0) for i in range(30)]
    det = [(1, i, 0, 10.0 * i + 4.9, 0.0, 10.0 * i + 24.9, 10.0, 1 - i / 100) for i in range(30)] + [(1, 99, 0, 0.0, 0.0, 20.0, 10.0, 1.0)]
    got = D.greedy_matches(boxes(spark, det), boxes(spark, truth, False), 0.3)
    assert {(r.image_id, r.cls, r.det_id, r.truth_id) for r in got.collect()} == replayed(det, truth, 0.3)


def test_rules_of_matching(spark):
    truth = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 2, 0, 2.0, 0.0, 12.0, 10.0)]
    det = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0, .9), (1, 2, 0, 0.0, 0.0, 10.0, 9.9, .8), (1, 3, 0, 0.0, 0.0, 10.0, 10.0, None)]
    d, t = boxes(spark, det), boxes(spark, truth, False)
    flags = {rule: {r.box_id for r in D.label_detections(d, t, 0.5, rule).filter("is_tp").collect()} for rule in ("voc", "greedy")}
    assert flags == {"voc": {1}, "greedy": {1, 2}}
    rows = {rule: D.detection_metrics(d, t, rule=rule).first() for rule in ("voc", "greedy")}
    assert (rows["voc"].n_tp, rows["greedy"].n_tp) == (1, 2) and rows["greedy"].ap50 > rows["voc"].ap50
    with pytest.raises(ValueError):
        D.label_detections(d, t, rule="best")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [0, 40, 512])
def test_pairs_do_not_depend_on_the_plan(spark, monkeypatch, limit):
    monkeypatch.setattr("swarmframe.plans.boxes.GROUP_LIMIT", limit)
    det, truth = crowd(60, 11, images=4) + [(None, 900, 0, 0.0, 0.0, 5.0, 5.0, .5), (1, 901, None, 0.0, 0.0, 5.0, 5.0, .5)], crowd(60, 12, images=2)
    det += [(9, 1000 + i, 0, 0.0, 0.0, float(i), 9.0, .5) for i in range(3)]  # an image without truth, and a box without area
    for aware in (True, False):
        got = [(r.det_id, r.truth_id) for r in D.match_boxes(boxes(spark, det), boxes(spark, truth, False), 0.3, aware).collect()]
        want = [(a[1], b[1]) for a in det for b in truth if a[0] == b[0] and a[2] is not None and (a[2] == b[2] or not aware) and iou(a[3:7], b[3:7]) >= 0.3]
        assert sorted(got) == sorted(want)


def test_images_of_usual_size_do_not_search_cells(spark):
    det, truth = boxes(spark, crowd(60, 13)), boxes(spark, crowd(60, 14), False)
    assert "_x_cell" not in _plan(D.match_boxes(det, truth)) and "_x_cell" not in _plan(D.best_matches(det, truth, class_aware=False))
    big = boxes(spark, crowd(1200, 13, images=1, copies=False))
    assert "_x_cell" in _plan(D.match_boxes(big, truth))


@pytest.mark.parametrize("groups, pairs", [(0, 2048), (512, 0), (512, 2048), (40, 30)])
def test_greedy_does_not_depend_on_the_plan(spark, monkeypatch, groups, pairs):
    """In the grid or not, folded or in rounds; some ids of detections come twice, with the same and with another confidence."""
    det, truth = crowd(60, 15, images=3, spread=25), crowd(60, 16, images=3, spread=25)
    det += [det[3], (*det[4][:7], .77), (*det[5][:3], *[x + 1 for x in det[5][3:7]], .01)]
    d, t = boxes(spark, det), boxes(spark, truth, False)

    def found():
        rows = sorted(tuple(r) for r in D.greedy_matches(d, t, 0.3).collect())
        metrics = D.detection_metrics(d, t, thresholds=[0.3, 0.5, 0.7], rule="greedy").orderBy("cls").collect()
        return rows, [[round(x, 9) for x in r] for r in metrics]

    monkeypatch.setattr(D, "PAIR_LIMIT", 0)
    want = found()
    monkeypatch.setattr("swarmframe.plans.boxes.GROUP_LIMIT", groups)
    monkeypatch.setattr(D, "PAIR_LIMIT", pairs)
    assert found() == want


def test_greedy_of_usual_images_needs_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(D, "_assigned", None)
    det = crowd(60, 17, images=3, spread=25, copies=False)
    assert D.greedy_matches(boxes(spark, det), boxes(spark, det, False), 0.3).count() == 60


def test_more_levels_than_bits(spark, monkeypatch):
    d, t = boxes(spark, crowd(60, 19, spread=25, copies=False)), boxes(spark, crowd(60, 20, spread=25, copies=False), False)
    levels = [0.3, 0.4, 0.5, 0.6, 0.7]

    def found(rule):
        return [[round(x, 9) for x in r] for r in D.detection_metrics(d, t, thresholds=levels, rule=rule).orderBy("cls").collect()]

    want = found("greedy")
    monkeypatch.setattr(D, "_BITS", 2)
    assert found("greedy") == want
