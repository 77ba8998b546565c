"""Labelled-image queries over the documents and labels views."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmframe.functions.paths import calibration_path, frame_path, image_path, label_path
from swarmframe.functions.text import frame_key, sample_name
from swarmframe.operators import dataset as D
from swarmframe.queries.views import IMAGES, images, label_files, table
from swarmframe.session import scratch_path
from swarmframe.sources import scan_frames, scan_split_images, write_tree


def _labelled(spark, sf):
    return D.attach_labels(images(spark, sf), label_files(spark, sf))


def attached(spark, sf):
    return _labelled(spark, sf).select("folder", "stem", "suffix", "path", "label_path")


def counts(spark, sf):
    """One folder of the map, D9, has no image."""
    return D.split_counts(images(spark, sf), {**D.SPLITS, "D9": "test"})


def path_rules(spark, sf):
    """Paths of every kind, right and wrong ones, built from the document ids."""
    n = F.col("doc_id")
    key, drone = frame_key("doc_id"), (n % 8 + 1).cast("string")
    kinds = [F.concat(F.lit("run/D"), drone, F.lit("/"), key, F.lit(".png")),
             F.concat(F.lit("D"), drone, F.lit("/"), n.cast("string"), F.lit(".png")),
             F.concat(F.lit("run/E"), drone, F.lit("/"), key, F.lit(".png")),
             F.concat(F.lit("intrinsic/intr_Drone"), drone, F.lit("_"), key, F.lit(".xml")),
             F.concat(F.lit("extrinsic/extr_Drone"), drone, F.lit("_"), key, F.lit(".xml")),
             F.concat(F.lit("set/D"), drone, F.lit("/labels/"), key, F.lit(".txt")),
             F.concat(F.lit("set/D"), drone, F.lit("/"), key, F.lit(".jpg")),
             F.concat(F.lit("set/D"), drone, F.lit("/"), key, F.lit(".gif"))]
    paths = table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*kinds), (F.floor(n / 8) % 8 + 1).cast("int")).alias("path"))
    frame, intr, extr = frame_path("path"), calibration_path("path", "intr"), calibration_path("path", "extr")
    image, label = image_path("path"), label_path("path")
    return paths.select("doc_id", frame["drone_id"].alias("frame_drone"), frame["frame_num"].alias("frame_num"),
                        intr["frame_num"].alias("intr_frame"), extr["drone_id"].alias("extr_drone"),
                        image["folder"].alias("image_folder"), image["stem"].alias("image_stem"), image["suffix"].alias("suffix"),
                        label["folder"].alias("label_folder"), label["stem"].alias("label_stem"))


def scanned_frames(spark, sf):
    """The images written as frame files, and the frames found among them."""
    root = scratch_path(spark, "frames")
    rows = images(spark, sf)
    write_tree(rows, root, F.concat(F.lit("image_subsets/"), F.col("path")), F.concat(F.lit("image "), F.col("stem")))
    return scan_frames(spark, root).select("drone_id", "frame_num", F.substring_index("path", "/", -2).alias("path"), "length")


def scanned_split(spark, sf):
    """The images and label files written as a tree, listed and matched again."""
    root = scratch_path(spark, "split")
    write_tree(images(spark, sf), root, F.col("path"), F.col("stem"))
    write_tree(label_files(spark, sf), root, F.col("path"), F.col("stem"))
    found, labels = scan_split_images(spark, root)
    rows = D.attach_labels(found, labels)
    return rows.select("folder", "stem", "suffix", F.substring_index("path", "/", -2).alias("path"),
                       F.substring_index("label_path", "/", -3).alias("label_path"))


def verified(spark, sf):
    return D.verify_dataset(D.with_split(images(spark, sf)), D.with_split(label_files(spark, sf)))


def names(spark, sf):
    return images(spark, sf).select("path", sample_name("folder", "stem").alias("name"))


def manifest(spark, sf):
    return D.split_manifest(_labelled(spark, sf))


_MAP = "(VALUES ('D1', 'train'), ('D2', 'train'), ('D3', 'train'), ('D4', 'train'), ('D5', 'train'), " \
       "('D6', 'train'), ('D7', 'val'), ('D8', 'test'), ('D9', 'test')) m(folder, split)"
_SPLIT = "CASE WHEN folder = 'D7' THEN 'val' WHEN folder = 'D8' THEN 'test' ELSE 'train' END"

QUERIES = {
    "path_rules": (path_rules, """
WITH p AS (SELECT doc_id, doc_id // 8 % 8 AS kind, doc_id % 8 + 1 AS drone, printf('%04d', doc_id) AS key FROM documents)
SELECT doc_id, CASE WHEN kind = 0 OR kind = 1 AND doc_id >= 1000 THEN drone END AS frame_drone,
       CASE WHEN kind = 0 OR kind = 1 AND doc_id >= 1000 THEN doc_id END AS frame_num,
       CASE WHEN kind = 3 THEN doc_id END AS intr_frame, CASE WHEN kind = 4 THEN drone END AS extr_drone,
       CASE WHEN kind IN (0, 1, 6) THEN 'D' || drone END AS image_folder,
       CASE WHEN kind IN (0, 6) THEN key WHEN kind = 1 THEN CAST(doc_id AS VARCHAR) END AS image_stem,
       CASE WHEN kind IN (0, 1) THEN '.png' WHEN kind = 6 THEN '.jpg' END AS suffix,
       CASE WHEN kind = 5 THEN 'D' || drone END AS label_folder, CASE WHEN kind = 5 THEN key END AS label_stem
FROM p"""),
    "attach_labels": (attached, f"WITH {IMAGES} SELECT folder, stem, suffix, path, label_path FROM labelled"),
    "scan_frames": (scanned_frames, f"""WITH {IMAGES}
SELECT CAST(substr(folder, 2) AS BIGINT) AS drone_id, CAST(stem AS BIGINT) AS frame_num, path, 6 + length(stem) AS length
FROM images WHERE suffix = '.png'"""),
    "scan_split_images": (scanned_split, f"WITH {IMAGES} SELECT folder, stem, suffix, path, label_path FROM labelled"),
    "union_scans": (lambda s, d: images(s, d), f"WITH {IMAGES} SELECT folder, stem, suffix, path FROM images"),
    "split_counts": (counts, f"""WITH {IMAGES},
n AS (SELECT folder, count(*) AS n FROM images GROUP BY ALL)
SELECT m.split, m.folder, coalesce(n, 0) AS n_images, n IS NOT NULL AS present,
       CAST(sum(coalesce(n, 0)) OVER (PARTITION BY m.split) AS BIGINT) AS split_images
FROM {_MAP} LEFT JOIN n ON n.folder = m.folder"""),
    "verify_dataset": (verified, f"""WITH {IMAGES},
i AS (SELECT {_SPLIT} AS split FROM images), l AS (SELECT {_SPLIT} AS split FROM label_files),
c AS (SELECT count(*) FILTER (WHERE split = 'train') AS train_images, count(*) FILTER (WHERE split = 'val') AS val_images,
             count(*) FILTER (WHERE split = 'test') AS test_images FROM i),
d AS (SELECT count(*) FILTER (WHERE split = 'train') AS train_labels, count(*) FILTER (WHERE split = 'val') AS val_labels,
             count(*) FILTER (WHERE split = 'test') AS test_labels FROM l)
SELECT *, CASE WHEN train_images = 0 THEN 'no training images' WHEN val_images = 0 THEN 'no validation images' END AS error,
       nullif(concat_ws('; ', CASE WHEN train_images <> train_labels THEN 'train image/label mismatch' END,
                        CASE WHEN val_images <> val_labels THEN 'val image/label mismatch' END), '') AS warning
FROM c, d"""),
    "sample_name": (names, f"WITH {IMAGES} SELECT path, folder || '_' || stem AS name FROM images"),
    "split_manifest": (manifest, f"""WITH {IMAGES}
SELECT split, 'image' AS kind, path AS src, 'images/' || split || '/' || folder || '_' || stem || suffix AS dst
FROM labelled
UNION ALL
SELECT DISTINCT split, 'label', label_path, 'labels/' || split || '/' || folder || '_' || stem || '.txt'
FROM labelled WHERE label_path IS NOT NULL"""),
}
