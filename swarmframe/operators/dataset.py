"""Labelled-image datasets: pairing, counting, checking and the split manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmframe.functions.text import sample_name

# The split each folder belongs to.
SPLITS = {"D1": "train", "D2": "train", "D3": "train", "D4": "train", "D5": "train", "D6": "train",
          "D7": "val", "D8": "test"}


def union_scans(png: DataFrame, jpg: DataFrame) -> DataFrame:
    """Both image scans as one bag."""
    return png.unionByName(jpg)


def attach_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Every image with the path of its label, null where it has none; a png and a jpg of one stem share it."""
    found = labels.select("folder", "stem", F.col("path").alias("label_path"))
    return images.join(found, ["folder", "stem"], "left")


def with_split(df: DataFrame, split_map: Mapping[str, str] = SPLITS) -> DataFrame:
    """Add ``split`` by folder; folders outside the map are left out."""
    name = F.create_map(*[F.lit(x) for pair in split_map.items() for x in pair])
    return df.withColumn("split", F.try_element_at(name, F.col("folder"))).filter(F.col("split").isNotNull())


def split_counts(images: DataFrame, split_map: Mapping[str, str] = SPLITS) -> DataFrame:
    """Images per folder of the map, absent folders included with ``present`` false, and the total of each split.

    A folder counts as present when the scan returned a file from it.
    """
    wanted = images.sparkSession.createDataFrame(list(split_map.items()), "folder string, split string")
    counts = (images.filter(F.col("folder").isin(*split_map)).groupBy("folder").agg(F.count("*").alias("_n")))
    per_folder = wanted.join(counts, "folder", "left").select(
        "split", "folder", F.coalesce("_n", F.lit(0)).alias("n_images"), F.col("_n").isNotNull().alias("present"))
    totals = per_folder.groupBy("split").agg(F.sum("n_images").alias("split_images"))
    return per_folder.join(totals, "split")


def verify_dataset(images: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: images and labels per split, ``error`` and ``warning`` texts (null where all is well).

    Training and validation need images; their image and label counts should agree. Test is never checked.
    """
    def counts(df: DataFrame, kind: str) -> DataFrame:
        return df.groupBy("split").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))

    both = counts(images, "images").unionByName(counts(labels, "labels"))
    sums = both.agg(*[
        F.coalesce(F.sum(F.when((F.col("split") == s) & (F.col("kind") == k), F.col("n"))), F.lit(0))
        .cast("bigint").alias(f"{s}_{k}") for s in ("train", "val", "test") for k in ("images", "labels")])
    error = (F.when(F.col("train_images") == 0, "no training images")
             .when(F.col("val_images") == 0, "no validation images"))
    warning = F.concat_ws("; ", *[F.when(F.col(f"{s}_images") != F.col(f"{s}_labels"), f"{s} image/label mismatch")
                                  for s in ("train", "val")])
    return sums.select("*", error.alias("error"), F.when(warning != "", warning).alias("warning"))


def split_manifest(labelled: DataFrame, split_map: Mapping[str, str] = SPLITS) -> DataFrame:
    """Source and target of every image and label: ``images/<split>/<folder>_<stem><suffix>`` and so on.

    A label shared by a png and a jpg is listed once.
    """
    rows = with_split(labelled, split_map).withColumn("_name", sample_name("folder", "stem"))
    images = rows.select("split", F.lit("image").alias("kind"), F.col("path").alias("src"),
                         F.concat_ws("/", F.lit("images"), "split", F.concat("_name", "suffix")).alias("dst"))
    labels = (rows.filter(F.col("label_path").isNotNull())
              .select("split", F.lit("label").alias("kind"), F.col("label_path").alias("src"),
                      F.concat_ws("/", F.lit("labels"), "split", F.concat("_name", F.lit(".txt"))).alias("dst"))
              .distinct())
    return images.unionByName(labels)


def write_split(labelled: DataFrame, out: str, split_map: Mapping[str, str] = SPLITS) -> None:
    """Write the manifest below ``out``, one folder per split; an earlier manifest is replaced."""
    split_manifest(labelled, split_map).write.partitionBy("split").mode("overwrite").parquet(out)
