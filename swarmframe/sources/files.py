"""Image folders as tables: names only, the pixels stay on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmframe.functions.paths import frame_path, image_path, label_path


#: Spark packs a few dozen small files into a split; a task takes up to so many splits.
SPLITS_PER_TASK = 256


def _packed(files: DataFrame) -> DataFrame:
    """``files`` in tasks of many splits, as a row here is a name: as many as keep all cores busy, more where there are many files."""
    splits, cores = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(1, min(splits, max(4 * cores, -(-splits // SPLITS_PER_TASK)))))


def _listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    # without the content column the files are listed but never opened
    return _packed(spark.read.format("binaryFile").option("pathGlobFilter", glob)
                   .option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime"))


def _part(pattern: str, group: int = 1) -> Column:
    value = F.regexp_extract("path", pattern, group)
    return F.when(value != "", value)


def _frames(files: DataFrame, *columns: str) -> DataFrame:
    return files.withColumn("_at", frame_path("path")).filter(F.col("_at").isNotNull()).select(
        "_at.drone_id", "_at.frame_num", *columns)


def scan_frames(spark: SparkSession, root: str) -> DataFrame:
    """``D<drone>/<frame>.png`` below ``root`` -> drone_id, frame_num, path, length; other names are left out."""
    return _frames(_listed(spark, root, "*.png"), "path", "length")


def read_frames(spark: SparkSession, root: str) -> DataFrame:
    """``scan_frames`` with the file bytes in ``content``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.png")
             .option("recursiveFileLookup", "true").load(root))
    return _frames(files, "path", "length", "content")


def scan_split_images(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``D*/<stem>.png`` and ``.jpg``, and ``D*/labels/<stem>.txt`` directly below ``root`` -> (images, labels).

    images: folder, stem, suffix, path. labels: folder, stem, path. One listing serves both. The folders are listed, not each file
    that a pattern names; what lies deeper is left out by its path.
    """
    folders = f"{root.rstrip('/')}/D*"
    at = spark._jvm.org.apache.hadoop.fs.Path(folders)
    depth = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).depth()
    files = _listed(spark, folders, "{*.png,*.jpg,*.txt}").select("path")
    names = F.split(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")  # the first one is empty
    files = files.withColumn("_below", F.size(names) - 1 - depth)
    images = files.filter("_below = 1").withColumn("_at", image_path("path")).filter(F.col("_at").isNotNull()).select(
        "_at.folder", "_at.stem", "_at.suffix", "path")
    labels = files.filter("_below = 2").withColumn("_at", label_path("path")).filter(F.col("_at").isNotNull()).select("_at.folder", "_at.stem", "path")
    return images, labels


def scan_split(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """A prepared tree ``images/<split>/*`` and ``labels/<split>/*`` -> (images, labels) with split, name, path."""
    def part(glob: str, kind: str, suffix: str) -> DataFrame:
        pattern = rf"(?:^|/){kind}/([^/]+)/([^/]+)\.{suffix}$"
        return _listed(spark, root, glob).select(
            _part(pattern, 1).alias("split"), _part(pattern, 2).alias("name"), "path") \
            .filter(F.col("split").isNotNull())

    images = part("*.png", "images", "png").unionByName(part("*.jpg", "images", "jpg"))
    return images, part("*.txt", "labels", "txt")
