"""Calibration XML files as tables. Unusable files become rows with an error kind, they never stop the job.

An element is the first of its name at any depth below the root, its data the first ``data`` element at any depth below that, so files
of any layout are read. Spark's own XML functions need a schema (``from_xml``) or end the job at a damaged file (``xpath``), so
the lookup is a few lines of Python over Arrow batches; what is found is judged in column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from swarmframe.functions.paths import calibration_path
from swarmframe.functions.geometry import strip_text
from swarmframe.plans.once import computed_once

VECTOR_SIZE = 24


def _scan(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    text = (spark.read.option("pathGlobFilter", f"{prefix}_Drone*_*.xml")
            .option("recursiveFileLookup", "true").text(root, wholetext=True).select(
                F.col("_metadata.file_name").alias("_name"), F.col("value").alias("xml")))
    found = text.select(calibration_path("_name", prefix).alias("_at"), "xml").filter(F.col("_at").isNotNull())
    return found.select("_at.drone_id", "_at.frame_num", "xml")


def _elements(df: DataFrame, xml: str, names: Sequence[str]) -> DataFrame:
    """Replace the XML column by ``_corrupt`` and, for each name, ``_has_<name>``, ``_type_<name>`` and ``_text_<name>`` of its data."""
    kept = df.select(*[c for c in df.columns if c != xml], F.col(xml).cast("string").alias("_xml"))
    fields = [StructField("_corrupt", BooleanType())]
    for name in names:
        fields += [StructField(f"_has_{name}", BooleanType()), StructField(f"_type_{name}", StringType()), StructField(f"_text_{name}", StringType())]
    columns, types = [f.name for f in fields], [pa.bool_() if isinstance(f.dataType, BooleanType) else pa.string() for f in fields]

    # a local function travels to the workers with its code
    def looked_up(text: str | None) -> list:
        try:
            root = ElementTree.fromstring(text or "")
        except (ElementTree.ParseError, ValueError):
            return [True, *[None] * (len(columns) - 1)]
        out: list = [False]
        for name in names:
            element = root.find(f".//{name}")
            data = None if element is None else element.find(".//data")
            out += [element is not None, None, None] if data is None else [True, data.get("type_id"), data.text or ""]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [looked_up(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            found = list(zip(*rows, strict=True)) or [()] * len(columns)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, t) for c, t in zip(found, types, strict=True)]],
                                             names=[*batch.schema.names[:-1], *columns])

    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], *fields]))


def parse_intrinsic_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Replace an XML column by k_text, dist_text (null where absent) and error_kind (``corrupt`` or null)."""
    kept = [c for c in df.columns if c != xml]
    found = _elements(df, xml, ["camera_matrix", "distortion_coefficients"])
    fields = found.select(*kept, strip_text(F.col("_text_camera_matrix")).alias("k_text"),
                          strip_text(F.col("_text_distortion_coefficients")).alias("dist_text"), F.when(F.col("_corrupt"), "corrupt").alias("error_kind"))
    return computed_once(fields, kept, ["k_text", "dist_text", "error_kind"])


def parse_extrinsic_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Replace an XML column by rvec and tvec (last 24 bytes of the base64 data) and error_kind.

    Kinds: corrupt, rvec_not_found, rvec_not_binary, rvec_bad_base64, and the same for tvec.
    """
    kept = [c for c in df.columns if c != xml]
    found = _elements(df, xml, ["rvec", "tvec"])
    blobs = found.withColumns({f"_{n}": F.try_to_binary(F.regexp_replace(f"_text_{n}", r"\s+", ""), F.lit("base64")) for n in ("rvec", "tvec")})
    kind = F.when(F.col("_corrupt"), "corrupt")
    for name in ("rvec", "tvec"):
        binary = F.coalesce(F.col(f"_type_{name}") == "binary", F.lit(False))
        kind = (kind.when(~F.col(f"_has_{name}"), f"{name}_not_found").when(~binary, f"{name}_not_binary")
                .when(F.col(f"_{name}").isNull() | (F.length(f"_{name}") < VECTOR_SIZE), f"{name}_bad_base64"))
    checked = blobs.withColumn("error_kind", kind)
    fields = checked.select(*kept, *[
        F.when(F.col("error_kind").isNull(), F.substring(f"_{n}", -VECTOR_SIZE, VECTOR_SIZE)).alias(n)
        for n in ("rvec", "tvec")], "error_kind")
    return computed_once(fields, kept, ["rvec", "tvec", "error_kind"])


def scan_intrinsics(spark: SparkSession, root: str) -> DataFrame:
    """``intr_Drone<d>_<nnnn>.xml`` -> drone_id, frame_num, k_text, dist_text, error_kind."""
    return parse_intrinsic_xml(_scan(spark, root, "intr"))


def scan_extrinsics(spark: SparkSession, root: str) -> DataFrame:
    """``extr_Drone<d>_<nnnn>.xml`` -> drone_id, frame_num, rvec, tvec, error_kind."""
    return parse_extrinsic_xml(_scan(spark, root, "extr"))
