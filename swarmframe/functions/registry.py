"""SQL names for the scalar functions: temporary SQL functions, which Catalyst inlines.

The body of each is the SQL text of the column function's own expression, so the two cannot differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from swarmframe.functions import bytes as B
from swarmframe.functions import geometry as G
from swarmframe.functions import packet as P
from swarmframe.functions import text as T

_INTR = "STRUCT<fx: FLOAT, fy: FLOAT, cx: FLOAT, cy: FLOAT>"
_POS = "STRUCT<tx: FLOAT, ty: FLOAT, tz: FLOAT>"
_BOX = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"

#: SQL name: (arguments, column function). ``position`` is a name of Spark's own, hence ``camera_position``.
DEFINITIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "u32_le": ("b BINARY, off INT", B.u32_le),
    "f64_le": ("b BINARY, off INT", B.f64_le),
    "f64_from_bits": ("v BIGINT", B.bits_to_f64),
    "decode_header": ("b BINARY", P.decode_header),
    "packet_info": ("b BINARY", P.packet_info),
    "packet_sections": ("b BINARY", P.packet_sections),
    "decode_vec3": ("b BINARY", G.decode_vec3),
    "rodrigues": ("v ARRAY<DOUBLE>", G.rodrigues),
    "to_float32": ("v ARRAY<DOUBLE>", G.to_float32),
    "parse_camera_matrix": ("s STRING", G.parse_camera_matrix),
    "parse_distortion": ("s STRING", G.parse_distortion),
    "intrinsics": ("k ARRAY<ARRAY<FLOAT>>", G.intrinsics),
    "camera_position": ("v ARRAY<FLOAT>", G.position),
    "scale_box": (f"box {_BOX}, sx DOUBLE, sy DOUBLE", G.scale_box),
    "box_iou": ("ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE", G.box_iou),
    "frame_key": ("n BIGINT", T.frame_key),
    "sample_name": ("folder STRING, stem STRING", T.sample_name),
    "overlay_text": (f"drone INT, frame BIGINT, intr {_INTR}, pos {_POS}", T.overlay_text),
    "footer_text": ("frame BIGINT, fps DOUBLE", T.footer_text),
    "grid_cell": ("drone INT", T.grid_cell),
    "detection_status": ("n BIGINT", T.detection_status),
    "active_label": ("active BOOLEAN", T.active_label),
    "detection_label": ("conf DOUBLE", T.detection_label),
}

#: Fields of the above under names of their own.
SHORT = {"grid_row": ("drone INT", "grid_cell(drone).row"), "grid_col": ("drone INT", "grid_cell(drone).col")}


def register(spark: SparkSession) -> list[str]:
    """Create the SQL functions in this session and return their names."""
    for name, (args, function) in DEFINITIONS.items():
        table = spark.createDataFrame([], args)
        out = table.select(function(*[F.col(c) for c in table.columns]).alias("r"))
        body = out._jdf.queryExecution().analyzed().projectList().head().child().sql()
        returns = out.schema["r"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    for name, (args, body) in SHORT.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS INT RETURN {body}")
    return [*DEFINITIONS, *SHORT]
