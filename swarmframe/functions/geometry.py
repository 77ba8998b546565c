"""Camera geometry and box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmframe.functions.bytes import f64_le

# Below this angle the rotation is the identity (double epsilon).
EPSILON = 2.220446049250313e-16

# The white space a camera text is split on.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The number spellings a camera text may hold.
NUMBER = (r"[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?"
          r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_vec3(b: Column | str) -> Column:
    """Three doubles in 24 bytes -> array<double>."""
    return F.array(*[f64_le(b, 8 * i) for i in range(3)])


def to_float32(vec: Column | str) -> Column:
    """Narrow a 3-vector to single precision."""
    vec = _col(vec)
    return F.when(vec.isNotNull(), F.array(*[F.get(vec, F.lit(i)).cast("float") for i in range(3)]))


def _rotation_cell(i: int, j: int, cos: Column, sin: Column, axis: list[Column]) -> Column:
    value = (F.lit(1.0) - cos) * axis[i] * axis[j]
    if i == j:
        return cos + value
    turn = sin * axis[3 - i - j]
    return value - turn if (j - i) % 3 == 1 else value + turn


def rodrigues(rvec: Column | str) -> Column:
    """Rotation vector (array<double>, size 3) -> 3x3 single-precision rotation matrix.

    For vectors that are costly to compute use ``with_rotation``.
    """
    rvec = _col(rvec)
    parts = [F.get(rvec, F.lit(i)) for i in range(3)]
    theta = F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])
    # below the limit the axis is zero and the angle too, which leaves the identity
    still = theta < EPSILON
    angle = F.when(still, F.lit(0.0)).otherwise(theta)
    axis = [F.when(still, F.lit(0.0)).otherwise(p / theta) for p in parts]
    cos, sin = F.cos(angle), F.sin(angle)
    rows = [F.array(*[_rotation_cell(i, j, cos, sin, axis).cast("float") for j in range(3)]) for i in range(3)]
    return F.when(theta.isNotNull(), F.array(*rows))


def with_rotation(df: DataFrame, vector: list[str], name: str) -> DataFrame:
    """Replace three double columns by the rotation matrix ``name``; angle, axis and cells in a projection each."""
    kept = [c for c in df.columns if c not in vector]
    x, y, z = (F.col(c) for c in vector)
    still = F.col("_theta") < EPSILON
    step = df.select(*df.columns, F.sqrt(x * x + y * y + z * z).alias("_theta"))
    step = step.select(
        *kept, F.cos(F.when(still, F.lit(0.0)).otherwise(F.col("_theta"))).alias("_cos"),
        F.sin(F.when(still, F.lit(0.0)).otherwise(F.col("_theta"))).alias("_sin"),
        *[F.when(still, F.lit(0.0)).otherwise(F.col(c) / F.col("_theta")).alias(f"_axis{i}") for i, c in enumerate(vector)])
    axis = [F.col(f"_axis{i}") for i in range(3)]
    rows = [F.array(*[_rotation_cell(i, j, F.col("_cos"), F.col("_sin"), axis).cast("float") for j in range(3)])
            for i in range(3)]
    return step.select(*kept, F.when(F.col("_cos").isNotNull(), F.array(*rows)).alias(name))


def strip_text(text: Column | str) -> Column:
    """Remove white space at both ends, line breaks included."""
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def is_number_list(text: Column | str) -> Column:
    """True where the whole text is numbers separated by white space (blank text counts as an empty list)."""
    return _col(text).rlike(f"^{SPACE}*(?:{NUMBER}(?:{SPACE}+{NUMBER})*{SPACE}*)?$")


def number_tokens(text: Column | str) -> Column:
    """The white-space separated tokens of a text, spelled so that a cast reads them."""
    plain = F.translate(_col(text), "_", "")
    signed = F.contains(F.lower(plain), F.lit("nan"))
    plain = F.when(signed, F.regexp_replace(plain, "(?i)[+-](?=nan)", "")).otherwise(plain)
    return F.array_remove(F.split(plain, f"{SPACE}+"), "")


def is_camera_matrix(text: Column | str) -> Column:
    """True where the text is exactly nine numbers."""
    return _col(text).rlike(f"^{SPACE}*{NUMBER}(?:{SPACE}+{NUMBER}){{8}}{SPACE}*$")


def _floats(tokens: Column | str) -> Column:
    return _col(tokens).try_cast("array<double>").cast("array<float>")


def matrix_of(tokens: Column | str) -> Column:
    """3x3 matrix of nine tokens."""
    numbers = _floats(tokens)
    return F.array(*[F.slice(numbers, 3 * i + 1, 3) for i in range(3)])


def five_of(tokens: Column | str) -> Column:
    """First five tokens as numbers, padded with zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 5)
    return F.slice(F.concat(_floats(tokens), zeros), 1, 5)


def parse_camera_matrix(text: Column | str) -> Column:
    """Nine numbers -> 3x3 matrix; null for null, empty or unusable text (see ``is_camera_matrix``)."""
    return F.when(is_camera_matrix(text), matrix_of(number_tokens(text)))


def parse_distortion(text: Column | str) -> Column:
    """First five numbers, padded with zeros; all zeros for null or empty text; null where a token is no number."""
    text = _col(text)
    zeros = F.array(*[F.lit(0.0).cast("float")] * 5)
    return F.when(text.isNull(), zeros).when(is_number_list(text), five_of(number_tokens(text)))


def intrinsics(k: Column | str) -> Column:
    """fx, fy, cx, cy of a 3x3 camera matrix."""
    k = _col(k)

    def at(i: int, j: int) -> Column:
        return F.get(F.get(k, F.lit(i)), F.lit(j))

    return F.struct(at(0, 0).alias("fx"), at(1, 1).alias("fy"), at(0, 2).alias("cx"), at(1, 2).alias("cy"))


def position(t: Column | str) -> Column:
    """The translation as x, y, z, as the overlay shows it (not the camera centre ``-R't``)."""
    t = _col(t)
    return F.struct(*[F.get(t, F.lit(i)).alias(name) for i, name in enumerate(("tx", "ty", "tz"))])


def scale_box(box: Column | str, s: Column | float, sy: Column | float | None = None) -> Column:
    """Box struct (x1, y1, x2, y2) in the coordinates of an image resized by ``s`` (or ``s`` across, ``sy`` down)."""
    box = _col(box)
    across = F.lit(s) if not isinstance(s, Column) else s
    down = across if sy is None else (F.lit(sy) if not isinstance(sy, Column) else sy)
    return F.struct((box["x1"] * across).alias("x1"), (box["y1"] * down).alias("y1"),
                    (box["x2"] * across).alias("x2"), (box["y2"] * down).alias("y2"))


def box_iou(ax1: Column, ay1: Column, ax2: Column, ay2: Column,
            bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    zero = F.lit(0.0)
    inter = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), zero) * \
        F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), zero)
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when(union > 0, inter / union).otherwise(zero)
