"""Calibration tables: joins of intrinsic and extrinsic data, comparison and the frame manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.functions.bytes import bits_to_f64, f64_bits_in_hex
from swarmframe.functions.geometry import (intrinsics, parse_camera_matrix, parse_distortion, position,
                                           with_rotation)
from swarmframe.operators.packets import outgoing_error
from swarmframe.plans.once import computed_once

KEYS = ["drone_id", "frame_num"]


def with_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace 24-byte columns by three double columns each (name0, name1, name2)."""
    kept = [c for c in df.columns if c not in columns]
    digits = df.select(*kept, *[F.when(F.length(c) == 24, F.hex(c)).alias(c) for c in columns])
    bits = digits.select(*kept, *[f64_bits_in_hex(c, 8 * i).alias(f"{c}{i}") for c in columns for i in range(3)])
    return bits.select(*kept, *[bits_to_f64(f"{c}{i}").alias(f"{c}{i}") for c in columns for i in range(3)])


def decode_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace 24-byte columns by arrays of three doubles."""
    flat = with_doubles(df, columns)
    return flat.select(*[F.when(F.col(f"{c}0").isNotNull(), F.array(*[f"{c}{i}" for i in range(3)])).alias(c)
                         if c in columns else F.col(c) for c in df.columns])


def valid_calibration(df: DataFrame) -> DataFrame:
    """Keep rows whose K, R, t and dist are all present."""
    return df.filter(F.col("K").isNotNull() & F.col("R").isNotNull()
                     & F.col("t").isNotNull() & F.col("dist").isNotNull())


def load_calibration(intr: DataFrame, extr: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Intrinsic and extrinsic tables -> K, R, t, dist per key; rows that cannot be used are left out.

    ``intr``: k_text, dist_text, error_kind. ``extr``: rvec, tvec (24 bytes), error_kind.
    """
    keys = list(keys)
    inner = (intr.filter(F.col("error_kind").isNull())
             .select(*keys, parse_camera_matrix("k_text").alias("K"), parse_distortion("dist_text").alias("dist")))
    outer = with_doubles(extr.filter(F.col("error_kind").isNull()).select(*keys, "rvec", "tvec"), ["rvec", "tvec"])
    turned = with_rotation(outer, ["rvec0", "rvec1", "rvec2"], "R")
    outer = turned.select(*keys, "R", F.array(*[F.col(f"tvec{i}").cast("float") for i in range(3)]).alias("t"))
    return valid_calibration(computed_once(inner, keys, ["K", "dist"])
                             .join(computed_once(outer, keys, ["R", "t"]), keys)).select(*keys, "K", "R", "t", "dist")


def compare_calibration(calib: DataFrame, frame: int, drones: Sequence[int]) -> DataFrame:
    """fx, fy, cx, cy, R, t and dist of chosen drones at one frame, sorted, with loaded and requested counts."""
    wanted = calib.sparkSession.createDataFrame([(int(d),) for d in drones], "drone_id int")
    there = calib.filter((F.col("frame_num") == frame) & F.col("drone_id").isin(*[int(d) for d in drones]))
    k, t = intrinsics("K"), position("t")
    rows = wanted.join(there, "drone_id", "left").select(
        "drone_id", F.col("K").isNotNull().alias("loaded"),
        *[k[n].alias(n) for n in ("fx", "fy", "cx", "cy")], "R", *[t[n].alias(n) for n in ("tx", "ty", "tz")],
        "dist")
    # one row per drone the caller names, so this window is as small as that list
    everyone = Window.partitionBy("frame_num")
    return (rows.select(F.lit(frame).cast("bigint").alias("frame_num"), "*")
            .withColumn("n_loaded", F.count_if("loaded").over(everyone))
            .withColumn("n_requested", F.count("*").over(everyone)).orderBy("drone_id"))


def expected_frames(spark, n_drones: int = 8, n_frames: int = 1000) -> DataFrame:
    """All (drone, frame) pairs of a run."""
    return spark.range(n_drones * n_frames).select(
        (F.col("id") % n_drones + 1).cast("int").alias("drone_id"),
        F.floor(F.col("id") / n_drones).cast("bigint").alias("frame_num"))


def frame_manifest(frames: DataFrame, extr: DataFrame, intr: DataFrame, n_drones: int = 8, n_frames: int = 1000,
                   expected: DataFrame | None = None) -> DataFrame:
    """Status of every expected (drone, frame): the first of frame_missing, extrinsic_missing, extrinsic_error,
    intrinsic_missing, intrinsic_error, pack_error, ok.

    ``expected`` may carry further key columns (a session, say); they then join too. A frame counts as packable
    when its ``length`` is above 0 and both vectors have 24 bytes.
    """
    if expected is None:
        expected = expected_frames(frames.sparkSession, n_drones, n_frames)
    keys = list(expected.columns)
    joined = (expected
              .join(frames.select(*keys, F.col("length").alias("_length"), F.lit(True).alias("_frame")), keys, "left")
              .join(extr.select(*keys, "rvec", "tvec", F.col("error_kind").alias("_extr_error"),
                                F.lit(True).alias("_extr")), keys, "left")
              .join(intr.select(*keys, F.col("error_kind").alias("_intr_error"), F.lit(True).alias("_intr")),
                    keys, "left"))
    packable = joined.withColumn("jpeg", F.when(F.coalesce(F.col("_length"), F.lit(0)) > 0, F.lit(b"\x00")))
    status = (F.when(F.col("_frame").isNull(), "frame_missing")
              .when(F.col("_extr").isNull(), "extrinsic_missing")
              .when(F.col("_extr_error").isNotNull(), "extrinsic_error")
              .when(F.col("_intr").isNull(), "intrinsic_missing")
              .when(F.col("_intr_error").isNotNull(), "intrinsic_error")
              .when(outgoing_error(n_drones, n_frames - 1).isNotNull(), "pack_error")
              .otherwise("ok"))
    return packable.select(*keys, status.alias("status"))
