"""Packing, validation and decoding of binary packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmframe.functions.bytes import (bits_to_f64, f64_bits_in_hex, slice_bytes, u8_in_hex, u32_bytes, u32_in_hex,
                                        with_f64_bytes)
from swarmframe.functions.geometry import (five_of, is_camera_matrix, is_number_list, matrix_of, number_tokens,
                                           with_rotation)
from swarmframe.functions.packet import (EXTRINSIC_SIZE, FRAME_OFFSET, HEADER_SIZE, JPEG_SIZE_OFFSET, MIN_SIZE,
                                         TEXT_SIZES, TIME_OFFSET, VECTOR_SIZE, valid_text)
from swarmframe.plans.once import computed_once

# First and last bytes of a JPEG image.
SOI = b"\xff\xd8"
EOI = b"\xff\xd9"

DECODED = ["drone_id", "frame_num", "jpeg_size", "ts", "K", "R", "t", "dist"]


def outgoing_error(n_drones: int = 8, max_frame: int = 999) -> Column:
    """Kind of the first rule an outgoing row breaks, null where it may be packed."""
    return (F.when(~F.coalesce(F.col("drone_id").between(1, n_drones), F.lit(False)), "bad_drone")
            .when(~F.coalesce(F.col("frame_num").between(0, max_frame), F.lit(False)), "bad_frame")
            .when(F.col("jpeg").isNull() | (F.length("jpeg") == 0), "empty_frame")
            .when(F.col("rvec").isNull() | (F.length("rvec") != VECTOR_SIZE), "bad_rvec")
            .when(F.col("tvec").isNull() | (F.length("tvec") != VECTOR_SIZE), "bad_tvec"))


def validate_outgoing(df: DataFrame, n_drones: int = 8, max_frame: int = 999) -> DataFrame:
    """Add ``error_kind`` to rows of drone_id, frame_num, jpeg, rvec, tvec."""
    return df.withColumn("error_kind", outgoing_error(n_drones, max_frame))


def pack_packets(df: DataFrame, n_drones: int = 8, max_frame: int = 999) -> DataFrame:
    """Replace drone_id, frame_num, ts, jpeg, rvec, tvec, k_text, dist_text by ``packet`` and ``error_kind``.

    ``packet`` is null for rows that break a rule. Missing texts are packed with length 0.
    """
    used = ["drone_id", "frame_num", "ts", "jpeg", "rvec", "tvec", "k_text", "dist_text"]
    kept = [c for c in df.columns if c not in used]
    checked = (with_f64_bytes(validate_outgoing(df, n_drones, max_frame), {"ts": "_ts_bytes"})
               .withColumn("_k", F.coalesce(F.encode("k_text", "UTF-8"), F.lit(b"")))
               .withColumn("_dist", F.coalesce(F.encode("dist_text", "UTF-8"), F.lit(b""))))
    pad = F.lit(b"\x00" * 3)
    header = F.concat(F.unhex(F.lpad(F.hex(F.col("drone_id").cast("bigint")), 2, "0")), pad,
                      u32_bytes("frame_num"), u32_bytes(F.length("jpeg")), F.lit(b"\x00" * 4), "_ts_bytes")
    packet = F.concat(header, "jpeg", "rvec", "tvec", u32_bytes(F.length("_k")), u32_bytes(F.length("_dist")),
                      "_k", "_dist")
    packed = checked.withColumn("packet", F.when(F.col("error_kind").isNull(), packet))
    return computed_once(packed, [*kept, "drone_id", "frame_num"], ["packet", "error_kind"])


def _located(df: DataFrame, packet: str) -> DataFrame:
    """Header fields and section offsets, one projection per dependency level so that nothing is computed twice."""
    head = df.select("*", F.length(packet).cast("bigint").alias("_size"),
                     F.hex(slice_bytes(packet, 0, HEADER_SIZE)).alias("_head"))
    fields = head.select(*df.columns, "_size", u8_in_hex("_head", 0).alias("drone_id"),
                         u32_in_hex("_head", FRAME_OFFSET).alias("frame_num"),
                         u32_in_hex("_head", JPEG_SIZE_OFFSET).alias("jpeg_size"),
                         f64_bits_in_hex("_head", TIME_OFFSET).alias("_ts_bits"))
    extrinsic = F.col("jpeg_size") + HEADER_SIZE
    at = fields.select("*", bits_to_f64("_ts_bits").alias("ts"), extrinsic.alias("_extrinsic"))
    # offsets past the end are pinned to the end: the error kind already says so, and int casts cannot overflow
    pinned = F.least(F.col("_extrinsic") + EXTRINSIC_SIZE, F.col("_size"))
    sizes = at.select("*", (F.col("_extrinsic") + EXTRINSIC_SIZE + TEXT_SIZES).alias("_texts_at"),
                      F.hex(slice_bytes(packet, pinned, TEXT_SIZES)).alias("_two"))
    return sizes.select("*", u32_in_hex("_two", 0).alias("_k_size"), u32_in_hex("_two", 4).alias("_dist_size"))


def _structure_error(packet: str, n_drones: int, max_frame: int) -> Column:
    size = F.col("_size")
    jpeg_end = F.least(F.col("_extrinsic"), size)
    starts = slice_bytes(packet, HEADER_SIZE, 2) == F.lit(SOI)
    ends = slice_bytes(packet, jpeg_end - 2, 2) == F.lit(EOI)
    whole = (F.col("jpeg_size") >= 4) & starts & ends
    return (F.when(size.isNull() | (size < MIN_SIZE), "too_small")
            .when(~F.col("drone_id").between(1, n_drones), "bad_drone")
            .when(~F.col("frame_num").between(0, max_frame), "bad_frame")
            .when(~whole, "bad_jpeg")
            .when(F.col("_extrinsic") + EXTRINSIC_SIZE > size, "extrinsic_truncated")
            .when(F.col("_texts_at") > size, "intrinsic_header_truncated")
            .when(F.col("_texts_at") + F.col("_k_size") + F.col("_dist_size") > size, "intrinsic_data_truncated"))


def validate_packets(df: DataFrame, n_drones: int = 8, max_frame: int = 999, packet: str = "packet") -> DataFrame:
    """Add ``error_kind`` (first failing rule, null for good packets) and the raw sections.

    Sections: drone_id, frame_num, jpeg_size, ts, rvec, tvec (24 bytes each), k_text, dist_text.
    """
    kept = list(df.columns)
    found = _located(df, packet).withColumn("_kind", _structure_error(packet, n_drones, max_frame))
    sound = F.col("_kind").isNull()
    k_at, k_size = F.col("_texts_at"), F.col("_k_size")
    cut = found.select(
        *kept, "_kind", "drone_id", "frame_num", "jpeg_size", "ts",
        F.when(sound, slice_bytes(packet, F.col("_extrinsic"), VECTOR_SIZE)).alias("rvec"),
        F.when(sound, slice_bytes(packet, F.col("_extrinsic") + VECTOR_SIZE, VECTOR_SIZE)).alias("tvec"),
        F.when(sound & (k_size > 0), slice_bytes(packet, k_at, k_size)).alias("_k"),
        F.when(sound & (F.col("_dist_size") > 0),
               slice_bytes(packet, k_at + k_size, F.col("_dist_size"))).alias("_dist"))
    texts = cut.select("*", valid_text(F.col("_k")).alias("k_text"), valid_text(F.col("_dist")).alias("dist_text"))
    kind = (F.when(F.col("_kind").isNotNull(), F.col("_kind"))
            .when(F.col("_k").isNotNull() & ~F.coalesce(is_camera_matrix("k_text"), F.lit(False)), "bad_k_text")
            .when(F.col("_dist").isNotNull() & ~F.coalesce(is_number_list("dist_text"), F.lit(False)),
                  "bad_dist_text"))
    return computed_once(texts.withColumn("error_kind", kind), kept,
                         ["drone_id", "frame_num", "jpeg_size", "ts", "rvec", "tvec", "k_text", "dist_text",
                          "error_kind"])


def decode_sections(valid: DataFrame) -> DataFrame:
    """Replace the raw sections of good packets by K, R, t, dist and ``sent_at``."""
    raw = ["rvec", "tvec", "k_text", "dist_text"]
    kept = [c for c in valid.columns if c not in raw + ["error_kind"]]
    # one projection per step, so that no value is computed twice and the generated methods stay small
    names = [f"_{v}{i}" for v in "rt" for i in range(3)]
    digits = valid.select(*kept, F.hex(F.concat("rvec", "tvec")).alias("_hex"), number_tokens("k_text").alias("_k"),
                          number_tokens("dist_text").alias("_d"))
    bits = digits.select(*kept, "_k", "_d", *[f64_bits_in_hex("_hex", 8 * i).alias(n) for i, n in enumerate(names)])
    vectors = bits.select(*kept, "_k", "_d", *[bits_to_f64(n).alias(n) for n in names])
    turned = with_rotation(vectors, names[:3], "R")
    # the JIT leaves methods above 8000 bytecodes alone, so matrix, texts and vectors get a generated method each
    turned = computed_once(turned, [*kept, "_k", "_d", *names[3:]], ["R"])
    read = turned.withColumn("K", F.when(F.col("_k").isNotNull(), matrix_of("_k")))
    read = computed_once(read, [*kept, "_d", *names[3:], "R"], ["K"])
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 5)
    rest = read.select(*kept, "K", "R", F.timestamp_micros((F.col("ts") * 1_000_000).try_cast("bigint")).alias("sent_at"),
                       F.array(*[F.col(n).cast("float") for n in names[3:]]).alias("t"),
                       F.coalesce(five_of("_d"), zeros).alias("dist"))
    return computed_once(rest, kept, ["sent_at", "K", "R", "t", "dist"])


def decode_packets(df: DataFrame, col: str = "packet", n_drones: int = 8,
                   max_frame: int = 999) -> tuple[DataFrame, DataFrame]:
    """Split packets into decoded good rows and bad rows with ``error_kind``."""
    checked = validate_packets(df, n_drones, max_frame, col)
    good = decode_sections(checked.filter(F.col("error_kind").isNull())).drop(col)
    bad = checked.filter(F.col("error_kind").isNotNull()).select(*df.columns, "error_kind")
    return good, bad


def drop_wrong_drone(df: DataFrame, port: str = "port_drone_id") -> DataFrame:
    """Discard packets whose drone id is not the one of their connection."""
    return df.filter(F.col("drone_id") == F.col(port))
