"""Packet header and section access as column expressions (24-byte little-endian header)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swarmframe.functions.bytes import (bits_to_f64, f64_bits_in_hex, f64_le, slice_bytes, u8, u8_in_hex, u32_in_hex,
                                        u32_le)

# The packet layout in bytes.
HEADER_SIZE = 24
FRAME_OFFSET = 4
JPEG_SIZE_OFFSET = 8
TIME_OFFSET = 16
VECTOR_SIZE = 24
EXTRINSIC_SIZE = 48
TEXT_SIZES = 8
MIN_SIZE = HEADER_SIZE + EXTRINSIC_SIZE + TEXT_SIZES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_header(packet: Column | str) -> Column:
    """drone_id, frame_num, jpeg_size and ts (epoch seconds) of a packet."""
    packet = _col(packet)
    return F.struct(u8(packet, 0).alias("drone_id"), u32_le(packet, FRAME_OFFSET).alias("frame_num"),
                    u32_le(packet, JPEG_SIZE_OFFSET).alias("jpeg_size"), f64_le(packet, TIME_OFFSET).alias("ts"))


def packet_info(packet: Column | str) -> Column:
    """Header fields, real size and the size expected without the calibration text; null for short packets."""
    packet = _col(packet)
    digits = F.hex(slice_bytes(packet, 0, HEADER_SIZE))
    jpeg_size = u32_in_hex(digits, JPEG_SIZE_OFFSET)
    return F.when(F.length(packet) >= HEADER_SIZE, F.struct(
        u8_in_hex(digits, 0).alias("drone_id"), u32_in_hex(digits, FRAME_OFFSET).alias("frame_num"),
        jpeg_size.alias("jpeg_size"), bits_to_f64(f64_bits_in_hex(digits, TIME_OFFSET)).alias("ts"),
        F.length(packet).cast("bigint").alias("total_size"),
        (jpeg_size + (HEADER_SIZE + EXTRINSIC_SIZE + TEXT_SIZES)).alias("expected_size")))


def valid_text(b: Column) -> Column:
    """UTF-8 text of a binary value; null where the bytes are not UTF-8."""
    return F.try_validate_utf8(b.cast("string"))


def packet_sections(packet: Column | str) -> Column:
    """jpeg, rvec, tvec and the two texts, found by running offsets."""
    packet = _col(packet)
    jpeg_size = u32_le(packet, JPEG_SIZE_OFFSET)
    extrinsic = jpeg_size + HEADER_SIZE
    sizes = extrinsic + EXTRINSIC_SIZE
    texts = sizes + TEXT_SIZES
    k_size, dist_size = u32_le(packet, sizes), u32_le(packet, sizes + 4)
    return F.struct(
        slice_bytes(packet, HEADER_SIZE, jpeg_size).alias("jpeg"),
        slice_bytes(packet, extrinsic, VECTOR_SIZE).alias("rvec"),
        slice_bytes(packet, extrinsic + VECTOR_SIZE, VECTOR_SIZE).alias("tvec"),
        valid_text(slice_bytes(packet, texts, k_size)).alias("k_text"),
        valid_text(slice_bytes(packet, texts + k_size, dist_size)).alias("dist_text"))
