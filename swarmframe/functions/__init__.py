"""Scalar column functions."""

from swarmframe.functions.bytes import (bits_to_f64, f64_bits, f64_le, slice_bytes, u8, u32_bytes, u32_le,
                                        with_f64_bytes)
from swarmframe.functions.geometry import (box_iou, decode_vec3, intrinsics, is_camera_matrix, is_number_list,
                                           parse_camera_matrix, parse_distortion, position, rodrigues, scale_box,
                                           strip_text, to_float32, with_rotation)
from swarmframe.functions.packet import decode_header, packet_info, packet_sections
from swarmframe.functions.registry import register
from swarmframe.functions.text import (active_label, detection_label, detection_status, fixed, footer_text, frame_key,
                                       grid_cell, overlay_text, sample_name)

__all__ = [
    "active_label", "bits_to_f64", "box_iou", "decode_header", "decode_vec3", "detection_label", "detection_status",
    "f64_bits", "f64_le", "fixed", "footer_text", "frame_key", "grid_cell", "intrinsics",
    "is_camera_matrix", "is_number_list", "overlay_text", "packet_info", "packet_sections", "parse_camera_matrix",
    "parse_distortion", "position", "register", "rodrigues", "sample_name", "scale_box", "slice_bytes", "strip_text",
    "to_float32", "u32_bytes", "u32_le", "u8", "with_f64_bytes",
    "with_rotation",
]
