"""Readers."""

from swarmframe.sources.calibration_xml import (parse_extrinsic_xml, parse_intrinsic_xml, scan_extrinsics,
                                                scan_intrinsics)
from swarmframe.sources.captures import scan_captures, stream_captures, write_captures
from swarmframe.sources.files import read_frames, scan_frames, scan_split, scan_split_images
from swarmframe.sources.packets import scan_packet_files, scan_packets, stream_packets
from swarmframe.sources.trees import write_tree

__all__ = [
    "parse_extrinsic_xml", "parse_intrinsic_xml", "read_frames", "scan_captures", "scan_extrinsics", "scan_frames",
    "scan_intrinsics", "scan_packet_files", "scan_packets", "scan_split", "scan_split_images", "stream_captures",
    "stream_packets", "write_captures", "write_tree",
]
