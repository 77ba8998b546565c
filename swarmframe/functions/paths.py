"""What file paths say, as column expressions: scans and queries over path tables share these rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of frame, calibration and labelled-image files.
FRAME = r"(?:^|/)D(\d+)/(\d{4,})\.png$"
CALIBRATION = r"(?:^|/){}_Drone(\d+)_(\d{{4,}})\.xml$"
IMAGE = r"(?:^|/)(D[^/]*)/([^/]+)(\.png|\.jpg)$"
LABEL = r"(?:^|/)(D[^/]*)/labels/([^/]+)\.txt$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(path: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, group), F.lit(""))


def _numbered(path: Column, pattern: str) -> Column:
    drone, frame = _part(path, pattern, 1).try_cast("int"), _part(path, pattern, 2).try_cast("bigint")
    return F.when(drone.isNotNull() & frame.isNotNull(), F.struct(drone.alias("drone_id"), frame.alias("frame_num")))


def frame_path(path: Column | str) -> Column:
    """``D<drone>/<frame, 4 digits or more>.png`` -> drone_id, frame_num; null for other paths."""
    return _numbered(_col(path), FRAME)


def calibration_path(path: Column | str, prefix: str) -> Column:
    """``<prefix>_Drone<drone>_<frame, 4 digits or more>.xml`` -> drone_id, frame_num; null for other names."""
    return _numbered(_col(path), CALIBRATION.format(prefix))


def image_path(path: Column | str) -> Column:
    """``D*/<stem>.png`` or ``.jpg`` -> folder, stem, suffix; null for other paths."""
    path = _col(path)
    folder = _part(path, IMAGE, 1)
    return F.when(folder.isNotNull(), F.struct(folder.alias("folder"), _part(path, IMAGE, 2).alias("stem"),
                                               _part(path, IMAGE, 3).alias("suffix")))


def label_path(path: Column | str) -> Column:
    """``D*/labels/<stem>.txt`` -> folder, stem; null for other paths."""
    path = _col(path)
    folder = _part(path, LABEL, 1)
    return F.when(folder.isNotNull(), F.struct(folder.alias("folder"), _part(path, LABEL, 2).alias("stem")))
