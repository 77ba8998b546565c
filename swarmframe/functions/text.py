"""Labels, names and grid positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The display grid.
GRID_COLUMNS = 4
CELL_WIDTH = 480
CELL_HEIGHT = 270


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(x: Column | str, places: int) -> Column:
    """``%.<places>f`` as C and Python print it: the exact binary value decides, exact ties go to even.

    Java rounds the shortest decimal spelling instead. Here ``2 * 10^places * x`` is compared with the odd number
    between the two candidates; the rounding error of that product is recovered by splitting ``x`` in two halves.
    """
    x = _col(x).cast("double")
    size, ten = F.abs(x), 10 ** places
    double = float(2 * ten)
    below = F.floor(size * float(ten))
    product = size * double
    split = size * 134217729.0
    high = split - (split - size)
    error = (high * double - product) + (size - high) * double
    off = product - (below * 2 + 1).cast("double")
    odd = F.pmod(below, F.lit(2)) == 1
    up = (off > 0) | ((off == 0) & ((error > 0) | ((error == 0) & odd)))
    whole = below + F.when(up, F.lit(1)).otherwise(F.lit(0))
    if places == 0:
        digits = whole.cast("string")
    else:
        rest = F.pmod(whole, F.lit(ten))
        digits = F.concat_ws(".", ((whole - rest) / ten).cast("bigint").cast("string"),
                             F.lpad(rest.cast("string"), places, "0"))
    sign = F.when((x < 0) | F.startswith(x.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return (F.when(F.isnan(x), F.lit("nan")).when(size == float("inf"), F.concat(sign, F.lit("inf")))
            .when(size < 2.0 ** 50 / ten, F.concat(sign, digits))
            .when(x.isNotNull(), F.format_string(f"%.{places}f", x)))


def frame_key(n: Column | str) -> Column:
    return F.format_string("%04d", _col(n).cast("bigint"))


def sample_name(folder: Column | str, stem: Column | str) -> Column:
    return F.concat_ws("_", _col(folder), _col(stem))


def overlay_text(drone: Column | str, frame: Column | str, intr: Column | str, pos: Column | str) -> Column:
    """The four overlay lines; a line is null where its values are missing."""
    drone, frame, intr, pos = (_col(c) for c in (drone, frame, intr, pos))
    head = F.format_string("Drone %d | Frame %04d", drone.cast("int"), frame.cast("bigint"))

    def line(values: list[Column], text: Column) -> Column:
        known = values[0].isNotNull()
        for value in values[1:]:
            known = known & value.isNotNull()
        return F.when(known, text)

    fx, fy, cx, cy = (intr[n] for n in ("fx", "fy", "cx", "cy"))
    tx, ty, tz = (pos[n] for n in ("tx", "ty", "tz"))
    return F.struct(
        head.alias("line1"),
        line([fx, fy], F.concat(F.lit("Intrinsic: fx="), fixed(fx, 0), F.lit(" fy="), fixed(fy, 0))).alias("line2"),
        line([cx, cy], F.concat(F.lit("Principal: cx="), fixed(cx, 0), F.lit(" cy="), fixed(cy, 0))).alias("line3"),
        line([tx, ty, tz], F.concat(F.lit("Position: x="), fixed(tx, 2), F.lit(" y="), fixed(ty, 2),
                                    F.lit(" z="), fixed(tz, 2))).alias("line4"),
    )


def footer_text(frame: Column | str, fps: Column | str) -> Column:
    return F.concat(F.lit("Synchronized Frame: "), frame_key(frame), F.lit(" | Display FPS: "), fixed(fps, 1))


def grid_cell(drone: Column | str) -> Column:
    """Row, column and pixel origin of a drone (ids from 1) in the display grid."""
    index = _col(drone).cast("int") - 1
    row = F.floor(index / GRID_COLUMNS).cast("int")
    col = F.pmod(index, F.lit(GRID_COLUMNS))
    return F.struct(row.alias("row"), col.alias("col"),
                    (row * CELL_HEIGHT).alias("y"), (col * CELL_WIDTH).alias("x"))


def detection_status(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" TARGETS"))).otherwise(F.lit("NO TARGETS"))


def active_label(active: Column | str) -> Column:
    return F.when(_col(active), F.lit("ACTIVE")).otherwise(F.lit("INACTIVE"))


def detection_label(conf: Column | str, name: str = "person") -> Column:
    return F.concat(F.lit(f"{name} "), fixed(conf, 2))
