"""Packed fields of point records, and the fields of one record generation told by the other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Packed fields (fixed by the format): field -> (byte, shift, mask).
PACKED = {
    "return_number": ("returns_and_flags", 0, 7),
    "number_of_returns": ("returns_and_flags", 3, 7),
    "scan_direction_flag": ("returns_and_flags", 6, 1),
    "edge_of_flight_line": ("returns_and_flags", 7, 1),
    "classification": ("classification_byte", 0, 31),
    "synthetic_flag": ("classification_byte", 5, 1),
    "keypoint_flag": ("classification_byte", 6, 1),
    "withheld_flag": ("classification_byte", 7, 1),
    "extended_point_type": ("extended_flags", 0, 3),
    "extended_scanner_channel": ("extended_flags", 2, 3),
    "extended_classification_flags": ("extended_flags", 4, 15),
    "extended_return_number": ("extended_returns", 0, 15),
    "extended_number_of_returns": ("extended_returns", 4, 15),
}


def unpack(byte: Column, field: str) -> Column:
    _, shift, mask = PACKED[field]
    return F.shiftright(byte.cast("int"), shift).bitwiseAND(F.lit(mask)).cast("short")


def pack(fields: dict[str, Column]) -> Column:
    """One byte from the fields that share it; each is masked to its bits, fields not named are 0."""
    if len({PACKED[f][0] for f in fields}) != 1:
        raise ValueError("fields of one byte are packed together")
    out = F.lit(0)
    for f, c in fields.items():
        _, shift, mask = PACKED[f]
        out = out.bitwiseOR(F.shiftleft(c.cast("int").bitwiseAND(F.lit(mask)), shift))
    return out


def _away(value: Column) -> Column:
    return F.when(value >= 0, value + F.lit(0.5)).otherwise(value - F.lit(0.5))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def fold_u8(value: Column) -> Column:
    """Into a byte by wrapping."""
    return F.pmod(value, F.lit(256))


#: Degrees of one step of the wide scan angle, in single precision.
_STEP = 0.006


def scan_rank(angle: Column) -> Column:
    """Whole degrees (signed byte) of a wide scan angle in steps of 0.006 degrees."""
    step = F.lit(_STEP).cast("float")
    return clamp(_away((step * angle.cast("float")).cast("double")).cast("int"), -128, 127).cast("byte")


def scan_angle(rank: Column) -> Column:
    """Wide scan angle of whole degrees."""
    # single over single stays single in the format's own arithmetic
    return _away((rank.cast("float").cast("double") / F.lit(_STEP).cast("float").cast("double")).cast("float").cast("double")).cast("int").cast("short")


def legacy_returns(number: Column, count: Column) -> tuple[Column, Column]:
    """Return number and count in three bits: beyond seven returns the last keeps its place as the last."""
    many = count > 7
    late = F.when(number >= count, 7).otherwise(6)
    return F.when(many & (number > 6), late).otherwise(number).cast("short"), F.when(many, 7).otherwise(count).cast("short")


def legacy_class_byte(flags: Column, classification: Column) -> Column:
    """Old classification byte: three low flags on top, classes above 31 as 0."""
    top = F.shiftleft(flags.cast("int"), 5).bitwiseAND(F.lit(0xE0))
    return top.bitwiseOR(F.when(classification < 32, classification.cast("int")).otherwise(0))


def wide_class(legacy: Column, extended: Column) -> Column:
    """Class written to a wide record: the old one unless it is 0."""
    return F.when(legacy.cast("int") == 0, extended.cast("int")).otherwise(legacy.cast("int")).cast("short")
