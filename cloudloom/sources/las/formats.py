"""Point formats: their items, columns and Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from cloudloom.sources.las.entropy import LasDataError


class UnsupportedFormat(LasDataError):
    """A file of a kind that can't be read."""


@dataclass(frozen=True)
class Item:
    """A group of fields coded together: its type, bytes and codec version (0: raw)."""

    kind: str
    size: int
    version: int = 0


#: Type numbers of items in the compression record (fixed values).
ITEM_CODES = {"BYTE": 0, "POINT10": 6, "GPSTIME11": 7, "RGB12": 8, "WAVEPACKET13": 9, "POINT14": 10, "RGB14": 11, "RGBNIR14": 12, "WAVEPACKET14": 13, "BYTE14": 14}
ITEM_SIZES = {"POINT10": 20, "GPSTIME11": 8, "RGB12": 6, "WAVEPACKET13": 29, "POINT14": 30, "RGB14": 6, "RGBNIR14": 8, "WAVEPACKET14": 29}
#: Items of each point format (fixed values).
FORMAT_ITEMS = {
    0: ("POINT10",),
    1: ("POINT10", "GPSTIME11"),
    2: ("POINT10", "RGB12"),
    3: ("POINT10", "GPSTIME11", "RGB12"),
    4: ("POINT10", "GPSTIME11", "WAVEPACKET13"),
    5: ("POINT10", "GPSTIME11", "RGB12", "WAVEPACKET13"),
    6: ("POINT14",),
    7: ("POINT14", "RGB14"),
    8: ("POINT14", "RGBNIR14"),
    9: ("POINT14", "WAVEPACKET14"),
    10: ("POINT14", "RGBNIR14", "WAVEPACKET14"),
}
#: Containers of point data (fixed values).
NONE, POINTWISE, POINTWISE_CHUNKED, LAYERED_CHUNKED = 0, 1, 2, 3
#: Chunk size that stands for chunks of any size.
ADAPTIVE = 0xFFFFFFFF
#: Bits that ask for layers (fixed values); X, Y, returns and channel are always read.
SELECTIVE = {
    "z": 1, "classification": 2, "flags": 4, "intensity": 8, "scan_angle": 0x10, "user_data": 0x20, "point_source": 0x40,
    "gps_time": 0x80, "rgb": 0x100, "nir": 0x200, "wavepacket": 0x400, "bytes": 0x10000,
}
ALL_LAYERS = 0xFFFFFFFF


def base_size(fmt: int) -> int:
    if fmt not in FORMAT_ITEMS:
        raise UnsupportedFormat(f"unknown point data format {fmt}")
    return sum(ITEM_SIZES[k] for k in FORMAT_ITEMS[fmt])


def is_wide(fmt: int) -> bool:
    """Formats with the wide point record."""
    return fmt >= 6


def items_of(fmt: int, record_length: int, version: int = 0) -> list[Item]:
    """Items of a format; a longer record ends in extra bytes, a shorter one is an error."""
    extra = record_length - base_size(fmt)
    if extra < 0:
        raise LasDataError(f"a record of {record_length} bytes is too short for format {fmt}")
    items = [Item(k, ITEM_SIZES[k], 1 if k == "WAVEPACKET13" and version else version) for k in FORMAT_ITEMS[fmt]]
    if extra:
        items.append(Item("BYTE14" if is_wide(fmt) else "BYTE", extra, version))
    return items


def least_minor(fmt: int) -> int:
    """Lowest minor version of the file format a point format belongs to."""
    if is_wide(fmt):
        return 4
    return 3 if fmt in (4, 5) else 2 if fmt in (2, 3) else 0


_CORE = (
    ("X", T.IntegerType()), ("Y", T.IntegerType()), ("Z", T.IntegerType()), ("intensity", T.IntegerType()),
    *[(f, T.ShortType()) for f in (
        "return_number", "number_of_returns", "scan_direction_flag", "edge_of_flight_line", "classification",
        "synthetic_flag", "keypoint_flag", "withheld_flag",
    )],
    ("scan_angle_rank", T.ByteType()), ("user_data", T.ShortType()), ("point_source_ID", T.IntegerType()),
)
_EXTENDED = tuple(
    (f"extended_{f}", T.ShortType())
    for f in ("return_number", "number_of_returns", "classification", "classification_flags", "scanner_channel", "scan_angle", "point_type")
)


def columns_of(fmt: int, extra: int) -> list[tuple[str, T.DataType]]:
    """Columns of a format in order."""
    kinds = FORMAT_ITEMS[fmt]
    cols = list(_CORE)
    if is_wide(fmt):
        cols += _EXTENDED
    if is_wide(fmt) or "GPSTIME11" in kinds:
        cols.append(("gps_time", T.DoubleType()))
    if any(k.startswith("RGB") for k in kinds):
        cols += [(c, T.IntegerType()) for c in ("red", "green", "blue")]
    if "RGBNIR14" in kinds:
        cols.append(("nir", T.IntegerType()))
    if any(k.startswith("WAVE") for k in kinds):
        cols.append(("wave_packet", T.BinaryType()))
    if extra:
        cols.append(("extra_bytes", T.BinaryType()))
    return cols


def point_schema(fmt: int, extra: int) -> T.StructType:
    """Spark schema of a file: its path, the ordinal and the format's columns."""
    lead = [T.StructField("file", T.StringType()), T.StructField("point_index", T.LongType())]
    return T.StructType(lead + [T.StructField(n, k) for n, k in columns_of(fmt, extra)])


#: Columns of any format: what is read from files of different formats, absent ones null.
def union_schema() -> T.StructType:
    seen: dict[str, T.DataType] = {}
    for fmt in (10, 5):
        seen |= dict(columns_of(fmt, 1))
    order = [n for n, _ in columns_of(10, 1)]
    lead = [T.StructField("file", T.StringType()), T.StructField("point_index", T.LongType())]
    return T.StructType(lead + [T.StructField(n, seen[n]) for n in order])


#: Layers that columns of the wide formats come from.
COLUMN_LAYERS = {
    "Z": "z", "intensity": "intensity", "classification": "classification", "extended_classification": "classification",
    **dict.fromkeys(("synthetic_flag", "keypoint_flag", "withheld_flag", "scan_direction_flag", "edge_of_flight_line", "extended_classification_flags"), "flags"),
    "scan_angle_rank": "scan_angle", "extended_scan_angle": "scan_angle", "user_data": "user_data", "point_source_ID": "point_source",
    "gps_time": "gps_time", "red": "rgb", "green": "rgb", "blue": "rgb", "nir": "nir", "wave_packet": "wavepacket",
}


def layers_for(columns: list[str]) -> int:
    """Bits of the layers that columns need."""
    bits = 0
    for c in columns:
        if c == "extra_bytes":
            bits |= 0xFFFF0000
        elif c in COLUMN_LAYERS:
            bits |= SELECTIVE[COLUMN_LAYERS[c]]
    return bits
