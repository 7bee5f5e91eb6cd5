"""Checks of field values and the parts of wave packets."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values a field of a point record can hold (fixed by the format).
RANGES = {
    **dict.fromkeys(("X", "Y", "Z"), (-(2**31), 2**31 - 1)),
    **dict.fromkeys(("intensity", "point_source_ID", "red", "green", "blue", "nir"), (0, 65535)),
    **dict.fromkeys(("return_number", "number_of_returns"), (0, 7)),
    **dict.fromkeys(("scan_direction_flag", "edge_of_flight_line", "synthetic_flag", "keypoint_flag", "withheld_flag"), (0, 1)),
    "classification": (0, 31),
    "scan_angle_rank": (-128, 127),
    **dict.fromkeys(("user_data", "extended_classification"), (0, 255)),
    "extended_scan_angle": (-32768, 32767),
    **dict.fromkeys(("extended_point_type", "extended_scanner_channel"), (0, 3)),
    **dict.fromkeys(("extended_classification_flags", "extended_return_number", "extended_number_of_returns"), (0, 15)),
}


def holds(field: str) -> Column:
    """True where the field fits its bits; null where it is null."""
    low, high = RANGES[field]
    return F.col(field).between(low, high)


def colours(points: DataFrame) -> Column:
    """The colour channels of a point as one value (red, green, blue, nir); a channel the points lack counts as 0."""
    return F.struct(*[(F.coalesce(c, F.lit(0)) if c in points.columns else F.lit(0)).cast("int").alias(c) for c in ("red", "green", "blue", "nir")])


def require_ranges(points: DataFrame) -> DataFrame:
    """The same points; a field that does not fit its bits raises when it is read. Nulls pass, other columns are left alone."""

    def checked(f: str) -> Column:
        message = F.concat(F.lit(f"{f} is out of its range: "), F.col(f).cast("string"))
        return F.when(holds(f) | F.col(f).isNull(), F.col(f)).otherwise(F.raise_error(message).cast(points.schema[f].dataType))

    return points.withColumns({f: checked(f) for f in points.columns if f in RANGES})


_PACKET = "<BQIffff"


_PARTS = T.StructType(
    [T.StructField("descriptor", T.IntegerType()), T.StructField("offset", T.DecimalType(20, 0)), T.StructField("size", T.LongType())]
    + [T.StructField(c, T.FloatType()) for c in ("return_point", "dx", "dy", "dz")]
)


@F.pandas_udf(_PARTS)
def _packet(raw: pd.Series) -> pd.DataFrame:
    from decimal import Decimal

    rows = [(None,) * 7 if b is None or len(b) != struct.calcsize(_PACKET) else struct.unpack(_PACKET, bytes(b)) for b in raw]
    return pd.DataFrame([(a, None if b is None else Decimal(b), *rest) for a, b, *rest in rows], columns=["descriptor", "offset", "size", "return_point", "dx", "dy", "dz"])


def wave_packet(raw: Column) -> Column:
    """The parts of a 29-byte wave packet; null parts where it is null or of another length."""
    return _packet(raw)
