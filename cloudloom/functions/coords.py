"""Coordinates: raw integers to scaled doubles and back."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale(raw: Column, factor: float, offset: float = 0.0) -> Column:
    """``raw * factor + offset`` in double precision, multiplied first."""
    return raw.cast("double") * F.lit(float(factor)) + F.lit(float(offset))


def half_away(value: Column) -> Column:
    """Rounds to the nearest integer, halves away from zero. A result outside 32 bits raises (ANSI cast); null stays null."""
    return F.when(value >= 0, value + F.lit(0.5)).otherwise(value - F.lit(0.5)).cast("int")


def quantize(value: Column, factor: float, offset: float = 0.0) -> Column:
    """The raw integer of a scaled coordinate."""
    return half_away((value - F.lit(float(offset))) / F.lit(float(factor)))


def auto_offset(low: float, high: float, factor: float) -> float:
    """An offset near the middle of a range, a multiple of ten million raw units."""
    if not factor > 0:
        raise ValueError("a scale factor must be positive")
    return floor((low + high) / 2 / factor / 1e7) * 1e7 * factor


def auto_offset_column(low: Column, high: Column, factor: float) -> Column:
    """The same for columns of lowest and highest values."""
    if not factor > 0:
        raise ValueError("a scale factor must be positive")
    middle = (low.cast("double") + high.cast("double")) / F.lit(2.0) / F.lit(float(factor)) / F.lit(1e7)
    return F.floor(middle).cast("double") * F.lit(1e7) * F.lit(float(factor))


def raw_bounds(low: float, high: float, factor: float, offset: float) -> tuple[int, int]:
    """Raw values that surely cover the scaled range: a prefilter a scan can use; the exact test must follow."""
    a, b = sorted(((low - offset) / factor, (high - offset) / factor))
    clamp = lambda v: max(-(1 << 31), min((1 << 31) - 1, v))
    return clamp(floor(a) - 1), clamp(floor(b) + 2)
