"""Spatial predicates on scaled coordinates, and slices by ordinal.

Rectangles are half-open (the lower edges inside), so adjoining ones split points between them; circles are open.
A null coordinate or ordinal is in no area and no slice. Tables may have any other columns; ties and repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _numbers(name: str, values: Sequence[float], n: int) -> list[float]:
    values = list(values)
    if len(values) != n:
        raise TypeError(f"a {name} takes {n} numbers")
    out = [float(v) for v in values]
    if any(v != v for v in out):
        raise ValueError(f"a {name} takes numbers")
    return out


def in_rect(x: Column, y: Column, min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    return (x >= F.lit(float(min_x))) & (x < F.lit(float(max_x))) & (y >= F.lit(float(min_y))) & (y < F.lit(float(max_y)))


def in_circle(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    dx, dy = x - F.lit(float(cx)), y - F.lit(float(cy))
    return dx * dx + dy * dy < F.lit(float(radius) * float(radius))


def area(rect: Sequence[float] | None = None, circle: Sequence[float] | None = None) -> tuple[str, list[float]]:
    """Checks an area given one way or the other."""
    if (rect is None) == (circle is None):
        raise TypeError("give a rectangle or a circle")
    if rect is not None:
        r = _numbers("rectangle", rect, 4)
        if r[0] > r[2] or r[1] > r[3]:
            raise ValueError("the rectangle is inside out")
        return "rect", r
    c = _numbers("circle", circle, 3)
    if c[2] < 0:
        raise ValueError("a radius is not negative")
    return "circle", c


def within(points: DataFrame, rect: Sequence[float] | None = None, circle: Sequence[float] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Points of an area. A scan filters on plain columns, so the box of a circle is tested first."""
    kind, a = area(rect, circle)
    cx, cy = F.col(x), F.col(y)
    if kind == "rect":
        return points.where(in_rect(cx, cy, *a))
    if a[2] == 0:
        return points.where(F.lit(False))
    r = a[2]
    box = cx.between(a[0] - r, a[0] + r) & cy.between(a[1] - r, a[1] + r)
    return points.where(box & in_circle(cx, cy, *a))


def points_slice(points: DataFrame, start: int = 0, count: int | None = None, index: str = "point_index", total: int | None = None) -> DataFrame:
    """Points from ordinal ``start``; with ``total`` given, asking for more than there are raises."""
    if start < 0 or (total is not None and start > total):
        raise IndexError(f"no point {start}")
    if count is None:
        return points.where(F.col(index) >= start)
    if total is not None and start + count > total:
        raise IndexError(f"no {count} points from {start}")
    return points.where(F.col(index).between(start, start + count - 1))


def seek(points: DataFrame, at: int, index: str = "point_index") -> DataFrame:
    if at < 0:
        raise IndexError(f"no point {at}")
    return points.where(F.col(index) == at)


def preview(points: DataFrame, n: int = 10, index: str = "point_index") -> DataFrame:
    """The first points in file order."""
    return points.orderBy(index).limit(n)


def chunk_of(index: Column, chunk_size: int) -> Column:
    """Chunk number of an ordinal where all chunks but the last are full."""
    return F.floor(index / F.lit(chunk_size)).cast("long")


def with_chunk(points: DataFrame, chunks: DataFrame, keys: Sequence[str] = (), fine: int = 1 << 16) -> DataFrame:
    """Adds chunk_index from a table of chunks (chunk_index, start_index, point_count) of any sizes, per ``keys``.

    Chunks are listed under the blocks of ordinals they meet, so that this is an equi-join; null chunk sizes hold nothing.
    """
    last = F.col("start_index") + F.col("point_count") - 1
    c = chunks.where("point_count > 0 and start_index is not null").select(
        *keys, "chunk_index", F.col("start_index").alias("__first"), last.alias("__last")
    ).withColumn("__block", F.explode(F.sequence(F.floor(F.col("__first") / fine), F.floor(F.col("__last") / fine))))
    p = points.withColumn("__block", F.floor(F.col("point_index") / fine))
    return p.join(c, [*keys, "__block"]).where(F.col("point_index").between(F.col("__first"), F.col("__last"))).drop("__block", "__first", "__last")
