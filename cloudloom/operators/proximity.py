"""Points near other points, and the zones points lie in.

Latitude (Y) is cut into strips, wide strips into sections of longitude (X); the shuffle range-partitions
by strip, so a task gets neighbouring strips and dense ones get more tasks. Strips overlap by the radius: a
point also goes, as a ghost, to every section whose home points could see it. In a task the points of a section come
sorted by X and are swept: each is compared with the following ones until the distance in X alone is too
large. A pair belongs to the home section of its first point by (Y, X, id), so exactly one task reports it.

Sections hold few points unless points really lie close together, so work follows the number of
results: a section of 32 x 512 radii can't hold more than some ten thousand points without near pairs.

Defined cases: points with a null coordinate or id are left out; repeated rows of an id count once (their
coordinates agree); points at the same place are near each other; a radius of 0 or less finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.runtime import is_small, materialize

#: Zones a task may hold at once; with more, zones are joined by tile.
ZONES_AT_ONCE = 10_000

_FOUND = T.StructType([T.StructField("code", T.ByteType()), T.StructField("left_id", T.LongType()), T.StructField("right_id", T.LongType())])
NEAR, INSIDE = 0, 1


def in_zone(x, y, zone, where=None):
    """Exact test on integer arrays: rectangles are half-open, circles open."""
    if zone["shape"] == "circle":
        dx, dy = x - int(zone["centre_x"]), y - int(zone["centre_y"])
        return dx * dx + dy * dy < int(zone["radius"]) ** 2
    return (x >= zone["min_x"]) & (x < zone["max_x"]) & (y >= zone["min_y"]) & (y < zone["max_y"])


def _box(zone: dict) -> dict:
    if zone["shape"] == "circle":
        r = max(0, zone["radius"])
        return zone | {"lo_x": zone["centre_x"] - r, "hi_x": zone["centre_x"] + r, "lo_y": zone["centre_y"] - r, "hi_y": zone["centre_y"] + r}
    return zone | {"lo_x": zone["min_x"], "hi_x": zone["max_x"], "lo_y": zone["min_y"], "hi_y": zone["max_y"]}


def _sweep(radius: float, zones: list[dict]):
    limit, reach = radius * radius, ceil(radius)
    lows = np.array([z["lo_y"] for z in zones], np.int64)
    highs = np.array([z["hi_y"] for z in zones], np.int64)

    def batch(code: int, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(left), code, np.int8)), pa.array(left), pa.array(right)], names=_FOUND.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, x, y, pid = (np.empty(0, np.int64) for _ in range(4))
        home = np.empty(0, bool)
        for b in batches:
            kept = len(cell)
            cell = np.concatenate([cell, b["cell"].to_numpy()])
            x = np.concatenate([x, b["X"].to_numpy().astype(np.int64)])
            y = np.concatenate([y, b["Y"].to_numpy().astype(np.int64)])
            pid = np.concatenate([pid, b["point_id"].to_numpy()])
            home = np.concatenate([home, b["home"].to_numpy(zero_copy_only=False)])
            if not len(cell):
                continue
            first = np.ones(len(cell), bool)
            first[1:] = (cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (pid[1:] != pid[:-1])
            kept = int(first[:kept].sum())
            cell, x, y, pid, home = cell[first], x[first], y[first], pid[first], home[first]
            n = len(cell)
            if n == kept:
                continue
            # zones whose latitudes these strips meet
            nx, ny, nid = (a[kept:][home[kept:]] for a in (x, y, pid))
            if len(nx) and len(zones):
                for z in np.flatnonzero((lows <= ny.max()) & (highs >= ny.min())):
                    hit = in_zone(nx, ny, zones[z])
                    if hit.any():
                        got = nid[hit]
                        yield batch(INSIDE, np.full(len(got), zones[z]["zone_id"], np.int64), got)
            if reach > 0:
                i = np.arange(n)
                j = np.maximum(i + 1, kept)
                while len(i):
                    open_ = j < n
                    i, j = i[open_], j[open_]
                    near = (cell[i] == cell[j]) & (x[j] - x[i] < reach)
                    i, j = i[near], j[near]
                    dx, dy = x[j] - x[i], y[j] - y[i]
                    # the first by (Y, X, id) owns the pair: it must be at home here
                    ahead = (dy > 0) | ((dy == 0) & ((dx > 0) | ((dx == 0) & (pid[j] > pid[i]))))
                    hit = (dx * dx + dy * dy < limit) & np.where(ahead, home[i], home[j])
                    if hit.any():
                        a, c = pid[i[hit]], pid[j[hit]]
                        yield batch(NEAR, np.minimum(a, c), np.maximum(a, c))
                    j = j + 1
            tail = (cell == cell[-1]) & (x > x[-1] - max(1, reach))
            cell, x, y, pid, home = cell[tail], x[tail], y[tail], pid[tail], home[tail]

    return run


def _sections(points: DataFrame, radius: float) -> DataFrame:
    """Points with their sections: home and ghosts. Section sides are powers of two, so that cutting is a shift."""
    reach = max(0, ceil(radius) - 1)
    tall = max(5, (32 * max(1, ceil(radius)) - 1).bit_length())
    wide = tall + 4
    x, y = F.col("X").cast("long"), F.col("Y").cast("long")

    def section(px, py):
        return F.shiftleft(F.shiftright(py, tall), 32) + F.shiftright(px, wide) + F.lit(1 << 31)

    here = section(x, y)
    spread = F.array_distinct(F.array(here, *[section(x + dx, y - dy) for dy in (0, reach) for dx in (-reach, 0, reach)]))
    alone = (F.shiftright(y - reach, tall) == F.shiftright(y, tall)) & (F.shiftright(x - reach, wide) == F.shiftright(x + reach, wide))
    cells = F.when(alone, F.array(here)).otherwise(spread)
    return (
        points.where(F.col("X").isNotNull() & F.col("Y").isNotNull() & F.col("point_id").isNotNull())
        .select("point_id", "X", "Y", here.alias("own"), F.explode(cells).alias("cell"))
        .select("cell", "X", "Y", "point_id", (F.col("cell") == F.col("own")).alias("home"))
    )


def neighbours_and_zones(points: DataFrame, zones: DataFrame | None, radius: float) -> DataFrame:
    """Rows (kind, left_id, right_id): 'near' pairs, smaller point_id left, and 'inside' rows (zone_id, point_id)."""
    spark = points.sparkSession
    held: list[dict] = []
    far = None
    if zones is not None:
        usable = zones.where(
            "zone_id is not null and ((shape = 'rect' and min_x is not null and min_y is not null and max_x is not null and max_y is not null)"
            " or (shape = 'circle' and centre_x is not null and centre_y is not null and radius is not null))"
        ).select("zone_id", "shape", "min_x", "min_y", "max_x", "max_y", "centre_x", "centre_y", "radius")
        if is_small(usable, ZONES_AT_ONCE):
            held = [_box(r.asDict()) for r in usable.collect()]
        else:
            far = zones_by_tile(points, usable)
    cut = _sections(points, radius)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    swept = cut.repartitionByRange(parts, "cell").sortWithinPartitions("cell", "X", "point_id").mapInArrow(_sweep(radius, held), _FOUND)
    found = swept.select(F.when(F.col("code") == NEAR, "near").otherwise("inside").alias("kind"), "left_id", "right_id")
    return found if far is None else found.unionByName(far)


def zones_by_tile(points: DataFrame, zones: DataFrame, salts: int = 32) -> DataFrame:
    """'inside' rows for any number of zones: zones are listed under tiles of about their size, then joined by tile and tested.

    A zone meets at most four tiles of the smallest power of two that its sides fit in; a point looks at one tile of each size that occurs,
    33 at most. A tile that holds many points is spread over ``salts`` keys, with its zones under each.
    """
    r = F.coalesce(F.greatest(F.col("radius"), F.lit(0)), F.lit(0)).cast("long")
    circle = F.col("shape") == "circle"

    def side(centre: str, low: str, high: str):
        c = F.col(centre).cast("long")
        return F.when(circle, c - r).otherwise(F.col(low).cast("long")), F.when(circle, c + r).otherwise(F.col(high).cast("long"))

    (low_x, high_x), (low_y, high_y) = side("centre_x", "min_x", "max_x"), side("centre_y", "min_y", "max_y")
    size = F.length(F.bin(F.greatest(high_x - low_x, high_y - low_y)))
    z = zones.where((low_x <= high_x) & (low_y <= high_y)).withColumn("size", size)
    for axis, (low, high) in (("tile_x", (low_x, high_x)), ("tile_y", (low_y, high_y))):
        first, last = F.expr("shiftright(__low, size)"), F.expr("shiftright(__high, size)")
        z = z.withColumns({"__low": low, "__high": high}).withColumn(axis, F.explode(F.array_distinct(F.array(first, last)))).drop("__low", "__high")
    z = materialize(z)
    sizes = [row[0] for row in z.select("size").distinct().collect()]
    p = points.where("X is not null and Y is not null and point_id is not null").groupBy("point_id").agg(F.min("X").alias("X"), F.min("Y").alias("Y"))
    x, y = F.col("X").cast("long"), F.col("Y").cast("long")
    tiles = [F.struct(F.lit(k).alias("size"), F.shiftright(x, k).alias("tile_x"), F.shiftright(y, k).alias("tile_y")) for k in sizes]
    if not tiles:
        return p.where(F.lit(False)).select(F.lit("inside").alias("kind"), F.col("point_id").alias("left_id"), "point_id").withColumnRenamed("point_id", "right_id")
    p = p.withColumn("tile", F.explode(F.array(*tiles))).select("point_id", "X", "Y", "tile.*", F.pmod(F.xxhash64("point_id"), F.lit(salts)).cast("int").alias("salt"))
    z = z.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dx, dy = F.col("X").cast("long") - F.col("centre_x"), F.col("Y").cast("long") - F.col("centre_y")
    inside = F.when(circle, dx * dx + dy * dy < r * r).otherwise(
        (F.col("X") >= F.col("min_x")) & (F.col("X") < F.col("max_x")) & (F.col("Y") >= F.col("min_y")) & (F.col("Y") < F.col("max_y"))
    )
    found = p.join(z, ["size", "tile_x", "tile_y", "salt"]).where(inside)
    return found.select(F.lit("inside").alias("kind"), F.col("zone_id").alias("left_id"), F.col("point_id").alias("right_id"))
