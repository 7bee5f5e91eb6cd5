"""Quadtree run index: which runs of ordinals hold the points of a cell.

Built as a DataFrame (cell, full, run_start, run_end, low_x, high_x, low_y, high_y): points get their leaf from single-precision
cell edges, leaves with few points are joined, runs are found by gaps between ordinals and the smallest gaps are
closed until the wanted number of runs is left. A query keeps the cells that meet the area, merges their
runs and semi-joins the points with them; the exact test is always applied again, so an index changes no answer.

How it scales: counts per leaf are combined on the map side. Runs are found inside blocks of ordinals first and joined
across blocks afterwards, so a cell with a third of all points is spread over many tasks. Which gaps are
closed follows from histograms. Nothing but single numbers comes to the driver; ``serialize`` is for the index of
one file, whose size its run limit bounds.

Defined cases: points with a null coordinate or ordinal are in no run; repeated ordinals count in ``full`` and join the same run; an
empty cloud can't be indexed and raises.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators.regions import area, within
from cloudloom.runtime import materialize

#: Runs whose gap is at most this are read through (fixed value of the index format's readers and writers).
GAP = 1000
#: Deepest tree an index can hold.
LEVELS = 15
#: Ordinals of a block in which runs are found first.
BLOCK = 1 << 20
#: Counts that come to the driver at a time where a value is narrowed down.
BUCKETS = 1 << 12


class IndexDataError(ValueError):
    """Bytes that are no usable index."""


@dataclass(frozen=True)
class Tree:
    """A square of ``2 ** levels`` cells a side; all bounds are single precision."""

    levels: int
    min_x: float
    max_x: float
    min_y: float
    max_y: float

    @staticmethod
    def over(min_x: float, max_x: float, min_y: float, max_y: float, cell_size: float = 1.0) -> Tree:
        """The tree of a cell size over an area: out to whole cells, then to a power of two, the larger half of the excess below."""
        if not cell_size > 0:
            raise ValueError("the cell size must be positive")
        if not (min_x <= max_x and min_y <= max_y):
            raise ValueError("the area is inside out or not a number")
        f = np.float32
        size = f(cell_size)

        def low(v: float) -> np.float32:
            whole = f(int(v / float(size)))
            return f(size * (whole if v >= 0 else whole - f(1)))

        def high(v: float) -> np.float32:
            whole = f(int(v / float(size)))
            return f(size * (whole + f(1) if v >= 0 else whole))

        box = [low(min_x), high(max_x), low(min_y), high(max_y)]
        across = [max(0, int(float(f(f(box[k + 1] - box[k]) / size)) + 0.5)) for k in (0, 2)]
        if 0 in across:
            raise ValueError("the area has no cells")
        levels = (max(across) - 1).bit_length()
        if levels > LEVELS:
            raise ValueError(f"the cell size needs {levels} levels, more than {LEVELS}")
        for k, n in zip((0, 2), across):
            spare = (1 << levels) - n
            box[k] = f(box[k] - f(f(spare - spare // 2) * size))
            box[k + 1] = f(box[k + 1] + f(f(spare // 2) * size))
        return Tree(levels, *map(float, box))

    def edges(self, low: float, high: float) -> np.ndarray:
        """Cell edges along an axis, halving in single precision."""
        e = np.array([low, high], np.float32)
        for _ in range(self.levels):
            mid = ((e[:-1] + e[1:]) / np.float32(2)).astype(np.float32)
            e = np.append(np.column_stack([e[:-1], mid]).ravel(), e[-1]).astype(np.float32)
        return e

    def leaves(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Cell numbers of points. A point on an edge belongs to the upper side."""
        last = (1 << self.levels) - 1
        at = [np.clip(np.searchsorted(self.edges(lo, hi)[1:-1].astype(np.float64), v, "right"), 0, last).astype(np.int64) for v, lo, hi in ((x, self.min_x, self.max_x), (y, self.min_y, self.max_y))]
        return level_offset(self.levels) + (_spread(at[0]) | _spread(at[1]) << 1)

    def box(self, cell: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bounds (low_x, high_x, low_y, high_y) of cells of any level."""
        cell = np.asarray(cell, np.int64)
        level = np.zeros(len(cell), np.int64)
        for k in range(1, self.levels + 1):
            level[cell >= level_offset(k)] = k
        inner = cell - np.array([level_offset(k) for k in range(self.levels + 1)])[level]
        width = 1 << (self.levels - level)
        ex, ey = self.edges(self.min_x, self.max_x), self.edges(self.min_y, self.max_y)
        ix, iy = _gather(inner) * width, _gather(inner >> 1) * width
        return ex[ix], ex[ix + width], ey[iy], ey[iy + width]


def level_offset(level: int) -> int:
    """Number of the first cell of a level: levels before it have 1, 4, 16, ... cells."""
    return (4**level - 1) // 3


_STEPS = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(v: np.ndarray) -> np.ndarray:
    for shift, mask in _STEPS:
        v = (v | v << shift) & mask
    return v


def _gather(v: np.ndarray) -> np.ndarray:
    v = v & 0x55555555
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        v = (v | v >> shift) & mask
    return v


def leaf_of(tree: Tree, x: Column, y: Column) -> Column:
    @F.pandas_udf("long")
    def leaf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(tree.leaves(a.to_numpy(), b.to_numpy()))

    return leaf(x.cast("double"), y.cast("double"))


def cell_counts(points: DataFrame, cell: str = "cell") -> DataFrame:
    return points.groupBy(cell).agg(F.count(F.lit(1)).alias("full"))


def merge_runs(runs: DataFrame, keys: list[str], gap: int, block: int = BLOCK) -> DataFrame:
    """Joins runs (run_start, run_end, n) of each key that overlap or lie at most ``gap`` apart; n adds up.

    Runs are joined inside blocks of ordinals. What reaches into a block from the left is carried over by a pass over one row a block.
    """
    cut = runs.withColumn("__block", F.floor(F.col("run_start") / block))
    own = [*keys, "__block"]
    w = Window.partitionBy(*own).orderBy("run_start", "run_end")
    ahead, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)

    def islands(df: DataFrame, reach: Column) -> DataFrame:
        new = F.when(F.col("run_start") - reach <= gap, 0).otherwise(1)
        return df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(upto))

    def beside(rows: DataFrame, per_block: DataFrame) -> DataFrame:
        each = per_block.select(*[F.col(k).alias(f"__of_{k}") for k in own], *[c for c in per_block.columns if c not in own])
        return rows.join(each, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in own])).drop(*[f"__of_{k}" for k in own])

    inside = islands(cut, F.max("run_end").over(ahead)).groupBy(*own, "__island").agg(
        F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("n").alias("n")
    ).drop("__island")
    # one row a block, in order
    blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = inside.groupBy(*own).agg(F.max("run_end").alias("__last")).withColumn("__carried", F.max("__last").over(blocks)).drop("__last")
    local = islands(beside(inside, carried), F.greatest(F.max("run_end").over(ahead), "__carried"))
    # runs before the first island of a block belong to the last one begun before it
    begun = local.groupBy(*own).agg(F.sum("__new").alias("__begun"))
    opened = F.last(F.when(F.col("__begun") > 0, F.struct(F.col("__block").alias("b"), F.col("__begun").alias("k"))), True).over(blocks)
    begun = begun.withColumn("__open", opened).drop("__begun")
    named = beside(local, begun)
    home = F.when(F.col("__island") > 0, F.struct(F.col("__block").alias("b"), F.col("__island").alias("k"))).otherwise(F.col("__open"))
    return named.groupBy(*keys, home.alias("__home")).agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("n").alias("n")).drop("__home")


def cell_runs(points: DataFrame, gap: int = GAP, cell: str = "cell", block: int = BLOCK) -> DataFrame:
    """Runs of ordinals per cell: a new one starts where the next point of the cell is more than ``gap`` on."""
    one = points.where(F.col(cell).isNotNull() & F.col("point_index").isNotNull()).select(
        cell, F.col("point_index").alias("run_start"), F.col("point_index").alias("run_end"), F.lit(1).cast("long").alias("n")
    )
    return merge_runs(one, [cell], gap, block)


def coarsen(counts: DataFrame, levels: int, minimum_points: int) -> DataFrame:
    """Final cell per leaf (leaf, cell, full): four present siblings with fewer than ``minimum_points`` together become their parent.

    A cell of k levels up can stand for its leaves only if all 4^k of them are present and hold fewer than ``minimum_points`` together,
    which then holds below it as well; so one grouping by ancestors finds what repeated passes would.
    """
    leaves = counts.select(F.col("cell").alias("leaf"), F.col("full").alias("leaf_full"))
    highest = min(levels, floor(log(minimum_points, 4)) if minimum_points > 1 else 0)
    if highest < 1:
        return leaves.select("leaf", F.col("leaf").alias("cell"), F.col("leaf_full").alias("full"))
    inner = F.col("leaf") - F.lit(level_offset(levels))
    ups = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.shiftright(inner, 2 * k) + F.lit(level_offset(levels - k))).alias("up")) for k in range(highest + 1)]))
    each = leaves.withColumn("a", ups).select("leaf", "leaf_full", "a.k", "a.up")
    fit = each.groupBy("k", "up").agg(F.count(F.lit(1)).alias("leaves"), F.sum("leaf_full").alias("full"))
    fit = fit.where((F.col("k") == 0) | ((F.col("leaves") == F.pow(F.lit(4), F.col("k"))) & (F.col("full") < minimum_points)))
    return each.join(fit, ["k", "up"]).groupBy("leaf").agg(F.max_by("up", "k").alias("cell"), F.max_by("full", "k").alias("full"))


def _place(df: DataFrame, column: str, place: int) -> tuple[int, int]:
    """The value of ``column`` at a place (from 1) in ascending order, and how many rows lie below that value. Narrowed by counts, never sorted."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    below = 0
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        held = df.where(F.col(column).between(low, high)).groupBy(F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("long").alias("b")).count().collect()
        for r in sorted(held, key=lambda r: r["b"]):
            if below + r["count"] >= place:
                low, high = low + r["b"] * width, min(high, low + (r["b"] + 1) * width - 1)
                break
            below += r["count"]
    return low, below


def limit_runs(runs: DataFrame, maximum: int) -> DataFrame:
    """Closes the smallest gaps inside cells, ties by (cell, run), until ``maximum`` runs are left, at least one a cell.

    ``maximum`` below 0 means that many per cell, 0 no limit.
    """
    if maximum == 0:
        return runs
    runs = materialize(runs)
    held = runs.agg(F.count_distinct("cell").alias("cells"), F.count(F.lit(1)).alias("runs")).first()
    goal = max(held.cells, -maximum * held.cells if maximum < 0 else maximum)
    spare = held.runs - goal
    if spare <= 0:
        return runs
    w = Window.partitionBy("cell").orderBy("run_start")
    gaps = materialize(runs.withColumn("gap", F.col("run_start") - F.lag("run_end").over(w)))
    known = gaps.where("gap is not null")
    # the gap at which the last closing falls; equal gaps go in order of cell and run
    cut, below = _place(known, "gap", spare)
    tied = known.where(F.col("gap") == cut)
    cell, before = _place(tied, "cell", spare - below)
    last, _ = _place(tied.where(F.col("cell") == cell), "run_start", spare - below - before)
    ties = tied.where((F.col("cell") < cell) | ((F.col("cell") == cell) & (F.col("run_start") <= last))).select("cell", "run_start", F.lit(True).alias("tied"))
    marked = gaps.join(ties, ["cell", "run_start"], "left").withColumn(
        "closed", F.coalesce((F.col("gap") < cut) | F.col("tied"), F.lit(False))
    )
    island = F.sum(F.when(F.col("closed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__island", island).groupBy("cell", "__island").agg(
        F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("n").alias("n")
    ).drop("__island")


@dataclass
class RunIndex:
    """An index: its tree and the runs of its cells."""

    tree: Tree
    runs: DataFrame
    #: What was odd about the bytes it was read from.
    warnings: tuple[str, ...] = ()

    def facts(self) -> DataFrame:
        """One row: levels, bounds, cells, runs, points, and warnings."""
        t = self.tree
        one = self.runs.groupBy("cell").agg(F.max("full").alias("full"), F.count(F.lit(1)).alias("n")).agg(
            F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("runs"), F.coalesce(F.sum("full"), F.lit(0)).alias("points")
        )
        lit = {"levels": t.levels, "min_x": t.min_x, "max_x": t.max_x, "min_y": t.min_y, "max_y": t.max_y}
        return one.select(*[F.lit(v).alias(k) for k, v in lit.items()], "cells", "runs", "points", F.lit("; ".join(self.warnings)).alias("warnings"))

    def candidates(self, rect=None, circle=None, gap: int = GAP) -> DataFrame:
        """Merged runs (run_start, run_end) of the cells that meet an area, ascending."""
        kind, a = area(rect, circle)
        if kind == "circle":
            cx, cy, r = a
            box = (cx - r, cy - r, cx + r, cy + r)
        else:
            box = tuple(a)
        t = self.tree
        if box[2] <= t.min_x or not box[0] <= t.max_x or box[3] <= t.min_y or not box[1] <= t.max_y or (kind == "circle" and a[2] == 0):
            hit = self.runs.where(F.lit(False))
        else:
            # a cell owns its lower edge and not its upper one, but for the edges of the tree itself
            def meets(lo: str, hi: str, q_lo: float, q_hi: float, t_lo: float, t_hi: float) -> Column:
                return ((F.col(lo) == t_lo) | (F.lit(q_hi) > F.col(lo))) & ((F.col(hi) == t_hi) | (F.lit(q_lo) < F.col(hi)))

            hit = self.runs.where(meets("low_x", "high_x", box[0], box[2], t.min_x, t.max_x) & meets("low_y", "high_y", box[1], box[3], t.min_y, t.max_y))
            if kind == "circle":
                dx = F.greatest(F.lit(cx) - F.col("high_x"), F.col("low_x") - F.lit(cx), F.lit(0.0))
                dy = F.greatest(F.lit(cy) - F.col("high_y"), F.col("low_y") - F.lit(cy), F.lit(0.0))
                hit = hit.where(dx * dx + dy * dy < F.lit(r * r))
        # runs of a single cell are left as they are
        one = hit.select("cell").distinct().limit(2).count() < 2
        runs = hit.select("run_start", "run_end", "n")
        merged = runs if one else merge_runs(runs, [], gap)
        return merged.select("run_start", "run_end").orderBy("run_start")

    def within(self, points: DataFrame, rect=None, circle=None, block: int = 1 << 16) -> DataFrame:
        """Points of an area: only ordinals in candidate runs, then the exact test."""
        runs = self.candidates(rect, circle).withColumn("__block", F.explode(F.sequence(F.floor(F.col("run_start") / block), F.floor(F.col("run_end") / block))))
        p = points.withColumn("__block", F.floor(F.col("point_index") / block))
        inside = (p["__block"] == runs["__block"]) & p["point_index"].between(runs["run_start"], runs["run_end"])
        return within(p.join(runs, inside, "left_semi").drop("__block"), rect, circle)

    def serialize(self) -> bytes:
        """The index as bytes of the sidecar format: cells ascending, 64-bit runs if an ordinal needs them."""
        t = self.tree
        by_cell: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        for r in self.runs.orderBy("cell", "run_start").select("cell", "full", "run_start", "run_end").toLocalIterator():
            by_cell.setdefault(r.cell, (r.full, []))[1].append((r.run_start, r.run_end))
        wide = any(e > 0xFFFFFFFF for _, runs in by_cell.values() for _, e in runs)
        out = [b"LASX", struct.pack("<I", 0), b"LASS", struct.pack("<I", 0), b"LASQ", struct.pack("<IIII", 0, t.levels, 0, 0)]
        out += [struct.pack("<4f", t.min_x, t.max_x, t.min_y, t.max_y), b"LASV", struct.pack("<II", int(wide), len(by_cell))]
        pair = "<QQ" if wide else "<II"
        for cell, (full, runs) in by_cell.items():
            out.append(struct.pack("<II", cell, len(runs)) + struct.pack("<Q" if wide else "<I", full))
            out += [struct.pack(pair, *r) for r in runs]
        return b"".join(out)


def with_boxes(tree: Tree, runs: DataFrame) -> DataFrame:
    @F.pandas_udf("low_x double, high_x double, low_y double, high_y double")
    def box(cell: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("low_x", "high_x", "low_y", "high_y"), (e.astype(np.float64) for e in tree.box(cell.to_numpy())))))

    return runs.withColumn("__box", box("cell")).select("*", "__box.*").drop("__box")


def build(points: DataFrame, cell_size: float = 1.0, minimum_points: int = 100_000, maximum_intervals: int = -20, gap: int = GAP, block: int = BLOCK) -> RunIndex:
    """Index of a cloud with columns x, y (scaled) and point_index."""
    # read once: the points may come from files that are slow to decode
    p = materialize(points.where("x is not null and y is not null and point_index is not null").select("x", "y", "point_index"))
    b = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if b[0] is None:
        raise ValueError("there are no points to index")
    tree = Tree.over(b[0], b[1], b[2], b[3], cell_size)
    leafed = materialize(p.select("point_index", leaf_of(tree, F.col("x"), F.col("y")).alias("cell")))
    final = materialize(coarsen(cell_counts(leafed), tree.levels, minimum_points))
    runs = cell_runs(leafed.withColumnRenamed("cell", "leaf").join(final.select("leaf", "cell"), "leaf"), gap, block=block)
    full = final.select("cell", "full").distinct()
    kept = limit_runs(runs, maximum_intervals)
    return RunIndex(tree, materialize(with_boxes(tree, kept.join(full, "cell"))))


def parse(data: bytes) -> tuple[Tree, list[tuple[int, int, int, int]], list[str]]:
    """Reads index bytes: the tree, rows (cell, full, run_start, run_end), and warnings. Of a repeated cell the first counts."""
    view = memoryview(data)
    at = 0

    def take(fmt: str, what: str):
        nonlocal at
        size = struct.calcsize(fmt)
        if at + size > len(view):
            raise IndexDataError(f"the index ends inside its {what}")
        got = struct.unpack_from(fmt, view, at)
        at += size
        return got

    if take("<4s", "signature")[0] != b"LASX":
        raise IndexDataError("no index signature")
    take("<I", "version")
    if take("<4s", "tree")[0] != b"LASS":
        raise IndexDataError("no tree record")
    if take("<I", "tree")[0] != 0:
        raise IndexDataError("unknown kind of tree")
    mark = take("<4s", "tree")[0]
    if mark == b"LASQ":
        levels = take("<II", "tree")[1]
    else:
        levels = struct.unpack("<I", mark)[0]
    if levels > LEVELS:
        raise IndexDataError(f"{levels} levels are more than {LEVELS}")
    take("<II", "tree")
    tree = Tree(levels, *take("<4f", "tree"))
    if take("<4s", "runs")[0] != b"LASV":
        raise IndexDataError("no run record")
    version, cells = take("<II", "runs")
    if version > 1:
        raise IndexDataError(f"unknown run version {version}")
    pair, one = ("<QQ", "<Q") if version else ("<II", "<I")
    rows, seen, warnings = [], set(), []
    for _ in range(cells):
        cell, count = take("<II", "runs")
        full = take(one, "runs")[0]
        if cell >= level_offset(levels + 1):
            raise IndexDataError(f"cell {cell} is outside the tree")
        again = cell in seen
        seen.add(cell)
        if again:
            warnings.append(f"cell {cell} is listed twice; the first counts")
        for _ in range(count):
            start, end = take(pair, "runs")
            if end < start:
                raise IndexDataError(f"a run of cell {cell} ends before it starts")
            if not again:
                rows.append((cell, full, start, end))
    return tree, rows, warnings


def from_bytes(spark, data: bytes) -> RunIndex:
    tree, rows, warnings = parse(data)
    runs = spark.createDataFrame([(c, f, s, e, e - s + 1) for c, f, s, e in rows], "cell long, full long, run_start long, run_end long, n long")
    return RunIndex(tree, with_boxes(tree, runs), tuple(warnings))


def spans(index: bytes, rect=None, circle=None, gap: int = GAP) -> list[tuple[int, int]]:
    """Half-open spans of ordinals that may lie in an area, from index bytes."""
    tree, rows, _ = parse(index)
    kind, a = area(rect, circle)
    box = a if kind == "rect" else [a[0] - a[2], a[1] - a[2], a[0] + a[2], a[1] + a[2]]
    if not rows or box[2] <= tree.min_x or not box[0] <= tree.max_x or box[3] <= tree.min_y or not box[1] <= tree.max_y:
        return []
    cells, starts, ends = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3))
    lx, hx, ly, hy = (e.astype(np.float64) for e in tree.box(cells))
    hit = ((lx == tree.min_x) | (box[2] > lx)) & ((hx == tree.max_x) | (box[0] < hx)) & ((ly == tree.min_y) | (box[3] > ly)) & ((hy == tree.max_y) | (box[1] < hy))
    if kind == "circle":
        dx, dy = np.maximum(np.maximum(a[0] - hx, lx - a[0]), 0), np.maximum(np.maximum(a[1] - hy, ly - a[1]), 0)
        hit &= dx * dx + dy * dy < a[2] * a[2]
    out: list[list[int]] = []
    for s, e in sorted(zip(starts[hit].tolist(), ends[hit].tolist())):
        if out and s - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e + 1) for s, e in out]
