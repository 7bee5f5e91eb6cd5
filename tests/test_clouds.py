"""Point-cloud operators: index against a sequential build, areas, functions, and every query against its SQL."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cloudloom.functions import bits, coords
from cloudloom.functions.sql import register_functions
from cloudloom.operators import folds, regions, runindex

DATA = "/root/testdata/sf0.001"


def points(spark, n=800, seed=1, box=60.0):
    rng = random.Random(seed)
    rows, x, y = [], box / 2, box / 2
    for i in range(n):
        x, y = (min(box, max(-5.0, v + rng.uniform(-2, 2))) for v in (x, y))
        rows.append((i * rng.choice((1, 1)) + (5000 if i > n // 2 else 0), round(x, 2), round(y, 2), "extra"))
    return rows, spark.createDataFrame(rows, "point_index long, x double, y double, CELL_NAME string")


def sequential(rows, tree, minimum, maximum, gap):
    """The build one point after the other."""
    leaves = tree.leaves(np.array([r[1] for r in rows]), np.array([r[2] for r in rows])).tolist()
    cells = {}
    for (i, *_), c in zip(rows, leaves):
        full, runs = cells.setdefault(c, [0, []])
        cells[c][0] = full + 1
        if runs and i - runs[-1][1] <= gap:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    for level in range(tree.levels, 0, -1) if minimum else ():
        low, up = runindex.level_offset(level), runindex.level_offset(level - 1)
        for p in {(c - low) // 4 for c in cells if low <= c < runindex.level_offset(level + 1)}:
            four = [low + 4 * p + k for k in range(4)]
            if all(c in cells for c in four) and sum(cells[c][0] for c in four) < minimum:
                kids = [cells.pop(c) for c in four]
                runs = []
                for s, e in sorted(r for k in kids for r in k[1]):
                    if runs and s - runs[-1][1] <= gap:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([s, e])
                cells[up + p] = [sum(k[0] for k in kids), runs]
    goal = max(len(cells), -maximum * len(cells) if maximum < 0 else maximum)
    gaps = sorted((b[0] - a[1], c, k) for c, (_, runs) in cells.items() for k, (a, b) in enumerate(zip(runs, runs[1:]), 1))
    drop = {(c, k) for _, c, k in gaps[: max(0, sum(len(r) for _, r in cells.values()) - goal)]} if maximum else set()
    out = set()
    for c, (full, runs) in cells.items():
        kept = []
        for k, r in enumerate(runs):
            if (c, k) in drop:
                kept[-1][1] = r[1]
            else:
                kept.append(list(r))
        out |= {(c, full, s, e) for s, e in kept}
    return out


@pytest.mark.parametrize("minimum,maximum,gap,block", [(0, 0, 3, 1 << 20), (60, 0, 3, 64), (200, -2, 2, 1 << 20), (10**6, -1, 5, 128), (30, 150, 1, 1 << 20)])
def test_index_build(spark, minimum, maximum, gap, block):
    rows, df = points(spark, seed=minimum + gap)
    ix = runindex.build(df, 4.0, minimum, maximum, gap, block)
    got = {(r.cell, r.full, r.run_start, r.run_end) for r in ix.runs.collect()}
    assert got == sequential(rows, ix.tree, minimum, maximum, gap)
    tree, listed, warnings = runindex.parse(ix.serialize())
    assert tree == ix.tree and set(listed) == got and not warnings and [r[0] for r in listed] == sorted(r[0] for r in listed)
    again = runindex.from_bytes(spark, ix.serialize())
    for area in ({"rect": (10, 10, 30, 30)}, {"circle": (30.0, 30.0, 7.0)}, {"rect": (-100, -100, 1000, 1000)}, {"rect": (500, 500, 600, 600)}, {"circle": (0.0, 0.0, 0.0)}):
        want = regions.within(df, **area)
        for i in (ix, again):
            assert i.within(df, **area).exceptAll(want).isEmpty() and i.within(df, **area).count() == want.count()


def test_tree():
    t = runindex.Tree.over(-3.2, 17.9, 0.0, 5.5, 1.0)
    assert t.levels == 5 and t.max_x - t.min_x == 32 and (t.min_x, t.min_y) == (-9.0, -13.0)
    cells = t.leaves(np.array([-9.0, 22.99, 1e9, -1e9]), np.array([-13.0, 18.99, 1e9, -1e9]))
    assert cells.tolist() == [341, 341 + 1023, 341 + 1023, 341]
    lx, hx, ly, hy = t.box(np.array([0, 1, 4, 341]))
    assert lx.tolist() == [-9, -9, 7, -9] and hx.tolist() == [23, 7, 23, -8] and ly.tolist() == [-13, -13, 3, -13]
    for bad in ((0, 1, 0, 1, 0.0), (1, 0, 0, 1, 1.0), (0, 1e6, 0, 1, 1.0), (float("nan"), 1, 0, 1, 1.0)):
        with pytest.raises(ValueError):
            runindex.Tree.over(*bad)


def test_index_bytes_refused():
    good = b"LASX\0\0\0\0LASS\0\0\0\0LASQ\0\0\0\0" + (1).to_bytes(4, "little") + bytes(8) + np.array([0, 2, 0, 2], "<f4").tobytes() + b"LASV\0\0\0\0"
    assert runindex.parse(good + bytes(4))[1] == []
    twice = good + np.array([2, 1, 1, 5, 3, 3, 1, 1, 7, 9, 9], "<u4").tobytes()
    assert runindex.parse(twice)[1] == [(1, 5, 3, 3)] and len(runindex.parse(twice)[2]) == 1
    for bad in (good, b"LASY" + good[4:], good + np.array([1, 1, 1, 5, 4, 3], "<u4").tobytes(), good + np.array([1, 5, 1, 5, 3, 4], "<u4").tobytes(), good[:20]):
        with pytest.raises(runindex.IndexDataError):
            runindex.parse(bad)


def test_empty_cloud_has_no_index(spark):
    with pytest.raises(ValueError):
        runindex.build(spark.createDataFrame([], "point_index long, x double, y double"))


def test_area_arguments(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (2, None, 1.0)], "point_index long, x double, y double")
    assert regions.within(df, rect=(0, 0, 1, 1)).count() == 1 and regions.within(df, circle=(0, 0, 1.414)).count() == 1 and regions.within(df, circle=(0, 0, 0)).count() == 0
    for error, bad in ((TypeError, {}), (TypeError, {"rect": (0, 0, 1, 1), "circle": (0, 0, 1)}), (TypeError, {"rect": (0, 0, 1)}), (ValueError, {"rect": (1, 0, 0, 1)}), (ValueError, {"circle": (0, 0, -1)}), (ValueError, {"circle": (0, 0, float("nan"))})):
        with pytest.raises(error):
            regions.within(df, **bad)
    with pytest.raises(IndexError):
        regions.points_slice(df, 1, 5, total=3)
    with pytest.raises(IndexError):
        regions.seek(df, -1)


def test_scalar_functions(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (1.5,), (-2.5,), (0.49,), (None,)], "v double")
    assert [r[0] for r in df.select(coords.quantize(F.col("v"), 1.0)).collect()] == [1, -1, 2, -3, 0, None]
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.createDataFrame([(1e12,)], "v double").select(coords.quantize(F.col("v"), 1.0)).collect()
    assert coords.auto_offset(4.5e6, 4.6e6, 0.01) == 4.5e6 and coords.auto_offset(-1, 1, 0.01) == 0.0
    with pytest.raises(ValueError):
        coords.auto_offset(0, 1, 0)
    row = spark.range(1).select(*[F.lit(v).alias(f) for f, v in (("return_number", 5), ("number_of_returns", 9), ("scan_direction_flag", 3), ("edge_of_flight_line", 0))])
    byte = row.select(bits.pack({f: F.col(f) for f in row.columns}).alias("b"))
    assert byte.first().b == 5 | 1 << 3 | 1 << 6
    with pytest.raises(ValueError):
        bits.pack({"return_number": F.lit(1), "classification": F.lit(1)})
    register_functions(spark)
    got = spark.sql("SELECT unpack_return_number(93), unpack_number_of_returns(93), scale_coordinate(150, 0.01D, 2D), in_circle(1D, 1D, 0D, 0D, 1.5D), legacy_return_number(9, 9)").first()
    assert tuple(got) == (5, 3, 3.5, True, 7)


def test_field_ranges(spark):
    import struct

    from cloudloom.functions.fields import require_ranges, wave_packet

    df = spark.createDataFrame([(5, 7, "a"), (None, 0, "b")], "intensity int, return_number short, other string")
    assert require_ranges(df).collect() == df.collect()
    for bad in ((70000, 1), (-1, 1), (1, 8)):
        with pytest.raises(Exception, match="out of its range"):
            require_ranges(spark.createDataFrame([(*bad, "a")], df.schema)).collect()
    raw = struct.pack("<BQIffff", 3, 2**63 + 5, 128, 1.5, 0.25, -0.5, 2.0)
    w = spark.createDataFrame([(raw,), (None,), (b"short",)], "w binary").select(wave_packet(F.col("w")).alias("p")).select("p.*").collect()
    assert (w[0].descriptor, int(w[0].offset), w[0]["size"], w[0].return_point, w[0].dz) == (3, 2**63 + 5, 128, 1.5, 2.0) and w[1].dx is None and w[2].descriptor is None


def test_steps(spark):
    rng = random.Random(6)
    rows = [(f, i, rng.choice((None, rng.randint(-50, 50)))) for f in (1, 2, None) for i in range(300)] + [(3, 0, 5), (4, None, 1)]
    df = spark.createDataFrame(rows, "f long, point_index long, v int")
    want = {}
    for f in (1, 2):
        v = [x for k, _, x in rows if k == f and x is not None]
        d = [b - a for a, b in zip(v, v[1:])]
        want[f] = (min(d), max(d), len(d))
    for block in (1, 7, 1 << 16):
        assert {r.f: (r.least, r.most, r.steps) for r in folds.steps(df, "f", "v", block=block).collect()} == want


def test_rasters(spark):
    df = spark.createDataFrame([(0, 0, 1), (9, 9, 2), (10, 0, 3), (10, 1, 7)], "X int, Y int, Z int")
    sparse = folds.raster(df, F.col("X"), F.col("Y"), F.col("Z"), 0.0, 10.0, 10.0)
    got = {(r.row, r.col): r.value for r in folds.dense_raster(sparse, 2, 3).collect()}
    assert got[0, 0] == 2 and got[1, 0] == 1 and got[0, 1] == 7 and got[1, 1] == 3 and np.isnan(got[1, 2])


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else float(f"{v:.12g}")
    return int(v) if isinstance(v, (bool, int, np.integer)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n in {k for m in entry._MODULES if ".llm." not in m.__name__ for k in m.QUERIES}])
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    cur = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    want = sorted((tuple(map(norm, r)) for r in cur.fetchall()), key=key)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_runs_without_a_key_across_blocks(spark):
    rng = random.Random(12)
    for trial in range(4):
        runs = [(s, s + rng.choice((0, 1, 5, 40, 300 if rng.random() < 0.1 else 2)), 1) for s in (rng.randint(0, 2000) for _ in range(120))]
        want = []
        for s, e, n in sorted(runs):
            if want and s - want[-1][1] <= 3:
                want[-1] = [want[-1][0], max(want[-1][1], e), want[-1][2] + n]
            else:
                want.append([s, e, n])
        df = spark.createDataFrame(runs, "run_start long, run_end long, n long")
        for block in (16, 256, 1 << 20):
            got = runindex.merge_runs(df, [], 3, block).select("run_start", "run_end", "n").collect()
            assert sorted(map(list, got)) == want, (trial, block)


def test_place_among_values(spark):
    rng = random.Random(5)
    v = [rng.choice((3, 3, 3, 10**12, -7, rng.randint(-(10**15), 10**15))) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    for place in (1, 100, 250, 499, 500):
        want = sorted(v)[place - 1]
        assert runindex._place(df, "v", place) == (want, sum(x < want for x in v))
