"""Record operators against brute force, and their defined cases."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import drift, proximity, spikes, treeagg
from cloudloom.runtime import is_small, materialize, shared_dir

POINTS = "point_id long, file_id long, point_index long, X int, Y int, Z int, intensity int, classification short, point_source_ID int, ingested_at timestamp, SOURCE string"


def cloud(spark, rows):
    """Rows are dicts; what is missing is null. A column whose name clashes with one an operator makes comes along."""
    names = [c.split()[0] for c in POINTS.split(", ")]
    return spark.createDataFrame([tuple("other" if n == "SOURCE" else r.get(n) for n in names) for r in rows], POINTS)


def shuffled(df):
    """Records each exchange of a plan wrote, from the scan up."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        found, nodes = [], [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            metrics = node.metrics()
            if metrics.contains("shuffleRecordsWritten"):
                found.append(metrics.apply("shuffleRecordsWritten").value())
            nodes += [node.children().apply(k) for k in range(node.children().size())]
        return found[::-1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


# -- implausible readings


def brute_spikes(rows, ranges=spikes.RANGES):
    out = set()
    for name, low, high in ranges:
        series, seen = defaultdict(list), set()
        for r in sorted(rows, key=lambda r: (r["file_id"], r["point_index"])):
            if r.get(name) is None or r.get("point_source_ID") is None or r["point_id"] in seen:
                continue
            seen.add(r["point_id"])
            series[r["point_source_ID"], r["file_id"]].append((r["point_id"], r[name]))
        away = defaultdict(list)
        for (s, f), v in series.items():
            for k, (p, x) in enumerate(v):
                away[s].append((p, x, abs(x - float(np.median([y for _, y in v[max(0, k - 5) : k + 6]])))))
        for (s, f), v in series.items():
            scatter = max(1.0, 1.4826 * float(np.median([a for _, _, a in away[s]])))
            level = {p: a for p, _, a in away[s]}
            for p, x in v:
                if not low <= x <= high or level[p] > 10 * scatter:
                    out.add((p, name))
            if scatter > 2:
                for i in range(len(v)):
                    j = i
                    while j + 1 < len(v) and abs(v[j + 1][1] - v[i][1]) <= 1:
                        j += 1
                    if j - i + 1 >= 20:
                        out |= {(p, name) for p, _ in v[i : j + 1]}
    return out


def spiky(seed, files=6, n=400, sources=(1, 1, 1, 2, 3)):
    rng = random.Random(seed)
    rows, pid = [], 0
    for f in range(files):
        z, held = 1000, 0
        for i in range(n):
            pid += 1
            z += rng.randint(-9, 9)
            if held == 0 and rng.random() < 0.01:
                held, stuck = rng.randint(15, 60), z
            if held:
                held -= 1
                z = stuck + rng.choice((0, 0, 0, 1)) if seed % 2 else stuck
            v = z + (rng.choice((-1, 1)) * rng.randint(100, 10**6) if rng.random() < 0.01 else 0)
            r = {"point_id": pid, "file_id": f, "point_index": i, "Z": v, "intensity": rng.choice((100, 101, 102, 66000 if rng.random() < 0.01 else 103)), "point_source_ID": rng.choice(sources)}
            if rng.random() < 0.02:
                r[rng.choice(("Z", "intensity", "point_source_ID"))] = None
            rows += [r] * (2 if rng.random() < 0.05 else 1)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {}), (3, {"split_rows": 50, "block": 64}), (4, {"split_rows": 50, "block": 1}), (5, {"split_rows": 100, "block": 37})])
def test_spikes(spark, seed, how):
    rows = spiky(seed)
    got = spikes.implausible(cloud(spark, rows), only_spikes=True, **how).select("point_id", "field_name")
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_spikes(rows) != set()


def test_long_runs_cross_blocks(spark):
    rows = [{"point_id": i, "file_id": 1, "point_index": i, "Z": 500 if 100 <= i < 700 else 1000 + 37 * (i % 11) - 11 * (i % 7), "point_source_ID": 9, "intensity": None} for i in range(1000)]
    got = spikes.implausible(cloud(spark, rows), only_spikes=True, split_rows=10, block=32)
    assert {(r.point_id, r.field_name) for r in got.collect()} == brute_spikes(rows)


def test_spikes_defined_cases(spark):
    assert spikes.implausible(cloud(spark, [])).count() == 0
    one = [{"point_id": 1, "file_id": 1, "point_index": 0, "Z": 900001, "intensity": -1, "point_source_ID": 1}]
    assert {r.field_name for r in spikes.implausible(cloud(spark, one * 3)).collect()} == {"Z", "intensity"}
    assert spikes.implausible(cloud(spark, [{"point_id": 1, "file_id": 1, "point_index": 0, "Z": 900001, "point_source_ID": None}])).count() == 0


def test_running_median_and_runs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 11, 12, 60):
        v = rng.integers(-50, 50, n)
        got = spikes.running_median(v, np.zeros(n, int), np.full(n, n - 1), 5)
        assert got.tolist() == [int(2 * np.median(v[max(0, k - 5) : k + 6])) for k in range(n)]
    v = np.array([0, 1, 2] * 3 + [5] * 4 + [6] + [4] * 2)
    marked = spikes.stuck_runs(v, np.zeros(len(v), int), 4, 1)
    assert marked.tolist() == [False] + [True] * 15


def test_outlier_limit_is_below_ten_scatters():
    from math import erfc, sqrt

    n = np.array([3, 4, 5, 10, 100, 1e4, 1e6, 1e9, 1e12])
    # a huge number of readings makes it the normal law: the tail beyond the limit is alpha / 2n
    assert abs(0.5 * erfc(spikes.esd_limit([1e12], [1], 0.05)[0] / sqrt(2)) * 2e12 - 0.05) < 1e-6
    for share in (0, 0.1, 0.5):
        i = np.maximum(1, np.floor(n * share))
        limit = spikes.esd_limit(n, i, 0.05)
        assert (limit < 10).all() and (limit > 0).all()
    # published critical value of the test: n = 54, first outlier, 5 %
    assert abs(spikes.esd_limit([54], [1], 0.05)[0] - 3.159) < 0.01


def test_seasonal_part(spark):
    rows = [{"point_id": i, "file_id": 1, "point_index": i, "Z": 1000 + (300 if i % 20 == 0 else 0) + i % 3, "point_source_ID": 1} for i in range(400)]
    rows[200]["Z"] = 5000
    ids = lambda **how: {r.point_id for r in spikes.implausible(cloud(spark, rows), ranges=(("Z", -50_000, 900_000),), **how).collect()}
    assert len(ids(only_spikes=True)) == 20 and ids(period=20) == {200}


@pytest.mark.parametrize("block", [1, 70, 300])
def test_seasons_do_not_depend_on_the_cut(spark, block):
    rng = random.Random(8)
    rows = [{"point_id": i, "file_id": 1, "point_index": i, "Z": 1000 + 40 * (i % 50 == 3) + 90 * (i % 50 == 20) + rng.randint(-4, 4), "intensity": rng.randint(0, 9) or None, "point_source_ID": 1} for i in range(3000)]
    rows[1503]["Z"] = 5000
    whole, cut = (spikes.implausible(cloud(spark, rows), period=50, **how) for how in ({}, {"split_rows": 100, "block": block}))
    assert sorted(whole.collect()) == sorted(cut.collect())
    assert {(r.point_id, r.season) for r in whole.where("field_name = 'Z' and is_spike").collect()} == {(1503, whole.where("point_id = 1503").first().season)}
    assert 35 < whole.where("point_id = 1503").first().season < 45


def test_outliers_by_hand(spark):
    z = [(3, -3, 7)[i % 3] + (0, 40, 60, 4000)[(i in (30, 90)) + 2 * (i in (60,)) + 0] for i in range(120)]
    rows = [{"point_id": i, "file_id": 1, "point_index": i, "Z": v, "point_source_ID": 1} for i, v in enumerate(z)]
    away = sorted(((abs(v - float(np.median(z[max(0, k - 5) : k + 6]))), k) for k, v in enumerate(z)), reverse=True)
    scatter = max(1.0, 1.4826 * float(np.median([a for a, _ in away])))
    outliers = max((i for i in range(1, 61) if away[i - 1][0] / scatter > spikes.esd_limit([120], [i], 0.05)[0]), default=0)
    got = spikes.implausible(cloud(spark, rows)).collect()
    assert {r.point_id for r in got if r.is_outlier} == {k for _, k in away[:outliers]} != set() and all(r.scatter == scatter for r in got)
    with pytest.raises(ValueError):
        spikes.implausible(cloud(spark, rows), alpha=0.5)


def test_constant_series_move_in_proportion(spark):
    moved = {}
    for n in (4000, 16000):
        rows = spark.range(n).select(F.col("id").alias("point_id"), F.lit(1).cast("long").alias("file_id"), F.col("id").alias("point_index"), F.lit(7).alias("Z"), F.lit(3).alias("point_source_ID"))
        got = spikes.decompose(rows, ranges=(("Z", 0, 9),), split_rows=10, block=1000)
        assert got.where("flags = 2").count() == n
        moved[n] = sum(shuffled(got))
    assert moved[16000] < 4.2 * moved[4000]


# -- heavy keys


def test_tree_aggregation(spark):
    rng = random.Random(4)
    rows = [{"point_id": i, "classification": 2 if rng.random() < 0.5 else rng.choice((None, 1, 3, 4)), "point_source_ID": rng.choice((7, 7, 7, 8, None, *range(20))), "Z": rng.choice((None, 1, 5, -3))} for i in range(3000)]
    df = cloud(spark, rows + rows[:500])
    for fan in (2, 3, 16):
        per = treeagg.per_value(df, ["classification", "point_source_ID"], "point_id", ["Z"], fan).collect()
        got = {(r.field_name, r.key_value): (r["rows"], r.n_Z, r.sum_Z, r.min_Z, r.max_Z) for r in per}
        assert len(got) == len(per)
        for f in ("classification", "point_source_ID"):
            for k in {r[f] for r in rows}:
                own = [r["Z"] for r in rows if r[f] == k]
                z = [v for v in own if v is not None]
                assert got[f, k] == (len(own), len(z), sum(z) if z else None, min(z, default=None), max(z, default=None))
    heavy = treeagg.heavy_values(treeagg.per_value(df, ["classification"], "point_id"), {"classification": 0.2}).collect()
    assert [(r.key_value, r["rows"]) for r in heavy] == [(2, sum(r["classification"] == 2 for r in rows))]
    assert treeagg.per_value(df.limit(0), ["classification"], "point_id").count() == 0


def test_chunks_are_combined_where_they_lie(spark):
    rows = [{"point_id": i, "classification": i % 3, "point_source_ID": i % 2} for i in range(20000)]
    df = cloud(spark, rows)
    small, parts = {}, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            per = treeagg.per_value(df, ["classification", "point_source_ID"], "point_id", fan_in=4)
            small[n] = shuffled(per)
            assert {(r.field_name, r.key_value): r["rows"] for r in per.collect()} == {**{("classification", k): len(range(k, 20000, 3)) for k in range(3)}, **{("point_source_ID", k): 10000 for k in range(2)}}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    # a task leaves one state per tuple it holds, six at most, and each round a fourth of the chunks
    assert small[4][1] == 6 * 4 and small[40][1] == 6 * 40 and len(small[40]) > len(small[4])
    assert small[40][2:] == sorted(small[40][2:], reverse=True) and small[40][2] <= 12 * 10


# -- proximity

ZONES = "zone_id long, zone_name string, shape string, min_x int, min_y int, max_x int, max_y int, centre_x int, centre_y int, radius int"


def brute_near(rows, zones, radius):
    pts = {r["point_id"]: (r["X"], r["Y"]) for r in rows if r["X"] is not None and r["Y"] is not None and r["point_id"] is not None}
    ids, out = sorted(pts), Counter()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2 < radius * radius:
                out["near", a, b] += 1
    for z in zones:
        for p, (x, y) in pts.items():
            if z[2] == "rect" and None not in z[3:7] and z[3] <= x < z[5] and z[4] <= y < z[6]:
                out["inside", z[0], p] += 1
            if z[2] == "circle" and None not in z[7:] and (x - z[7]) ** 2 + (y - z[8]) ** 2 < z[9] ** 2:
                out["inside", z[0], p] += 1
    return out


@pytest.mark.parametrize("radius,spread", [(25, 700), (25, 40000), (3, 60), (400, 20000)])
def test_neighbours_and_zones(spark, radius, spread):
    rng = random.Random(radius + spread)
    edge = [32 * 32, 1 << 14, -1024, 0, 2048]
    place = lambda: rng.choice((rng.randint(-spread, spread), rng.choice(edge) + rng.randint(-2 * radius, 2 * radius)))
    rows = [{"point_id": i, "X": place(), "Y": place()} for i in range(600)]
    rows += rows[:60] + [{"point_id": 1000 + i, "X": rows[i]["X"], "Y": rows[i]["Y"]} for i in range(20)]
    rows += [{"point_id": 5000, "X": None, "Y": 1}, {"point_id": 5001, "X": 1, "Y": None}, {"point_id": None, "X": 1, "Y": 1}]
    zones = [(1, "a", "rect", -spread, -spread, 0, 0, None, None, None), (2, "b", "rect", 0, 0, spread, spread, None, None, None), (3, "c", "circle", None, None, None, None, 0, 0, spread // 2),
             (4, "d", "circle", None, None, None, None, 5, 5, 0), (5, "e", "rect", 10, 10, 10, 20, None, None, None), (6, "f", "rect", None, 0, 1, 1, None, None, None), (7, "g", "what", 0, 0, 1, 1, 0, 0, 1)]
    z = spark.createDataFrame(zones, ZONES)
    want = brute_near(rows, zones, radius)
    got = Counter((r.kind, r.left_id, r.right_id) for r in proximity.neighbours_and_zones(cloud(spark, rows), z, radius).collect())
    assert got == want and len(want) > 100
    far = Counter((r.kind, r.left_id, r.right_id) for r in proximity.zones_by_tile(cloud(spark, rows), z.where("zone_id <= 5"), salts=3).collect())
    assert far == Counter({k: v for k, v in want.items() if k[0] == "inside"})


def test_proximity_defined_cases(spark):
    z = spark.createDataFrame([], ZONES)
    assert proximity.neighbours_and_zones(cloud(spark, []), z, 25).count() == 0
    same = [{"point_id": i, "X": 2**31 - 1, "Y": -(2**31)} for i in range(4)]
    assert proximity.neighbours_and_zones(cloud(spark, same), None, 25).count() == 6
    assert proximity.neighbours_and_zones(cloud(spark, same), None, 0).count() == 0


# -- drift

DUMPS = "dump_id long, feed_id long, seq_no long, file_id long, dumped_at timestamp, received_at timestamp, payload string, SHAPE string"
HEADERS = "file_id long, file_name string, version_minor short, point_data_format_id short, point_data_record_length int, generating_software string, number_of_points_by_return array<long>, x_offset double, received_at timestamp, payload string, seq_no int"


def dumps(spark, payloads, feed=1, start=0):
    rows = [(start + k, feed, k + 1, k % 5, None, None, p if p is None or isinstance(p, str) else json.dumps(p), "x") for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, DUMPS)


def headers(spark):
    return spark.createDataFrame([(k, f"f{k}", 2 + k % 3, k, 20 + 2 * k, f"tool {k}", [k, 1], 0.5 * k, None, "extra", 7) for k in range(5)] * 2, HEADERS)


def test_changes_by_kind(spark):
    v, f, r = (lambda k: 2 + k % 5 % 3), (lambda k: k % 5), (lambda k: 20 + 2 * (k % 5))
    p = [
        {"version_minor": v(0), "point_data_format_id": f(0), "note": "a"},
        {"minor": v(1), "point_data_format_id": str(f(1)), "note": "a"},  # renamed, retyped
        {"minor": None, "fmt": {"id": f(2) | 128}, "note": "a"},  # renamed and retyped, null keeps
        "broken {", None, "", "[1]", '{"a": NaN}', "5",
        {"minor": float(v(9)), "fmt": {"id": f(9)}, "other": True},  # retyped; note removed, other added
        {"other": True, "fmt": {"id": [f(10)]}, "minor": float(v(10))},  # key order is no change; retyped
        {"minor": v(11), "fmt": {"id": None}, "other": None},
        {"minor": v(12), "fmt": {"id": [f(12)]}, "other": "x"},
        {"minor": v(13), "fmt": {}, "other": "x", "len": r(13)},
        {"minor": f"0x0{v(14)}", "fmt": {}, "other": "x", "len": f"00{r(14)}"},
        {"minor": v(15), "fmt": {}, "other": "x", "len": r(15), "late": None},
        {"minor": v(16), "fmt": {}, "other": "x", "len": r(16), "late": 5},
    ]
    want = {
        (1, "version_minor", "renamed"), (1, "point_data_format_id", "retyped"), (2, "point_data_format_id", "renamed"), (2, "point_data_format_id", "retyped"),
        (9, "version_minor", "retyped"), (9, "note", "removed"), (9, "other", "added"), (10, "point_data_format_id", "retyped"), (11, "version_minor", "retyped"),
        (12, "other", "retyped"), (13, "point_data_format_id", "removed"), (13, "point_data_record_length", "added"), (14, "version_minor", "retyped"), (14, "point_data_record_length", "retyped"),
        (15, "version_minor", "retyped"), (15, "point_data_record_length", "retyped"), (15, "late", "added"),
    }
    d = dumps(spark, p)
    for block in (4096, 3, 1):
        got = [(r.dump_id, r.field_name, r.change) for r in drift.changes(d.unionByName(d.limit(5)), headers(spark), block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    table = {r.dump_id: r for r in drift.conform(d, headers(spark)).collect()}
    assert len(table) == 11
    assert (table[2].version_minor, table[2].point_data_format_id) == (None, 2) and table[14].version_minor == v(14) and table[14].point_data_record_length == r(14)
    assert (table[1].point_data_format_id, table[10].point_data_format_id) == (f(1), f(10))
    kinds = drift.versions(d, headers(spark))
    assert kinds.agg(F.sum("dumps")).first()[0] == 11 and kinds.count() > 8


def test_blocks_agree(spark):
    rng = random.Random(9)
    p = []
    for k in range(400):
        row = {"version_minor" if rng.random() < 0.9 else "minor": rng.choice((2 + k % 5 % 3, None, None))}
        for c in "abc":
            if rng.random() < 0.8:
                row[c] = rng.choice((None, None, 1, "x", 2.5, [1], True))
        p.append(row if rng.random() < 0.95 else "{")
    d = dumps(spark, p)
    one = drift.changes(d, headers(spark)).exceptAll(drift.changes(d, headers(spark), 7))
    assert one.isEmpty() and drift.changes(d, headers(spark), 7).count() == drift.changes(d, headers(spark)).count() > 100


def test_one_dump_with_both_names(spark):
    row = lambda k, name: {name: 20 + 2 * (k % 5), "version_minor": 2 + k % 5 % 3}
    p = [row(k, "point_data_record_length" if k < 100 else "len") for k in range(200)]
    want = {(100, "point_data_record_length", "renamed")}
    got = drift.changes(dumps(spark, p), headers(spark)).collect()
    assert {(r.dump_id, r.field_name, r.change) for r in got} == want and len(got) == 1
    p[50]["len"] = 30
    got = drift.changes(dumps(spark, p), headers(spark)).collect()
    assert {(r.dump_id, r.field_name, r.change) for r in got} == want | {(50, "len", "added"), (51, "len", "removed")}


def test_migrations_and_rules(spark):
    v = lambda k: 2 + k % 5 % 3
    p = [{"minor" if k // 3 % 2 else "version_minor": v(k) if k // 6 % 2 else str(v(k)), "note": [1, "x"]} for k in range(60)]
    d = dumps(spark, p)
    # every pair of versions is stored once, however often it is met
    met = {(r.change, r.from_type, r.to_type): (r.moves, r.from_path, r.to_path) for r in drift.all_migrations(d, headers(spark)).collect()}
    assert met == {("renamed", "string", "string"): (5, "version_minor", "minor"), ("renamed", "integer", "integer"): (5, "version_minor", "minor"),
                   ("renamed", "string", "integer"): (5, "minor", "version_minor"), ("retyped", "string", "integer"): (5, "minor", "version_minor"),
                   ("renamed", "integer", "string"): (4, "minor", "version_minor"), ("retyped", "integer", "string"): (4, "minor", "version_minor")}
    rules = defaultdict(list)
    for r in sorted(drift.rules(d, headers(spark)).collect(), key=lambda r: r.step):
        rules[r.fingerprint].append((r.rule, r.field, r.was, r.becomes))
    assert len(rules) == 4 and sum(("rename", "version_minor", "minor", "version_minor") in x for x in rules.values()) == 2
    assert all([x[0] for x in steps] == sorted((x[0] for x in steps), key=["rename", "default", "cast"].index) for steps in rules.values())
    assert [r.version_minor for r in drift.conform(d, headers(spark)).orderBy("seq_no").collect()] == [v(k) for k in range(60)]
    bad = drift.conform(dumps(spark, [{"version_minor": "many", "x_offset": 10**400, "point_data_record_length": 10**12, "number_of_points_by_return": ["1", 2.0], "generating_software": 5}]), headers(spark)).first()
    assert sorted(bad.failed_casts) == ["point_data_record_length", "version_minor"] and bad.version_minor is None and bad.number_of_points_by_return == [1, 2] and bad.generating_software == "5" and bad.file_name == "f0"


def test_drift_defined_cases(spark):
    empty = spark.createDataFrame([], DUMPS)
    assert drift.changes(empty, headers(spark)).count() == 0 and drift.conform(empty, headers(spark)).count() == 0
    odd = dumps(spark, [{"a": 1}, {"a": {"b": {"c": 10**30}}, "\ud800": 1}, '{"a": 1, "a": "x"}', "{" * 5000])
    got = Counter((r.field_name, r.change) for r in drift.changes(odd, headers(spark)).collect())
    assert got["a", "removed"] == 1 and got["a.b.c", "added"] == 1 and got["a", "added"] == 1


# -- runtime


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(10))
    assert df.count() == 10 and shared_dir(spark).removeprefix("file://").rstrip("/") in df.inputFiles()[0]
    assert is_small(df, 10) and not is_small(df, 9)
