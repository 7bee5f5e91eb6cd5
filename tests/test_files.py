"""Point files: known checksums, round trips, damage, metadata, the Spark source and sink."""

import io
import os
import struct

import numpy as np
import pytest
from fixture_points import CHUNK, N, points
from hypothesis import given, settings
from hypothesis import strategies as st
from known_answers import FILES, RECTANGLES
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import GreaterThan, LessThan, LessThanOrEqual

from cloudloom.operators import folds, regions, runindex
from cloudloom.sources.las import container, entropy
from cloudloom.sources.las import header as H
from cloudloom.sources.las import metadata as M
from cloudloom.sources.las.datasource import Part, PushingReader, decode_binary, read_headers, read_las, register, spans
from cloudloom.sources.las.entropy import LasDataError
from cloudloom.sources.las.file import LasFile, Layout, append_index, write_las
from cloudloom.sources.las.formats import UnsupportedFormat, base_size, items_of


def layout(name: str) -> tuple[Layout, dict]:
    stem, ending = name.rsplit(".", 1)
    fmt, compat, extra = int(stem.split("_")[0][2:]), "compat" in stem, 0 if "noextra" in stem else 6
    version = int(stem.split("_v")[1][0])
    lay = Layout(fmt, extra=extra, compressed=ending == "laz", compressor=1 if "pointwise" in stem else None, item_version=version or None, chunk_size=CHUNK, compatibility=compat)
    return lay, points(fmt, compat, extra)


def written(lay: Layout, *blocks) -> bytes:
    b = io.BytesIO()
    write_las(b, blocks, lay)
    return b.getvalue()


def fnv(cols) -> int:
    h = folds.FNV_OFFSET
    for r in folds.records(cols, len(cols["X"])):
        h = folds.fnv1a(r, h)
    return h


@pytest.mark.parametrize("name", sorted(FILES))
def test_known_checksums(name):
    lay, cols = layout(name)
    with LasFile(written(lay, cols)) as f:
        assert len(f) == N and f.header.format == lay.point_format and not f.warnings
        assert fnv(f.columns()) == FILES[name]


@pytest.mark.parametrize("rect", RECTANGLES)
@pytest.mark.parametrize("name", ["pt0_v0.las", "pt1_v1_pointwise.laz", "pt1_v2.laz", "pt6_v3.laz"])
def test_known_rectangles(name, rect):
    lay, cols = layout(name)
    with LasFile(written(lay, cols)) as f:
        hit, cols = f.within("Z", rect=rect)
        whole = f.columns("Z")["Z"]
        assert np.array_equal(cols["Z"], whole[hit])
    assert (len(hit), folds.fnv1a(hit.astype("<u8").tobytes())) == RECTANGLES[rect]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 299), st.integers(0, 1), st.integers(-(2**31), 2**31 - 1), st.integers(0, 2**32 - 1), st.integers(0, 65535)), max_size=60))
def test_entropy_round_trip(rows):
    def run(io):
        m, b, wide, narrow = entropy.Symbols(300), entropy.Bit(), entropy.Ints(32, 3), entropy.Ints(16, 2)
        return [(io.symbol(m, r[0]), io.bit(b, r[1]), wide.code(io, 7, r[2], 1), io.bits(32, r[3]), narrow.code(io, 300, r[4])) for r in rows]

    w = entropy.Writer()
    run(w)
    data = w.finish()
    r = entropy.Reader(data)
    assert run(r) == rows and r.pos <= len(data)


@pytest.mark.parametrize("fmt,version", [(f, v) for f in range(11) for v in ((1, 2) if f < 6 else (3, 4))])
def test_any_records_survive(fmt, version):
    rng = np.random.default_rng(fmt * 10 + version)
    items = items_of(fmt, base_size(fmt) + 18, version)
    n = 300
    raw = rng.integers(0, 256, (n, sum(i.size for i in items)), dtype=np.uint8)
    # now and then a record is like the one before, so that all branches of the predictors are met
    for k in range(1, n):
        if rng.random() < 0.5:
            raw[k] = raw[k - 1]
            raw[k, rng.integers(0, raw.shape[1])] ^= rng.integers(0, 3, dtype=np.uint8)
    at = np.cumsum([0, *[i.size for i in items]])
    values = [[container.raw_values(i, bytes(r[a:b])) for r in raw] for i, a, b in zip(items, at, at[1:])]
    data = container.encode_chunk(values, items, fmt > 5)
    cols, _ = container.decode_chunk(data, 0, len(data), n, items, fmt > 5)
    want = container.raw_columns(raw.tobytes(), items)
    for c in want:
        a, b = cols[c], want[c]
        same = a.view(np.int64) == np.ascontiguousarray(b).view(np.int64) if a.dtype == np.float64 else a == b
        assert np.all(same), c


@pytest.mark.parametrize("size", [1, 2, 7, 499, 500, 501])
def test_chunk_size_changes_nothing(size):
    for fmt in (3, 10):
        lay = Layout(fmt, extra=6, chunk_size=size)
        with LasFile(written(lay, points(fmt))) as f:
            # only the first point of a chunk follows the raw record's rule in wide formats
            names = [c for c in f.names if "class" not in c and "flag" not in c]
            got, want = f.columns(*names), points(fmt)
            for c in names:
                if c in want and not c.startswith(("scan_angle_rank", "return_number", "number_of")):
                    assert np.array_equal(got[c], want[c]), c


def test_slices_and_seeks():
    lay, cols = layout("pt7_v4.laz")
    with LasFile(written(lay, cols)) as f:
        whole = f.columns("X", "gps_time")
        for a, n in ((0, 1), (130, 20), (136, 1), (137, 274), (499, 1), (490, 100), (500, 5)):
            got = f.columns("X", "gps_time", start=a, count=n)
            assert np.array_equal(got["X"], whole["X"][a : a + n]) and np.array_equal(got["gps_time"], whole["gps_time"][a : a + n])
        with pytest.raises(IndexError):
            f.columns(start=501)
        with pytest.raises(ValueError):
            f.columns("nothing")


def test_adaptive_chunks():
    cols = points(1)
    cut = lambda a, b: {c: v[a:b] for c, v in cols.items()}
    data = written(Layout(1, chunk_size=0), cut(0, 10), None, cut(10, 11), None, None, cut(11, 500))
    with LasFile(data) as f:
        assert f.table.first == [0, 10, 11, 500]
        assert np.array_equal(f.columns("X")["X"], cols["X"])
    with pytest.raises(ValueError):
        written(Layout(1, chunk_size=50), cut(0, 10), None)


def test_chunk_table_recovery():
    cols = points(3)
    data = bytearray(written(Layout(3, chunk_size=100), cols))
    start = struct.unpack_from("<I", data, 96)[0]
    table = struct.unpack_from("<q", data, start)[0]
    interrupted = data[:table]
    struct.pack_into("<q", interrupted, start, start)
    for damaged in (interrupted, data[: table + 8] + b"\xff" * 8):
        with LasFile(bytes(damaged)) as f:
            assert len(f.warnings) == 1 and np.array_equal(f.columns("X")["X"], cols["X"])
            assert np.array_equal(f.columns("X", start=150, count=100)["X"], cols["X"][150:250])
    adaptive = bytearray(written(Layout(3, chunk_size=0), cols))
    struct.pack_into("<q", adaptive, start, start)
    with pytest.raises(LasDataError):
        LasFile(bytes(adaptive))
    # written where the position could not be put in front: it comes last
    late = bytearray(data) + struct.pack("<q", table)
    struct.pack_into("<q", late, start, -1)
    with LasFile(bytes(late)) as f:
        assert not f.warnings and np.array_equal(f.columns("X")["X"], cols["X"])


@pytest.mark.parametrize("at", [0, 3, 50, 100, 226, 240, 300, 400, 900, 3000])
def test_cut_files_raise(at):
    for name in ("pt3_v2.laz", "pt8_v3.laz", "pt3_v0.las"):
        lay, cols = layout(name)
        data = written(lay, cols)[:at]
        with pytest.raises(LasDataError):
            LasFile(data).columns()


def test_damaged_bytes_never_hang():
    rng = np.random.default_rng(5)
    for name in ("pt1_v2.laz", "pt6_v4.laz"):
        lay, cols = layout(name)
        good = written(lay, cols)
        for _ in range(60):
            bad = bytearray(good)
            for k in rng.integers(4, len(bad), 3):
                bad[k] ^= int(rng.integers(1, 256))
            try:
                f = LasFile(bytes(bad))
                if len(f) < 5000:
                    f.columns()
            except (LasDataError, UnsupportedFormat, OverflowError, struct.error):
                pass


def test_layers_left_out_keep_their_first_value():
    lay, cols = layout("pt6_v3.laz")
    data = written(lay, cols)
    with LasFile(data, selective=1) as f:
        got = f.columns()
    with LasFile(data) as f:
        want = f.columns()
    assert np.array_equal(got["Z"], want["Z"]) and np.array_equal(got["X"], want["X"])
    for a in range(0, N, CHUNK):
        assert set(got["intensity"][a : a + CHUNK]) == {want["intensity"][a]} and set(got["user_data"][a : a + CHUNK]) == {want["user_data"][a]}


def test_records_behind_the_points():
    evlrs = [H.Vlr("someone", 1, b"x" * 70000, "long"), H.Vlr("someone", 2, b"", "empty")]
    data = written(Layout(6, evlrs=evlrs), points(6))
    with LasFile(data) as f:
        assert f.header.evlrs == evlrs and f.summary()["extended_users"] == ["someone"]
    with LasFile(data[:-30]) as f:
        assert f.header.evlrs == evlrs[:1] and f.warnings and len(f.columns("X")["X"]) == N
    with pytest.raises(ValueError):
        Layout(1, evlrs=evlrs, version_minor=2)
    with pytest.raises(ValueError):
        Layout(6, evlrs=[evlrs[0], evlrs[0]])


@pytest.mark.parametrize("bad", [{"point_format": 6, "version_minor": 3}, {"point_format": 0, "item_version": 3}, {"point_format": 6, "item_version": 2}, {"point_format": 1, "compressor": 3}, {"point_format": 1, "compatibility": True}, {"point_format": 1, "scales": (0, 1, 1)}])
def test_layouts_refused(bad):
    with pytest.raises(ValueError):
        Layout(**bad)


def test_header_is_kept():
    lay = Layout(1, scales=(0.1, 0.01, 1.0), offsets=(1.0, -2.0, 3.0), system_identifier="sys", creation=(12, 2024), user_data=b"in", user_data_after=b"behind", project_id=b"p" * 16, vlrs=[H.Vlr("me", 7, b"data", "about")])
    cols = points(1)
    with LasFile(written(lay, cols)) as f:
        h = f.header
        assert (h.user_data, h.user_data_after, h.system_identifier, h.file_creation_day, h.file_creation_year, h.project_id) == (b"in", b"behind", "sys", 12, 2024, b"p" * 16)
        assert h.record(("me", 7)).data == b"data" and h.scales == (0.1, 0.01, 1.0) and h.offsets == (1.0, -2.0, 3.0)
        assert (h.min_x, h.max_z) == (cols["X"].min() * 0.1 + 1.0, cols["Z"].max() * 1.0 + 3.0)
        assert h.number_of_points_by_return == [int((cols["return_number"] == r).sum()) for r in range(1, 6)]
        assert np.array_equal(f.columns("X")["X"], cols["X"])


def test_command_line(tmp_path, capsys):
    from cloudloom.__main__ import main

    path = str(tmp_path / "a.laz")
    write_las(path, [points(8)], Layout(8, extra=6))
    assert main([path, "2"]) == 0
    out = capsys.readouterr().out
    assert "points: 500" in out and "\n1: 1500.23 1700.23 " in out and "\n2:" not in out
    assert main([str(tmp_path / "none")]) == 1 and main([]) == 2


def test_coordinate_systems():
    for crs, want in ((25832, (25832, None)), ("PROJCS[x]", (None, "PROJCS[x]"))):
        with LasFile(written(Layout(6, crs=crs), points(6))) as f:
            s = f.summary()
            assert (s["epsg"], s["wkt"]) == want
    assert M.read_crs([M.crs_record(4326, geographic=True)]) == (4326, None)
    assert M.read_crs([H.Vlr(*H.GEOKEYS, b"\1\0\1\0")]) == (None, None)
    assert M.read_crs([H.Vlr(*H.WKT, b"\0")]) == (None, None)
    with pytest.raises(ValueError):
        M.crs_record(5)


def test_extra_bytes_described(spark):
    attrs = [M.Attribute("height", 4, scale=(0.01,), offset=(5.0,)), M.Attribute("pair", 13), M.Attribute("big", 7)]
    record = M.extra_bytes_record(attrs)
    back = M.attributes(record.data)
    assert [(a.name, a.data_type, a.start, a.size, a.parts) for a in back] == [("height", 4, 0, 2, 1), ("pair", 13, 2, 4, 2), ("big", 7, 6, 8, 1)]
    raw = struct.pack("<hHHQ", -100, 1, 65535, 2**63 + 1)
    df = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "id int, extra_bytes binary")
    r = M.decode_extra(df, back).orderBy("id").collect()
    assert r[0].height == 4.0 and r[0].pair == [1, 65535] and int(r[0].big) == 2**63 + 1 and r[1].height is None
    with pytest.raises(UnsupportedFormat):
        M.width_of(31)
    with pytest.raises(ValueError):
        M.pack_attribute(M.Attribute("opaque", 0, size=3))
    with LasFile(written(Layout(1, vlrs=[record]), points(1))) as f:
        assert f.extra == 14
    with pytest.raises(ValueError):
        Layout(1, vlrs=[record], extra=3)


def test_index_bytes_travel(tmp_path):
    path = str(tmp_path / "a.laz")
    lay, cols = layout("pt1_v2.laz")
    write_las(path, [cols], lay)
    with LasFile(path) as f:
        assert f.index_bytes() is None
    (tmp_path / "a.lax").write_bytes(b"beside")
    with LasFile(path) as f:
        assert f.index_bytes() == b"beside"
    append_index(path, b"inside")
    with LasFile(path) as f:
        assert f.index_bytes() == b"inside" and fnv(f.columns()) == FILES["pt1_v2.laz"]
    flat = str(tmp_path / "b.las")
    write_las(flat, [cols], Layout(1, compressed=False))
    with pytest.raises(ValueError):
        append_index(flat, b"no")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("clouds")
    for name in ("pt1_v2.laz", "pt8_v3.laz", "pt10_v0.las"):
        lay, cols = layout(name)
        write_las(str(d / name), [cols], lay)
    return str(d)


def test_source(spark, folder):
    df = read_las(spark, f"{folder}/pt8_v3.laz")
    assert df.count() == N
    assert int(folds.checksum(df).first().hash, 16) == FILES["pt8_v3.laz"]
    assert read_las(spark, f"{folder}/pt8_v3.laz", ["point_index", "Z"]).where("point_index between 130 and 140").count() == 11
    both = read_las(spark, folder, ["file", "nir", "gps_time"], merge=True)
    got = {os.path.basename(r.file): (r.n, r.nirs) for r in both.groupBy("file").agg(F.count("*").alias("n"), F.count("nir").alias("nirs")).collect()}
    assert got == {"pt1_v2.laz": (N, 0), "pt8_v3.laz": (N, N), "pt10_v0.las": (N, N)}
    h = {os.path.basename(r.file): (r.points, r.point_format, r.chunks) for r in read_headers(spark, folder).collect()}
    assert h == {"pt1_v2.laz": (N, 1, 4), "pt8_v3.laz": (N, 8, 4), "pt10_v0.las": (N, 10, None)}
    raw = spark.read.format("binaryFile").load(f"{folder}/pt8_v3.laz")
    assert decode_binary(raw, df.schema).count() == N
    split = read_las(spark, f"{folder}/*.la[sz]", ["point_index", "X"], groupBytes=1, splitPoints=100)
    assert split.rdd.getNumPartitions() > 6 and split.count() == 3 * N and split.select("point_index").distinct().count() == N
    for bad in ({"columns": ["nothing"]}, {"rect": (2, 0, 1, 1)}):
        with pytest.raises(Exception):  # noqa: B017
            read_las(spark, f"{folder}/pt8_v3.laz", **bad).count()


def test_areas_with_and_without_index(spark, folder):
    path = f"{folder}/pt8_v3.laz"
    xy = read_las(spark, path, ["point_index", "x", "y"], scaled=True)
    data = runindex.build(xy, cell_size=1.0, minimum_points=30, gap=5).serialize()
    plain = {r: read_las(spark, path, ["point_index"], rect=r).count() for r in RECTANGLES}
    circle = (1499.0, 1700.0, 1.0)
    inside = regions.within(xy, circle=circle).count()
    assert plain == {r: n for r, (n, _) in RECTANGLES.items()}
    with open(path.replace(".laz", ".lax"), "wb") as f:
        f.write(data)
    try:
        for r, (n, _) in RECTANGLES.items():
            assert read_las(spark, path, ["point_index"], rect=r).count() == n
        assert read_las(spark, path, ["point_index"], circle=circle).count() == inside > 0
        assert spans(data, rect=(1600, 1800, 1601, 1801)) == []
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        pushed = read_las(spark, path, ["point_index", "x", "y"], scaled=True)
        for r, (n, _) in RECTANGLES.items():
            assert regions.within(pushed, rect=r).count() == n
        assert pushed.where("x > 1600 and x < 1").count() == 0 and pushed.where("x <= 1498.0 and y = 1699.0").count() == xy.where("x <= 1498.0 and y = 1699.0").count()
        reader = PushingReader({"path": path}, pushed.schema)
        list(reader.pushFilters([LessThanOrEqual(("x",), 1600.0), GreaterThan(("x",), 1599.0), LessThan(("y",), 5.0)]))
        assert reader.box[0] == 1599.0 and reader.box[2] > 1600.0 and reader.box[3] >= 5.0 and sum(b.num_rows for b in reader.read(Part(((path, 0, None),)))) == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
        os.remove(path.replace(".laz", ".lax"))


@pytest.mark.parametrize("options", [{"pointFormat": 8, "extraBytes": 6, "single": "true", "chunkSize": 0}, {"pointFormat": 8, "extraBytes": 6}, {"pointFormat": 10, "compressed": "false", "extraBytes": 6}])
def test_sink(spark, folder, tmp_path, options):
    df = read_las(spark, f"{folder}/pt8_v3.laz")
    out = str(tmp_path / "out")
    w = df.repartitionByRange(3, "point_index").sortWithinPartitions("point_index").write.format("las").mode("append")
    for k, v in options.items():
        w = w.option(k, v)
    w.save(out)
    back = read_las(spark, out)
    cols = ["X", "Y", "Z", "intensity", "gps_time", "nir", "extended_classification", "user_data", "extra_bytes"]
    assert back.count() == N and back.select(cols).exceptAll(df.select(cols)).isEmpty()
    assert not [f for f in os.listdir(out) if f.startswith("_")]
    if options.get("single"):
        assert os.listdir(out) == ["points.laz"] and int(folds.checksum(back).first().hash, 16) == FILES["pt8_v3.laz"]


def test_sink_of_scaled_and_empty(spark, tmp_path):
    register(spark)
    df = spark.createDataFrame([(0, 1.0051, -1.0051, 0.0), (1, 2.0, None, 3.0)], "point_index long, x double, y double, z double").coalesce(1)
    df.write.format("las").option("pointFormat", 0).mode("append").save(str(tmp_path / "a"))
    assert [(r.X, r.Y, r.Z) for r in read_las(spark, str(tmp_path / "a")).orderBy("point_index").collect()] == [(101, -101, 0), (200, 0, 300)]
    df.limit(0).write.format("las").option("pointFormat", 0).mode("append").save(str(tmp_path / "b"))
    assert not [f for f in os.listdir(tmp_path / "b") if f.endswith((".las", ".laz"))]
    with pytest.raises(Exception, match="32 bits"):
        df.withColumn("x", F.lit(1e9)).write.format("las").mode("append").save(str(tmp_path / "c"))


@pytest.mark.parametrize("log", [True, False])
def test_stream_takes_files_that_land_late(spark, tmp_path, log):
    from cloudloom.sources.las.datasource import LasStreamReader, read_headers  # noqa: F401

    folder = tmp_path / "in"
    folder.mkdir()

    def land(name, time):
        (folder / name).write_bytes(b"")
        os.utime(folder / name, (time, time))

    options = {"path": str(folder), "columns": "X"} | ({"log": str(tmp_path / "log")} if log else {})
    reader = LasStreamReader(options, T.StructType([T.StructField("X", T.IntegerType())]))
    planned = []
    import cloudloom.sources.las.datasource as source

    before = source.plan_parts
    source.plan_parts = lambda files, _: planned.append([os.path.basename(f[0]) for f in files])
    try:
        start = reader.initialOffset()
        land("b.las", 200)
        for names in (["b.las"], ["a_late.las", "a_same.las"], []):
            if "a_late.las" in names:
                land("a_late.las", 100)
                land("a_same.las", 200)
            end = reader.latestOffset()
            reader.partitions(start, end)
            # a reader made anew, as after a restart, plans the same
            LasStreamReader(options, reader.batch.schema).partitions(start, end)
            assert planned[-2:] == [names, names]
            start = end
    finally:
        source.plan_parts = before
