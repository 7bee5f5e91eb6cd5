"""Queries through the rest of the file formats: every container and codec, records, coordinate systems, damaged files, rules for arguments; with their SQL."""

from __future__ import annotations

import base64
import json
import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.__main__ import report
from cloudloom.functions import coords, fields
from cloudloom.operators import regions, runindex
from cloudloom.plans.clouds import _PC, _RECT_SQL, RECT, cloud
from cloudloom.plans.files import _F, _NEW, _OLD, _fields, _folder, _names, _wide, _write
from cloudloom.runtime import table
from cloudloom.sources.las import header as H
from cloudloom.sources.las import metadata as M
from cloudloom.sources.las.datasource import chunk_table, copy_las, decode_binary, find_chunks, metadata_records, read_headers, read_las, register, write_index
from cloudloom.sources.las.entropy import LasDataError
from cloudloom.sources.las.file import Layout, append_index
from cloudloom.sources.las.formats import UnsupportedFormat
from cloudloom.sources.las.lanes import MOST_LANES


def _whole(df: DataFrame, **options) -> str:
    """Writes one file from one task: for containers that are a single stream, and chunks of a fixed size."""
    register(df.sparkSession)
    path = _folder(df.sparkSession)
    w = df.coalesce(1).sortWithinPartitions("point_index").write.format("las").mode("append")
    for k, v in ({"single": "true"} | options).items():
        w = w.option(k, v)
    w.save(path)
    return path


def _ranked(df: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Adds ``rank``, the place of a row in the order of ``point_index``, from 0; no task sees more than blocks of it."""
    at = df.withColumn("block", F.floor(F.col("point_index") / block))
    before = at.groupBy("block").count().withColumn("before", F.sum("count").over(Window.orderBy("block")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("block").orderBy("point_index"))
    return at.join(before, "block").withColumn("rank", F.col("before") + within - 1).drop("block", "before")


def _chunked(df: DataFrame, size: int, **options) -> str:
    """Writes one file of chunks of a fixed size from many tasks: each gets whole chunks."""
    spark = df.sparkSession
    register(spark)
    path = _folder(spark)
    # enough chunks a task for them to be coded side by side, but no core without any
    parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // (MOST_LANES * size)))
    w = _ranked(df).withColumn("chunk", F.floor(F.col("rank") / size)).repartitionByRange(parts, "chunk").sortWithinPartitions("rank").drop("rank", "chunk").write.format("las").mode("append")
    for k, v in ({"single": "true", "chunkSize": size} | options).items():
        w = w.option(k, v)
    w.save(path)
    return path


def _extra(df: DataFrame) -> DataFrame:
    """Three extra bytes a point."""
    h = F.lpad(F.hex((F.col("point_index") * 7) % 16777216), 6, "0")
    return df.withColumn("extra_bytes", F.unhex(h))


def _waves(df: DataFrame) -> DataFrame:
    """A 29-byte wave packet a point: descriptor, offset, size and four numbers, lowest byte first."""

    def low_first(v, size: int):
        big = F.lpad(F.hex(v), 2 * size, "0")
        return F.concat(*[F.substring(big, 2 * k + 1, 2) for k in range(size - 1, -1, -1)])

    i = F.col("point_index")
    # 1.0, 2.0, 0.5 and -1.0 as single-precision numbers
    numbers = F.concat(*[F.lit(struct.pack("<f", v).hex()) for v in (1.0, 2.0, 0.5, -1.0)])
    return df.withColumn("wave_packet", F.unhex(F.concat(low_first(i % 5 + 1, 1), low_first(i * 128, 8), low_first(i % 97, 4), numbers)))


_RGB = ["red", "green", "blue"]


def las_wide_scan(spark, sf_dir):
    """Uncompressed records of format 6: old fields are what fits of the new ones."""
    wide = _wide(spark, sf_dir).withColumns({"extended_return_number": (F.col("point_index") % 11 + 1).cast("short"), "extended_number_of_returns": (F.col("point_index") % 15 + 1).cast("short")})
    path = _write(wide, pointFormat="6", compressed="false")
    return read_las(spark, path, [*_NEW, "return_number", "number_of_returns"])


def laz_pointwise(spark, sf_dir):
    """The container that is one stream of points."""
    return read_las(spark, _whole(_fields(spark, sf_dir), pointFormat="1", container="pointwise"), [*_OLD, "gps_time"])


def laz_first_colours(spark, sf_dir):
    """First codec version with colours and extra bytes."""
    path = _write(_extra(_fields(spark, sf_dir)), pointFormat="3", itemVersion="1", extraBytes="3")
    return read_las(spark, path, ["point_index", "X", *_RGB, "extra_bytes"]).withColumn("extra_bytes", F.hex("extra_bytes"))


def laz_extra(spark, sf_dir):
    """Extra bytes in a layer each."""
    path = _write(_extra(_wide(spark, sf_dir)), pointFormat="6", extraBytes="3")
    return read_las(spark, path, ["point_index", "Z", "extra_bytes"]).withColumn("extra_bytes", F.hex("extra_bytes"))


def laz_colour_wide(spark, sf_dir):
    """Layered colours of format 7."""
    return read_las(spark, _write(_wide(spark, sf_dir), pointFormat="7"), [*_NEW, *_RGB])


def _packets(points: DataFrame) -> DataFrame:
    got = points.withColumn("w", fields.wave_packet(F.col("wave_packet")))
    return got.select("point_index", "w.descriptor", F.col("w.offset").cast("long").alias("offset"), "w.size", *[F.col(f"w.{c}").cast("double").alias(c) for c in ("return_point", "dx", "dy", "dz")])


def laz_waves(spark, sf_dir):
    """Wave packets of format 4, unpacked."""
    return _packets(read_las(spark, _write(_waves(_fields(spark, sf_dir)), pointFormat="4"), ["point_index", "wave_packet"]))


def laz_waves_wide(spark, sf_dir):
    """Wave packets in a layer, format 10, unpacked."""
    return _packets(read_las(spark, _write(_waves(_wide(spark, sf_dir)), pointFormat="10"), ["point_index", "wave_packet"]))


def laz_lost_table(spark, sf_dir):
    """A file whose chunk table was never written: points come in order, with a warning."""
    path = _chunked(_fields(spark, sf_dir), 500, pointFormat="1")
    with open(f"{path}/points.laz", "r+b") as f:
        f.seek(96)
        start = struct.unpack("<I", f.read(4))[0]
        f.seek(start)
        end = struct.unpack("<q", f.read(8))[0]
        f.seek(start)
        f.write(struct.pack("<q", start))
        f.truncate(end)
    warned = read_headers(spark, path).select("file", F.size("warnings").alias("warnings"))
    return read_las(spark, path, ["file", "point_index", "X", "gps_time"], chunkTables=find_chunks(spark, path)).join(F.broadcast(warned), "file").drop("file")


def laz_index_inside(spark, sf_dir):
    """A rectangle through an index inside the file."""
    path = _whole(_fields(spark, sf_dir), pointFormat="1", chunkSize="1000")
    index = runindex.build(read_las(spark, path, ["point_index", "x", "y"], scaled=True), cell_size=4.0, minimum_points=50)
    append_index(f"{path}/points.laz", index.serialize())
    return read_las(spark, path, ["point_index", "x", "y"], scaled=True, rect=RECT)


def laz_index_written(spark, sf_dir):
    """The same through an index that Spark wrote beside the file; of files whose header says they lie elsewhere nothing is read."""
    path = _write(_fields(spark, sf_dir), pointFormat="1")
    write_index(spark, path, cell_size=4.0, minimum_points=50)
    return read_las(spark, path, ["point_index", "x", "y"], scaled=True, rect=RECT, trustBounds=True)


_EVLRS = [("someone", 1, b"x" * 70_000, "long"), ("someone", 2, b"", "empty"), ("far", 3, bytes(range(256)) * 5000, "left in the file")]
_VLRS = [("me", 7, b"data", "about")]


def _json(records) -> str:
    return json.dumps([{"user_id": u, "record_id": n, "data": base64.b64encode(d).decode(), "description": a} for u, n, d, a in records])


def extended_records(spark, sf_dir):
    """Records before and behind the points, with what they hold."""
    path = _write(_wide(spark, sf_dir), pointFormat="6", vlrs=_json(_VLRS), evlrs=_json(_EVLRS))
    own = metadata_records(spark, path).where(~F.col("user_id").startswith("laszip"))
    return own.select("extended", "user_id", "record_id", "description", "size", F.md5("data").alias("md5"))


def copied_file(spark, sf_dir):
    """A compressed copy of an uncompressed file: what its header says and what its points add up to."""
    attrs = M.extra_bytes_record([M.Attribute("height", 3, scale=(0.01,)), M.Attribute("mark", 1)])
    path = _write(
        _extra(_fields(spark, sf_dir)), pointFormat="3", compressed="false", scales="0.001,0.002,0.5", offsets="10,20,-5", crs="25832", systemIdentifier="scanner", creation="12,2024",
        vlrs=_json([*_VLRS, (attrs.user_id, attrs.record_id, attrs.data, "")]),
    )
    copy = _folder(spark)
    copy_las(read_las(spark, path).repartition(1).sortWithinPartitions("point_index"), f"{path}/points.las", copy, compressed=True, single=True)
    h = read_headers(spark, copy).select("points", "point_format", "x_scale", "y_scale", "z_scale", "x_offset", "y_offset", "z_offset", "epsg", "extra_bytes", F.array_contains("records", "me/7").alias("kept"), F.col("compressor").alias("container"))
    sums = read_las(spark, copy).agg(*[F.sum(F.col(c).cast("long")).alias(f"sum_{c.lower()}") for c in ("X", "Y", "Z", "intensity", "red")], F.countDistinct("extra_bytes").alias("extras"))
    # one file, so one row each
    return h.withColumn("one", F.lit(1)).join(sums.withColumn("one", F.lit(1)), "one").drop("one")


def chunk_positions(spark, sf_dir):
    """Chunks of an adaptive file: where each starts and how many points it holds."""
    path = _whole(_fields(spark, sf_dir).withColumn("strip", F.floor(F.col("point_index") / 700)), pointFormat="1", chunkSize="0", chunkBy="strip")
    return chunk_table(spark, path).select("chunk", "first_index", "points", (F.col("byte_size") > 0).alias("has_bytes"))


def binary_scan(spark, sf_dir):
    """Files that only Spark can read: taken as bytes and decoded."""
    path = _write(_fields(spark, sf_dir), pointFormat="1")
    schema = read_las(spark, path, ["point_index", "X", "intensity"]).schema
    return decode_binary(spark.read.format("binaryFile").load(f"{path}/*.laz"), schema)


def file_report(spark, sf_dir):
    """The first points of the report on a file."""
    path = _write(_fields(spark, sf_dir), pointFormat="1")
    lines = [x.split(": ", 1) for x in report(f"{path}/points.laz", 20).split("\n")]
    rows = [(int(k), v.split(" {")[0]) for k, v in lines if k.isdigit()]
    count = next(int(v) for k, v in lines if k == "points")
    return spark.createDataFrame([(k, at, count) for k, at in rows], "point_index long, position string, points long")


def described_extra(spark, sf_dir):
    """Extra bytes as the attributes a record describes."""
    attrs = M.attributes(M.extra_bytes_record([M.Attribute("mark", 1), M.Attribute("height", 4, scale=(0.25,), offset=(5.0,))]).data)
    raw = _extra(cloud(spark, sf_dir).select("point_index"))
    return M.decode_extra(raw, attrs).select("point_index", F.col("mark").cast("int").alias("mark"), "height")


def coordinate_systems(spark, sf_dir):
    """What is read back of coordinate systems written into a header."""
    rows = []
    for given in ("25832", "4326", "PROJCS[x]"):
        path = _whole(_fields(spark, sf_dir).where("point_index = 1"), pointFormat="1", crs=given)
        s = read_headers(spark, path).select("epsg", "wkt").first()
        rows.append((given, s.epsg, s.wkt))
    damaged = M.read_crs([H.Vlr(*H.GEOKEYS, b"\1\0\1\0")])
    return spark.createDataFrame([*rows, ("damaged", *damaged)], "given string, epsg int, wkt string")


def auto_offsets(spark, sf_dir):
    """Offsets near the middle of each file of las_points, multiples of ten million raw units of 0.0001."""
    b = table(spark, sf_dir, "las_points").where("X is not null").groupBy("file_id").agg(F.min("X").alias("low"), F.max("X").alias("high"))
    return b.select("file_id", coords.auto_offset_column(F.col("low"), F.col("high"), 0.0001).alias("offset"))


def padded_text(spark, sf_dir):
    """Text fields of fixed size: padded, cut back, refused if too long."""
    users = [r.user_id for r in table(spark, sf_dir, "las_vlrs").where("user_id is not null").select("user_id").distinct().orderBy("user_id").collect()]
    rows = []
    for u in users:
        try:
            rows.append((u, H.text(H.padded(u, 10)), len(H.padded(u, 10))))
        except ValueError:
            rows.append((u, None, None))
    return spark.createDataFrame(rows, "user_id string, back string, size int")


def index_facts(spark, sf_dir):
    """What index bytes say of themselves: levels, cells, runs; a cell listed twice counts once and is warned of."""
    xy = cloud(spark, sf_dir).select("point_index", coords.scale(F.col("X"), 0.01).alias("x"), coords.scale(F.col("Y"), 0.01).alias("y"))
    data = bytearray(runindex.build(xy, cell_size=4.0, minimum_points=1, maximum_intervals=-1).serialize())
    # the first cell once more, at the end
    at = data.index(b"LASV") + 8
    cells = struct.unpack_from("<I", data, at)[0]
    struct.pack_into("<I", data, at, cells + 1)
    again = bytes(data[at + 4 : at + 4 + 12 + 8])
    f = runindex.from_bytes(spark, bytes(data) + again).facts()
    return f.select("cells", "runs", "points", (F.col("warnings") != "").alias("warned"))


def argument_rules(spark, sf_dir):
    """Which arguments are refused, and with what kind of error."""
    cases = {
        "two areas": lambda: regions.area((0, 0, 1, 1), (0, 0, 1)), "no area": lambda: regions.area(None, None), "short rectangle": lambda: regions.area((0, 0, 1), None),
        "negative radius": lambda: regions.area(None, (0, 0, -1)), "negative slice": lambda: regions.points_slice(cloud(spark, sf_dir), -1, 5),
        "wide format in an old version": lambda: Layout(6, version_minor=3), "unknown codec": lambda: Layout(0, item_version=3), "layers for an old format": lambda: Layout(1, compressor=3),
        "scale of zero": lambda: Layout(1, scales=(0, 1, 1)), "unknown attribute type": lambda: M.width_of(31), "not an EPSG code": lambda: M.crs_record(5),
        "no index": lambda: runindex.parse(b"nothing"), "cell size of zero": lambda: runindex.Tree.over(0, 1, 0, 1, 0), "long text": lambda: H.padded("x" * 33, 32),
    }
    kinds = (UnsupportedFormat, LasDataError, runindex.IndexDataError, IndexError, TypeError, ValueError)
    rows = []
    for name, call in cases.items():
        try:
            call()
            rows.append((name, "taken"))
        except kinds as e:
            rows.append((name, next(k.__name__ for k in kinds if isinstance(e, k))))
    return spark.createDataFrame(rows, "name string, outcome string")


QUERIES = {
    f.__name__: f
    for f in (
        las_wide_scan, laz_pointwise, laz_first_colours, laz_extra, laz_colour_wide, laz_waves, laz_waves_wide, laz_lost_table, laz_index_inside, laz_index_written,
        extended_records, copied_file, chunk_positions, binary_scan, file_report, described_extra, coordinate_systems, auto_offsets, padded_text, index_facts, argument_rules,
    )
}

_EXTRA = "upper(lpad(to_hex((point_index * 7) % 16777216), 6, '0')) AS extra_bytes"
_WAVES = """ SELECT point_index, CAST(point_index % 5 + 1 AS INT) AS descriptor, point_index * 128 AS "offset", point_index % 97 AS size,
  1.0::DOUBLE AS return_point, 2.0::DOUBLE AS dx, 0.5::DOUBLE AS dy, -1.0::DOUBLE AS dz FROM pc"""
_WIDE_RETURNS = ", ".join(f'{c} AS "{c}"' for c in _NEW if c not in ("extended_return_number", "extended_number_of_returns"))


def _listed(records, extended: bool) -> str:
    import hashlib

    return ", ".join(f"({str(extended).lower()}, '{u}', {n}, '{a}', {len(d)}::BIGINT, '{hashlib.md5(d).hexdigest()}')" for u, n, d, a in records)


SQL = {
    "las_wide_scan": _F
    + f""", w AS (SELECT *, CAST(point_index % 11 + 1 AS SMALLINT) AS r, CAST(point_index % 15 + 1 AS SMALLINT) AS n FROM f)
SELECT {_WIDE_RETURNS}, r AS extended_return_number, n AS extended_number_of_returns,
  CAST(CASE WHEN n > 7 AND r > 6 THEN CASE WHEN r >= n THEN 7 ELSE 6 END ELSE r END AS SMALLINT) AS return_number, CAST(least(n, 7) AS SMALLINT) AS number_of_returns FROM w""",
    "laz_pointwise": _F + f" SELECT {_names([*_OLD, 'gps_time'])} FROM f",
    "laz_first_colours": _F + f" SELECT point_index, X, red, green, blue, {_EXTRA} FROM f",
    "laz_extra": _F + f" SELECT point_index, Z, {_EXTRA} FROM f",
    "laz_colour_wide": _F + f" SELECT {_names([*_NEW, *_RGB])} FROM f",
    "laz_waves": _PC + _WAVES,
    "laz_waves_wide": _PC + _WAVES,
    "laz_lost_table": _PC + " SELECT point_index, X, gps_time, CAST(1 AS INT) AS warnings FROM pc",
    "laz_index_inside": _PC + f" SELECT point_index, x, y FROM xy WHERE {_RECT_SQL}",
    "laz_index_written": _PC + f" SELECT point_index, x, y FROM xy WHERE {_RECT_SQL}",
    "extended_records": f"SELECT * FROM (VALUES {_listed(_VLRS, False)}, {_listed(_EVLRS, True)}) t(extended, user_id, record_id, description, size, md5)",
    "copied_file": _F
    + """ SELECT count(*) AS points, CAST(3 AS INT) AS point_format, 0.001::DOUBLE AS x_scale, 0.002::DOUBLE AS y_scale, 0.5::DOUBLE AS z_scale, 10.0::DOUBLE AS x_offset, 20.0::DOUBLE AS y_offset, -5.0::DOUBLE AS z_offset,
  CAST(25832 AS INT) AS epsg, CAST(3 AS INT) AS extra_bytes, true AS kept, CAST(2 AS INT) AS container, CAST(sum(X) AS BIGINT) AS sum_x, CAST(sum(Y) AS BIGINT) AS sum_y, CAST(sum(Z) AS BIGINT) AS sum_z,
  CAST(sum(intensity) AS BIGINT) AS sum_intensity, CAST(sum(red) AS BIGINT) AS sum_red, count(DISTINCT (point_index * 7) % 16777216) AS extras FROM f""",
    "chunk_positions": _PC + " SELECT CAST(point_index // 700 - (SELECT min(point_index // 700) FROM pc) AS INT) AS chunk, CAST(min(point_index) - (SELECT min(point_index) FROM pc) AS BIGINT) AS first_index, count(*) AS points, true AS has_bytes FROM pc GROUP BY point_index // 700",
    "binary_scan": _PC + " SELECT point_index, X, intensity FROM pc",
    "file_report": _PC
    + """, p AS (SELECT point_index, printf('%.6g %.6g %.6g', X * 0.01::DOUBLE, Y * 0.01::DOUBLE, Z * 0.01::DOUBLE) AS position FROM pc ORDER BY point_index LIMIT 20)
SELECT point_index, position, (SELECT count(*) FROM pc) AS points FROM p""",
    "described_extra": _PC
    + """, b AS (SELECT point_index, (point_index * 7) % 16777216 AS v FROM pc), s AS (SELECT point_index, v // 65536 AS mark, (v // 256) % 256 + 256 * (v % 256) AS u FROM b)
SELECT point_index, CAST(mark AS INT) AS mark, (CASE WHEN u >= 32768 THEN u - 65536 ELSE u END) * 0.25::DOUBLE + 5.0::DOUBLE AS height FROM s""",
    "coordinate_systems": "SELECT * FROM (VALUES ('25832', 25832, NULL), ('4326', 4326, NULL), ('PROJCS[x]', NULL, 'PROJCS[x]'), ('damaged', NULL, NULL)) t(given, epsg, wkt)",
    "auto_offsets": "SELECT file_id, floor((min(X)::DOUBLE + max(X)::DOUBLE) / 2 / 0.0001::DOUBLE / 1e7::DOUBLE) * 1e7::DOUBLE * 0.0001::DOUBLE AS \"offset\" FROM las_points WHERE X IS NOT NULL GROUP BY file_id",
    "padded_text": "SELECT DISTINCT user_id, CASE WHEN length(user_id) <= 10 THEN user_id END AS back, CASE WHEN length(user_id) <= 10 THEN CAST(10 AS INT) END AS size FROM las_vlrs WHERE user_id IS NOT NULL",
    "index_facts": _PC + ", c AS (SELECT DISTINCT floor(x / 4) AS a, floor(y / 4) AS b FROM xy) SELECT count(*) AS cells, count(*) AS runs, (SELECT count(*) FROM pc) AS points, true AS warned FROM c",
    "argument_rules": """SELECT * FROM (VALUES ('two areas', 'TypeError'), ('no area', 'TypeError'), ('short rectangle', 'TypeError'), ('negative radius', 'ValueError'), ('negative slice', 'IndexError'),
  ('wide format in an old version', 'ValueError'), ('unknown codec', 'ValueError'), ('layers for an old format', 'ValueError'), ('scale of zero', 'ValueError'), ('unknown attribute type', 'UnsupportedFormat'),
  ('not an EPSG code', 'ValueError'), ('no index', 'IndexDataError'), ('cell size of zero', 'ValueError'), ('long text', 'ValueError')) t(name, outcome)""",
}
