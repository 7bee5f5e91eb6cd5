"""Queries of the point-cloud operators, over a cloud derived from the events table and over las_points, with their SQL.

``events`` is read as a cloud of one file: its dense ids are the ordinals, coordinates are derived by integer arithmetic that
any engine repeats exactly. Scale and offset of that cloud are 0.01 and 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.functions import bits, coords, fields
from cloudloom.operators import folds, proximity, regions, runindex
from cloudloom.runtime import table

SCALE, OFFSET = 0.01, 0.0
RECT = (20.0, 30.0, 80.0, 120.0)
SMALL_RECT = (50.0, 50.0, 60.0, 60.0)
CIRCLE = (100.0, 100.0, 40.0)
CHUNK = 500
#: Cell size and thresholds of the index queries, small enough for the index to have work on small tables.
INDEX = {"cell_size": 4.0, "minimum_points": 50, "maximum_intervals": -20}
RUN_GAP = 1000


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    turn = i % 7 + 1
    raw = table(spark, sf_dir, "events").select(
        i.alias("point_index"),
        ((i * 37 + u * 7919) % 20011).cast("int").alias("X"),
        ((i * 91 + u * 104729) % 20011).cast("int").alias("Y"),
        ((i * 31 + u * 17) % 1009).cast("int").alias("Z"),
        ((i * 13) % 65536).cast("int").alias("intensity"),
        (turn + turn * 8 + (i % 2) * 64 + (F.floor(i / 2) % 2) * 128).cast("int").alias("returns_and_flags"),
        (u % 256).cast("int").alias("classification_byte"),
        F.col("value").alias("gps_time"),
    )
    return raw


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pc = cloud(spark, sf_dir)
    return pc.select(
        "*", *[coords.scale(F.col(a), SCALE, OFFSET).alias(f"s{a.lower()}") for a in ("X", "Y", "Z")]
    )


def _xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).select("point_index", coords.scale(F.col("X"), SCALE, OFFSET).alias("x"), coords.scale(F.col("Y"), SCALE, OFFSET).alias("y"))


# scans, projections, scalar functions


def project_columns(spark, sf_dir):
    return cloud(spark, sf_dir).select("point_index", "X", "intensity", "gps_time")


def scaled_xyz(spark, sf_dir):
    return scaled(spark, sf_dir).select("point_index", "sx", "sy", "sz")


def unscale_roundtrip(spark, sf_dir):
    q = coords.quantize(F.col("gps_time"), 0.5, 100.0)
    return cloud(spark, sf_dir).select("point_index", q.alias("q"), coords.scale(q, 0.5, 100.0).alias("back"))


def unpack_fields(spark, sf_dir):
    names = [f for f, (b, _, _) in bits.PACKED.items() if b in ("returns_and_flags", "classification_byte")]
    return cloud(spark, sf_dir).select("point_index", *[bits.unpack(F.col(bits.PACKED[f][0]), f).alias(f) for f in names])


def pack_flags(spark, sf_dir):
    up = unpack_fields(spark, sf_dir)
    by = {b: {f: F.col(f) for f, (o, _, _) in bits.PACKED.items() if o == b} for b in ("returns_and_flags", "classification_byte")}
    return up.select("point_index", *[bits.pack(fields).alias(b) for b, fields in by.items()])


def legacy_returns(spark, sf_dir):
    n, r = (F.col("point_index") % 15 + 1).cast("int"), (F.col("point_index") % 11 + 1).cast("int")
    number, count = bits.legacy_returns(r, n)
    return cloud(spark, sf_dir).select("point_index", number.alias("return_number"), count.alias("number_of_returns"))


def scan_rank(spark, sf_dir):
    angle = (F.col("point_index") % 60001 - 30000).cast("int")
    return cloud(spark, sf_dir).select("point_index", bits.scan_rank(angle).alias("rank"), bits.scan_angle((F.col("point_index") % 256 - 128).cast("int")).alias("angle"))


def class_bytes(spark, sf_dir):
    cls, flags = (F.col("point_index") % 256).cast("int"), (F.col("point_index") % 16).cast("int")
    return cloud(spark, sf_dir).select(
        "point_index", bits.legacy_class_byte(flags, cls).alias("legacy_byte"), bits.wide_class(cls % 32, cls).alias("wide"), bits.fold_u8(F.col("X") - 5000).cast("int").alias("folded")
    )


def colour_struct(spark, sf_dir):
    """Four colour channels of las_points as one value; a missing one counts as 0."""
    pts = table(spark, sf_dir, "las_points").where("red is not null")
    return pts.select("file_id", "point_index", fields.colours(pts).alias("rgb")).select("file_id", "point_index", "rgb.red", "rgb.green", "rgb.blue", "rgb.nir").distinct()


# predicates


def within_rect(spark, sf_dir):
    return regions.within(_xy(spark, sf_dir), rect=RECT)


def within_circle(spark, sf_dir):
    return regions.within(_xy(spark, sf_dir), circle=CIRCLE)


def adjoining_rects(spark, sf_dir):
    """Half-open rectangles split the points: counts of four that tile a square."""
    xy = _xy(spark, sf_dir)
    tiles = [(a, b, a + 50.0, b + 50.0) for a in (0.0, 50.0) for b in (0.0, 50.0)]
    which = F.coalesce(*[F.when(regions.in_rect(F.col("x"), F.col("y"), *t), F.lit(k)) for k, t in enumerate(tiles)])
    return xy.withColumn("tile", which).where("tile is not null").groupBy("tile").agg(F.count(F.lit(1)).alias("n"))


def classification_thin(spark, sf_dir):
    pts = table(spark, sf_dir, "las_points").where(F.col("classification") == 2)
    return pts.select("file_id", "point_index", "X", "Y", "Z").distinct()


def field_ranges(spark, sf_dir):
    """Points of las_points whose fields are out of the ranges a record can hold."""
    bad = [F.coalesce(~fields.holds(f), F.lit(False)) for f in ("intensity", "classification", "user_data", "return_number", "red", "point_source_ID")]
    return table(spark, sf_dir, "las_points").where(reduce(Column.__or__, bad)).select("point_id", "intensity", "classification").distinct()


def checked_fields(spark, sf_dir):
    """The other points, through the check that raises for a field that doesn't fit; per classification."""
    good = [F.coalesce(fields.holds(f), F.lit(True)) for f in ("intensity", "classification")]
    kept = table(spark, sf_dir, "las_points").where(reduce(Column.__and__, good)).select("point_id", "intensity", "classification").distinct()
    return fields.require_ranges(kept).groupBy("classification").agg(F.count("point_id").alias("n"), F.max("intensity").alias("most"))


def scaled_rect(spark, sf_dir):
    """A rectangle over las_points: raw bounds reach the scan, the exact scaled test follows."""
    r = (-20000.0, -10000.0, 60000.0, 10000.0)
    lo_x, hi_x = coords.raw_bounds(r[0], r[2], SCALE, OFFSET)
    lo_y, hi_y = coords.raw_bounds(r[1], r[3], SCALE, OFFSET)
    pts = table(spark, sf_dir, "las_points").where(F.col("X").between(lo_x, hi_x) & F.col("Y").between(lo_y, hi_y))
    xy = pts.select("point_id", coords.scale(F.col("X"), SCALE, OFFSET).alias("x"), coords.scale(F.col("Y"), SCALE, OFFSET).alias("y"))
    return regions.within(xy, rect=r).distinct()


# slices


def points_slice(spark, sf_dir):
    return regions.points_slice(cloud(spark, sf_dir), 100, 250).select("point_index", "X", "Y", "Z")


def seek_point(spark, sf_dir):
    return regions.seek(cloud(spark, sf_dir), 777).select("point_index", "X", "Y", "Z")


def preview(spark, sf_dir):
    return regions.preview(cloud(spark, sf_dir), 10).select("point_index", "X", "Y", "Z", "intensity")


def chunk_of_point(spark, sf_dir):
    return cloud(spark, sf_dir).select("point_index", regions.chunk_of(F.col("point_index"), CHUNK).alias("chunk_index"))


def adaptive_chunks(spark, sf_dir):
    """The chunk of every point of compressed files, from the chunk table."""
    pts = table(spark, sf_dir, "las_points").select("file_id", "point_index").distinct()
    return regions.with_chunk(pts, table(spark, sf_dir, "las_chunks").distinct(), ["file_id"]).select("file_id", "point_index", "chunk_index")


def chunk_starts(spark, sf_dir):
    """Ordinal at which each chunk starts, from the counts before it."""
    w = Window.partitionBy("file_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    ch = table(spark, sf_dir, "las_chunks").select("file_id", "chunk_index", "point_count", "byte_offset").distinct()
    return ch.select("file_id", "chunk_index", F.coalesce(F.sum("point_count").over(w), F.lit(0)).alias("first_index"), "byte_offset")


# folds


def count_points(spark, sf_dir):
    return cloud(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


def bounds(spark, sf_dir):
    return folds.bounds(cloud(spark, sf_dir))


def bounds_scaled(spark, sf_dir):
    b = folds.bounds(cloud(spark, sf_dir), ("X", "Y", "Z"))
    return b.select(*[coords.scale(F.col(c), SCALE, OFFSET).alias(c.lower()) for c in b.columns])


def header_stats(spark, sf_dir):
    s = scaled(spark, sf_dir).select(bits.unpack(F.col("returns_and_flags"), "return_number").alias("return_number"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"))
    return folds.header_stats(s)


def by_return(spark, sf_dir):
    return folds.by_return(cloud(spark, sf_dir).withColumn("rn", bits.unpack(F.col("returns_and_flags"), "return_number")), "rn")


def dsm_max(spark, sf_dir):
    return folds.raster(cloud(spark, sf_dir), F.col("X"), F.col("Y"), F.col("Z"), 0.0, 20010.0, 500.0)


def dsm_dense(spark, sf_dir):
    sparse = folds.raster(cloud(spark, sf_dir), F.col("X"), F.col("Y"), F.col("Z"), 0.0, 20010.0, 100.0)
    return folds.dense_raster(sparse, 201, 201)


def checksum(spark, sf_dir):
    old = {f: bits.unpack(F.col(b), f) for f, (b, _, _) in bits.PACKED.items() if b in ("returns_and_flags", "classification_byte")}
    up = cloud(spark, sf_dir).withColumns(old | {"file": F.lit("events")})
    return folds.checksum(up.drop("returns_and_flags", "classification_byte"))


def selection_checksum(spark, sf_dir):
    """Ordered checksum of the ordinals a rectangle selects."""
    return folds.index_checksum(within_rect(spark, sf_dir).withColumn("file", F.lit("events")))


def file_summary(spark, sf_dir):
    """Header facts beside what the points say, per file."""
    h = table(spark, sf_dir, "las_headers").drop("received_at").distinct().select(
        "file_id", "version_minor", "point_data_format_id", "point_data_record_length", "number_of_point_records", "x_scale_factor"
    )
    p = table(spark, sf_dir, "las_points").groupBy("point_id", "file_id").agg(F.min("X").alias("X"), F.min("Y").alias("Y"))
    p = p.groupBy("file_id").agg(F.count(F.lit(1)).alias("points"), *[f(a).alias(f"{n}_{a}") for a in ("X", "Y") for n, f in (("min", F.min), ("max", F.max))])
    return h.join(p, "file_id", "left").select(
        "file_id", "version_minor", "point_data_format_id", "point_data_record_length", "number_of_point_records", "points",
        *[(F.col(c) * F.col("x_scale_factor")).alias(f"points_{c.lower()}") for c in ("min_X", "max_X", "min_Y", "max_Y")],
    )


def item_users(spark, sf_dir):
    """Sorted set of the writers of metadata records per file."""
    return table(spark, sf_dir, "las_vlrs").groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_set("user_id")), ",").alias("users"), F.count_distinct("vlr_index").alias("records"))


# index


def _leafed(spark, sf_dir) -> DataFrame:
    """Cells of 512 raw units, numbered row by row: simple cells that SQL can repeat."""
    return cloud(spark, sf_dir).withColumn("cell", (F.shiftright("Y", 9) * 64 + F.shiftright("X", 9)).cast("long"))


def cell_counts(spark, sf_dir):
    return runindex.cell_counts(_leafed(spark, sf_dir))


def cell_runs(spark, sf_dir):
    r = runindex.cell_runs(_leafed(spark, sf_dir), gap=RUN_GAP)
    return r.select("cell", "run_start", "run_end", F.col("n").alias("points"))


def coalesced_runs(spark, sf_dir):
    r = runindex.cell_runs(_leafed(spark, sf_dir), gap=3)
    return runindex.merge_runs(r, [], 0).select("run_start", "run_end")


def coarsened(spark, sf_dir):
    """Cells of a tree of four levels after joining present siblings that hold fewer than 600 points together."""
    leaf = F.lit(runindex.level_offset(4)) + sum(
        F.shiftleft(F.shiftright(c, 11 + k).bitwiseAND(F.lit(1)), 2 * k + s) for k in range(4) for c, s in (("X", 0), ("Y", 1))
    )
    counts = runindex.cell_counts(cloud(spark, sf_dir).select(leaf.cast("long").alias("cell")))
    return runindex.coarsen(counts, 4, 600).select("cell", "full").distinct()


def limit_runs(spark, sf_dir):
    """At most two runs a cell on average: the smallest gaps are closed first."""
    r = runindex.cell_runs(_leafed(spark, sf_dir), gap=RUN_GAP)
    return runindex.limit_runs(r, -2).select("cell", "run_start", "run_end")


def covered_points(spark, sf_dir):
    r = runindex.cell_runs(_leafed(spark, sf_dir), gap=RUN_GAP)
    return r.groupBy("cell").agg(F.sum(F.col("run_end") - F.col("run_start") + 1).alias("covered"), F.sum("n").alias("points"))


def indexed_rect(spark, sf_dir):
    xy = _xy(spark, sf_dir)
    return runindex.build(xy, **INDEX).within(xy, rect=RECT)


def indexed_circle(spark, sf_dir):
    xy = _xy(spark, sf_dir)
    return runindex.build(xy, **INDEX).within(xy, circle=CIRCLE)


def index_candidates(spark, sf_dir):
    """Candidate runs of a small rectangle."""
    return runindex.build(_xy(spark, sf_dir), **INDEX).candidates(rect=SMALL_RECT)


def index_cells(spark, sf_dir):
    """The index itself: cells, their points and runs."""
    return runindex.build(_xy(spark, sf_dir), **INDEX).runs


# extensions: what the plain engine leaves to its callers


def zone_counts(spark, sf_dir):
    """Points of las_points per zone: a spatial join with half-open rectangles and open circles."""
    inside = proximity.zones_by_tile(table(spark, sf_dir, "las_points"), table(spark, sf_dir, "zones"))
    return inside.groupBy(F.col("left_id").alias("zone_id")).agg(F.count(F.lit(1)).alias("n"))


def top_sources(spark, sf_dir):
    """The ten sources with most points."""
    n = table(spark, sf_dir, "las_points").where("point_source_ID is not null").groupBy("point_source_ID").agg(F.count_distinct("point_id").alias("n"))
    return n.orderBy(F.desc("n"), "point_source_ID").limit(10)


def return_cube(spark, sf_dir):
    pts = table(spark, sf_dir, "las_points").select("point_id", "classification", "return_number").distinct()
    c = pts.cube("classification", "return_number").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return c.select("classification", "return_number", "n", F.col("g").cast("long").alias("g"))


def asof_header(spark, sf_dir):
    """For each dump the last header of its file received before it: an as-of join. A file's headers are few, so an equi-join with a maximum does it."""
    d = table(spark, sf_dir, "header_dumps").groupBy("dump_id", "file_id").agg(F.min("received_at").alias("at"))
    h = table(spark, sf_dir, "las_headers").select(F.col("file_id").alias("f"), F.col("received_at").alias("header_at")).distinct()
    before = d.join(h, (F.col("file_id") == F.col("f")) & (F.col("header_at") <= F.col("at")), "left")
    return before.groupBy("dump_id").agg(F.unix_micros(F.max("header_at")).alias("header_us"))


def gps_steps(spark, sf_dir):
    """Distinct steps of gps_time from one point of a file to the next."""
    pts = table(spark, sf_dir, "las_points").select("file_id", "point_index", "gps_time").distinct()
    return folds.steps(pts, "file_id", "gps_time")


QUERIES = {
    f.__name__: f
    for f in (
        project_columns, scaled_xyz, unscale_roundtrip, unpack_fields, pack_flags, legacy_returns, scan_rank, class_bytes, colour_struct,
        within_rect, within_circle, adjoining_rects, classification_thin, field_ranges, checked_fields, scaled_rect,
        points_slice, seek_point, preview, chunk_of_point, adaptive_chunks, chunk_starts,
        count_points, bounds, bounds_scaled, header_stats, by_return, dsm_max, dsm_dense, checksum, selection_checksum, file_summary, item_users,
        cell_counts, cell_runs, coalesced_runs, coarsened, limit_runs, covered_points, indexed_rect, indexed_circle, index_candidates, index_cells,
        zone_counts, top_sources, return_cube, asof_header, gps_steps,
    )
}

_PC = """WITH pc AS (SELECT event_id AS point_index,
  CAST((event_id*37 + user_id*7919) % 20011 AS INT) AS X, CAST((event_id*91 + user_id*104729) % 20011 AS INT) AS Y,
  CAST((event_id*31 + user_id*17) % 1009 AS INT) AS Z, CAST((event_id*13) % 65536 AS INT) AS intensity,
  CAST((event_id % 7) + 1 + ((event_id % 7) + 1)*8 + (event_id % 2)*64 + ((event_id // 2) % 2)*128 AS INT) AS returns_and_flags,
  CAST(user_id % 256 AS INT) AS classification_byte, value AS gps_time FROM events),
xy AS (SELECT point_index, X * 0.01::DOUBLE + 0.0::DOUBLE AS x, Y * 0.01::DOUBLE + 0.0::DOUBLE AS y FROM pc),
leafed AS (SELECT *, CAST((Y >> 9) * 64 + (X >> 9) AS BIGINT) AS cell FROM pc)"""


def _unpacked(field: str) -> str:
    byte, shift, mask = bits.PACKED[field]
    return f"CAST(({byte} >> {shift}) & {mask} AS SMALLINT) AS {field}"


_FIELDS = [f for f, (b, _, _) in bits.PACKED.items() if b in ("returns_and_flags", "classification_byte")]
_RECT_SQL = f"x >= {RECT[0]}::DOUBLE AND x < {RECT[2]}::DOUBLE AND y >= {RECT[1]}::DOUBLE AND y < {RECT[3]}::DOUBLE"
_CIRCLE_SQL = f"(x - {CIRCLE[0]}::DOUBLE) * (x - {CIRCLE[0]}::DOUBLE) + (y - {CIRCLE[1]}::DOUBLE) * (y - {CIRCLE[1]}::DOUBLE) < {CIRCLE[2] ** 2}::DOUBLE"


def _away(v: str) -> str:
    return f"trunc(CASE WHEN {v} >= 0 THEN {v} + 0.5::DOUBLE ELSE {v} - 0.5::DOUBLE END)"


_RUNS = f""", lagged AS (SELECT cell, point_index, point_index - lag(point_index) OVER (PARTITION BY cell ORDER BY point_index) AS step FROM leafed),
isl AS (SELECT *, sum(CASE WHEN step <= {RUN_GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY point_index) AS island FROM lagged),
runs AS (SELECT cell, island, min(point_index) AS run_start, max(point_index) AS run_end, count(*) AS points FROM isl GROUP BY cell, island)"""

def low_first(v: str, size: int) -> str:
    """The bytes of a whole number, lowest first, as a list."""
    return "[" + ", ".join(f"CAST((({v})::BIGINT >> {8 * k}) & 255 AS INT)" for k in range(size)) + "]"


def double_bytes(v: str) -> str:
    bits_ = f"CAST({v} AS DOUBLE)::BIT::VARCHAR"
    return "[" + ", ".join(f"CAST(substr({bits_}, {57 - 8 * k}, 8)::BIT::BIGINT & 255 AS INT)" for k in range(8)) + "]"


def fnv_sql(bytes_: str) -> str:
    """The 64-bit checksum (hex) of a list of bytes: multiply by the prime after each exclusive or."""
    step = "((xor((h % 18446744073709551616::UHUGEINT)::UBIGINT, b::UBIGINT))::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT"
    return f"lower(lpad(to_hex((list_reduce({bytes_}, lambda h, b: {step}, 14695981039346656037::UHUGEINT))::UBIGINT), 16, '0'))"


def zeros(n: int) -> str:
    return f"list_transform(range({n}), lambda x: 0::INT)"


_RECORD = " || ".join(
    [low_first(c, 4) for c in ("X", "Y", "Z")]
    + [low_first("intensity", 2), low_first("returns_and_flags", 1), low_first("classification_byte", 1), zeros(4), double_bytes("gps_time"), zeros(42)]
)
# cells of 4 units, exact in single precision: a tree over whole cells, widened to a power of two, the larger half of the excess below
_TREE = _PC + """, b AS (SELECT CAST(floor(min(x) / 4) AS BIGINT) AS ax, CAST(floor(max(x) / 4) + 1 AS BIGINT) AS bx, CAST(floor(min(y) / 4) AS BIGINT) AS ay, CAST(floor(max(y) / 4) + 1 AS BIGINT) AS by_ FROM xy),
w AS (SELECT *, CAST(ceil(log2(greatest(bx - ax, by_ - ay))) AS INT) AS levels FROM b),
t AS (SELECT levels, ax - ((1 << levels) - (bx - ax) - ((1 << levels) - (bx - ax)) // 2) AS ox, ay - ((1 << levels) - (by_ - ay) - ((1 << levels) - (by_ - ay)) // 2) AS oy FROM w),
g AS (SELECT point_index, CAST(floor(x / 4) - ox AS BIGINT) AS gx, CAST(floor(y / 4) - oy AS BIGINT) AS gy, levels FROM xy, t),
l AS (SELECT point_index, levels, CAST(list_sum(list_transform(range(15), lambda k: (((gx >> k) & 1) << (2 * k)) + (((gy >> k) & 1) << (2 * k + 1)))) AS BIGINT) AS leaf FROM g),
c0 AS (SELECT leaf AS c, count(*) AS n FROM l GROUP BY 1),
c1 AS (SELECT c >> 2 AS c, sum(n) AS n FROM c0 GROUP BY 1 HAVING count(*) = 4 AND sum(n) < {minimum}),
c2 AS (SELECT c >> 2 AS c, sum(n) AS n FROM c1 GROUP BY 1 HAVING count(*) = 4 AND sum(n) < {minimum}),
c3 AS (SELECT c >> 2 AS c, sum(n) AS n FROM c2 GROUP BY 1 HAVING count(*) = 4 AND sum(n) < {minimum}),
every AS (SELECT 0 AS up, c, n FROM c0 UNION ALL SELECT 1, c, n FROM c1 UNION ALL SELECT 2, c, n FROM c2 UNION ALL SELECT 3, c, n FROM c3),
home AS (SELECT l.point_index, l.levels, arg_max(e.c, e.up) AS c, max(e.up) AS up, arg_max(e.n, e.up) AS n FROM l JOIN every e ON e.c = l.leaf >> CAST(2 * e.up AS INT) GROUP BY ALL),
cells AS (SELECT point_index, CAST((4 ** (levels - up) - 1) // 3 + c AS BIGINT) AS cell, CAST(n AS BIGINT) AS "full", levels, up, c FROM home),
lg AS (SELECT *, point_index - lag(point_index) OVER (PARTITION BY cell ORDER BY point_index) AS step FROM cells),
il AS (SELECT *, sum(CASE WHEN step <= 1000 THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY point_index) AS island FROM lg),
rr AS (SELECT cell, any_value("full") AS "full", any_value(levels) AS levels, any_value(up) AS up, any_value(c) AS c, island, min(point_index) AS run_start, max(point_index) AS run_end, count(*) AS n FROM il GROUP BY cell, island),
gp AS (SELECT *, run_start - lag(run_end) OVER (PARTITION BY cell ORDER BY run_start) AS gap FROM rr),
sp AS (SELECT greatest(0, count(*) - {most} * count(DISTINCT cell)) AS spare FROM rr),
pl AS (SELECT *, CASE WHEN gap IS NOT NULL THEN row_number() OVER (ORDER BY gap NULLS LAST, cell, run_start) END AS place FROM gp),
kp AS (SELECT *, sum(CASE WHEN place <= (SELECT spare FROM sp) THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY run_start) AS kept FROM pl),
idx AS (SELECT cell, any_value("full") AS "full", any_value(levels) AS levels, any_value(up) AS up, any_value(c) AS c, min(run_start) AS run_start, max(run_end) AS run_end, CAST(sum(n) AS BIGINT) AS n FROM kp GROUP BY cell, kept),
boxed AS (SELECT idx.*, 4.0::DOUBLE * (ox + (list_sum(list_transform(range(15), lambda k: ((c >> (2 * k)) & 1) << k)) << up)) AS low_x, 4.0::DOUBLE * (oy + (list_sum(list_transform(range(15), lambda k: ((c >> (2 * k + 1)) & 1) << k)) << up)) AS low_y, 4.0::DOUBLE * (1 << up) AS side FROM idx, t)
"""
_INDEX_SQL = _TREE.replace("{minimum}", str(INDEX["minimum_points"])).replace("{most}", str(-INDEX["maximum_intervals"]))

SQL = {
    "checksum": _PC + ", r AS (SELECT point_index, " + _RECORD + " AS bytes FROM pc) SELECT 'events' AS file, " + fnv_sql("flatten(list(bytes ORDER BY point_index))") + ' AS hash, count(*) AS n FROM r',
    "selection_checksum": _PC + f", r AS (SELECT point_index, {low_first('point_index', 8)} AS bytes FROM xy WHERE {_RECT_SQL}) SELECT 'events' AS file, " + fnv_sql("flatten(list(bytes ORDER BY point_index))") + " AS hash, count(*) AS n FROM r",
    "index_cells": _INDEX_SQL + 'SELECT cell, "full", run_start, run_end, n, low_x, low_x + side AS high_x, low_y, low_y + side AS high_y FROM boxed',
    "index_candidates": _INDEX_SQL + f""", hit AS (SELECT run_start AS a, run_end AS b FROM boxed WHERE low_x < {SMALL_RECT[2]} AND low_x + side > {SMALL_RECT[0]} AND low_y < {SMALL_RECT[3]} AND low_y + side > {SMALL_RECT[1]}),
m AS (SELECT *, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hit),
i AS (SELECT *, sum(CASE WHEN a - before <= 1000 THEN 0 ELSE 1 END) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT min(a) AS run_start, max(b) AS run_end FROM i GROUP BY island""",
    "project_columns": _PC + " SELECT point_index, X, intensity, gps_time FROM pc",
    "scaled_xyz": _PC + " SELECT point_index, X * 0.01::DOUBLE AS sx, Y * 0.01::DOUBLE AS sy, Z * 0.01::DOUBLE AS sz FROM pc",
    "unscale_roundtrip": _PC + f", q AS (SELECT point_index, CAST({_away('((gps_time - 100::DOUBLE) / 0.5::DOUBLE)')} AS INT) AS q FROM pc) SELECT point_index, q, q * 0.5::DOUBLE + 100::DOUBLE AS back FROM q",
    "unpack_fields": _PC + f" SELECT point_index, {', '.join(map(_unpacked, _FIELDS))} FROM pc",
    "pack_flags": _PC + " SELECT point_index, returns_and_flags, classification_byte FROM pc",
    "legacy_returns": _PC
    + """, a AS (SELECT point_index, point_index % 11 + 1 AS r, point_index % 15 + 1 AS n FROM pc)
SELECT point_index, CAST(CASE WHEN n > 7 AND r > 6 THEN CASE WHEN r >= n THEN 7 ELSE 6 END ELSE r END AS SMALLINT) AS return_number,
  CAST(least(n, 7) AS SMALLINT) AS number_of_returns FROM a""",
    "scan_rank": _PC
    + f""", a AS (SELECT point_index, CAST(0.006::FLOAT * CAST(point_index % 60001 - 30000 AS FLOAT) AS DOUBLE) AS d,
  CAST(CAST(CAST(CAST(point_index % 256 - 128 AS FLOAT) AS DOUBLE) / CAST(0.006::FLOAT AS DOUBLE) AS FLOAT) AS DOUBLE) AS w FROM pc)
SELECT point_index, CAST(greatest(-128, least(127, {_away('d')})) AS TINYINT) AS rank, CAST({_away('w')} AS SMALLINT) AS angle FROM a""",
    "class_bytes": _PC
    + """, a AS (SELECT point_index, X, CAST(point_index % 256 AS INT) AS cls, CAST(point_index % 16 AS INT) AS flags FROM pc)
SELECT point_index, CAST(((flags << 5) & 224) | (CASE WHEN cls < 32 THEN cls ELSE 0 END) AS INT) AS legacy_byte,
  CAST(CASE WHEN cls % 32 = 0 THEN cls ELSE cls % 32 END AS SMALLINT) AS wide, CAST(((X - 5000) % 256 + 256) % 256 AS INT) AS folded FROM a""",
    "colour_struct": "SELECT DISTINCT file_id, point_index, red, green, blue, CAST(0 AS INT) AS nir FROM las_points WHERE red IS NOT NULL",
    "within_rect": _PC + f" SELECT point_index, x, y FROM xy WHERE {_RECT_SQL}",
    "within_circle": _PC + f" SELECT point_index, x, y FROM xy WHERE {_CIRCLE_SQL}",
    "adjoining_rects": _PC
    + """ SELECT CAST((CASE WHEN x < 50 THEN 0 ELSE 2 END) + (CASE WHEN y < 50 THEN 0 ELSE 1 END) AS INT) AS tile, count(*) AS n
FROM xy WHERE x >= 0 AND x < 100 AND y >= 0 AND y < 100 GROUP BY 1""",
    "classification_thin": "SELECT DISTINCT file_id, point_index, X, Y, Z FROM las_points WHERE classification = 2",
    "field_ranges": """SELECT DISTINCT point_id, intensity, classification FROM las_points WHERE intensity < 0 OR intensity > 65535 OR classification < 0 OR classification > 31
  OR user_data < 0 OR user_data > 255 OR return_number < 0 OR return_number > 7 OR red < 0 OR red > 65535 OR point_source_ID < 0 OR point_source_ID > 65535""",
    "checked_fields": """SELECT classification, count(*) AS n, max(intensity) AS most FROM (SELECT DISTINCT point_id, intensity, classification FROM las_points
  WHERE coalesce(intensity BETWEEN 0 AND 65535, true) AND coalesce(classification BETWEEN 0 AND 31, true)) GROUP BY 1""",
    "scaled_rect": """SELECT DISTINCT point_id, X * 0.01::DOUBLE + 0.0::DOUBLE AS x, Y * 0.01::DOUBLE + 0.0::DOUBLE AS y FROM las_points
WHERE X * 0.01::DOUBLE >= -20000 AND X * 0.01::DOUBLE < 60000 AND Y * 0.01::DOUBLE >= -10000 AND Y * 0.01::DOUBLE < 10000""",
    "points_slice": _PC + " SELECT point_index, X, Y, Z FROM pc WHERE point_index BETWEEN 100 AND 349",
    "seek_point": _PC + " SELECT point_index, X, Y, Z FROM pc WHERE point_index = 777",
    "preview": _PC + " SELECT point_index, X, Y, Z, intensity FROM pc ORDER BY point_index LIMIT 10",
    "chunk_of_point": _PC + f" SELECT point_index, point_index // {CHUNK} AS chunk_index FROM pc",
    "adaptive_chunks": """SELECT DISTINCT p.file_id, p.point_index, c.chunk_index FROM las_points p JOIN las_chunks c
ON p.file_id = c.file_id AND p.point_index >= c.start_index AND p.point_index < c.start_index + c.point_count""",
    "chunk_starts": """SELECT file_id, chunk_index, CAST(coalesce(sum(point_count) OVER (PARTITION BY file_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index, byte_offset
FROM (SELECT DISTINCT file_id, chunk_index, point_count, byte_offset FROM las_chunks)""",
    "count_points": _PC + " SELECT count(*) AS n FROM pc",
    "bounds": _PC + ' SELECT min(X) AS "min_X", min(Y) AS "min_Y", max(X) AS "max_X", max(Y) AS "max_Y" FROM pc',
    "bounds_scaled": _PC
    + " SELECT min(X) * 0.01::DOUBLE AS min_x, min(Y) * 0.01::DOUBLE AS min_y, min(Z) * 0.01::DOUBLE AS min_z, max(X) * 0.01::DOUBLE AS max_x, max(Y) * 0.01::DOUBLE AS max_y, max(Z) * 0.01::DOUBLE AS max_z FROM pc",
    "header_stats": _PC
    + " SELECT count(*) AS number_of_point_records, "
    + ", ".join(f"count(*) FILTER (returns_and_flags & 7 = {r}) AS returns_{r}" for r in range(1, 6))
    + ", "
    + ", ".join(f"coalesce({f}({a}) * 0.01::DOUBLE, 0) AS {f}_{a.lower()}" for a in "XYZ" for f in ("max", "min"))
    + " FROM pc",
    "by_return": _PC + " SELECT CAST(returns_and_flags & 7 AS SMALLINT) AS return_number, count(*) AS n FROM pc GROUP BY 1",
    "dsm_max": _PC + ' SELECT CAST(floor((20010::DOUBLE - Y) / 500) AS BIGINT) AS "row", CAST(floor(X / 500::DOUBLE) AS BIGINT) AS col, max(Z) AS value FROM pc GROUP BY 1, 2',
    "dsm_dense": _PC
    + """, s AS (SELECT CAST(floor((20010::DOUBLE - Y) / 100) AS BIGINT) AS r, CAST(floor(X / 100::DOUBLE) AS BIGINT) AS c, CAST(max(Z) AS DOUBLE) AS v FROM pc GROUP BY 1, 2)
SELECT CAST(g // 201 AS BIGINT) AS "row", CAST(g % 201 AS BIGINT) AS col, coalesce(v, 'NaN'::DOUBLE) AS value FROM range(201 * 201) t(g) LEFT JOIN s ON r = g // 201 AND c = g % 201""",
    "file_summary": """WITH h AS (SELECT DISTINCT file_id, version_minor, point_data_format_id, point_data_record_length, number_of_point_records, x_scale_factor FROM las_headers),
p AS (SELECT file_id, count(DISTINCT point_id) AS points, min(X) AS a, max(X) AS b, min(Y) AS c, max(Y) AS d FROM las_points GROUP BY file_id)
SELECT h.file_id, version_minor, point_data_format_id, point_data_record_length, number_of_point_records, points,
  a * x_scale_factor AS points_min_x, b * x_scale_factor AS points_max_x, c * x_scale_factor AS points_min_y, d * x_scale_factor AS points_max_y FROM h LEFT JOIN p USING (file_id)""",
    "item_users": "SELECT file_id, string_agg(DISTINCT user_id, ',' ORDER BY user_id) AS users, count(DISTINCT vlr_index) AS records FROM las_vlrs GROUP BY file_id",
    "cell_counts": _PC + ' SELECT cell, count(*) AS "full" FROM leafed GROUP BY cell',
    "cell_runs": _PC + _RUNS + " SELECT cell, run_start, run_end, points FROM runs",
    "coalesced_runs": _PC
    + """, s AS (SELECT cell, point_index, point_index - lag(point_index) OVER (PARTITION BY cell ORDER BY point_index) AS step FROM leafed),
i AS (SELECT *, sum(CASE WHEN step <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY point_index) AS island FROM s),
r AS (SELECT min(point_index) AS a, max(point_index) AS b FROM i GROUP BY cell, island),
m AS (SELECT *, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT *, sum(CASE WHEN a - before <= 0 THEN 0 ELSE 1 END) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT min(a) AS run_start, max(b) AS run_end FROM g GROUP BY island""",
    "coarsened": _PC
    + ", l4 AS (SELECT "
    + " | ".join(f"(((X >> {11 + k}) & 1) << {2 * k}) | (((Y >> {11 + k}) & 1) << {2 * k + 1})" for k in range(4))
    + """ AS c, count(*) AS n FROM pc GROUP BY 1),
""" + ",\n".join(
        # a parent stands if its four children stand whole and hold fewer than 600 points
        f"u{k} AS (SELECT c >> 2 AS c, sum(n) AS n FROM {'l4' if k == 3 else f'u{k + 1}'} GROUP BY 1 HAVING count(*) = 4 AND sum(n) < 600)" for k in (3, 2, 1, 0)
    ) + """,
every AS (""" + " UNION ALL ".join(f"SELECT {k} AS level, c, n FROM {'l4' if k == 4 else f'u{k}'}" for k in range(5)) + """)
SELECT CAST((4 ** level - 1) // 3 + c AS BIGINT) AS cell, CAST(n AS BIGINT) AS "full" FROM every e
WHERE NOT EXISTS (SELECT 1 FROM every p WHERE p.level < e.level AND p.c = e.c >> CAST(2 * (e.level - p.level) AS INT))""",
    "limit_runs": _PC
    + _RUNS
    + """, g AS (SELECT *, run_start - lag(run_end) OVER (PARTITION BY cell ORDER BY run_start) AS gap FROM runs),
c AS (SELECT count(*) - 2 * count(DISTINCT cell) AS spare FROM runs),
k AS (SELECT *, CASE WHEN gap IS NULL THEN NULL ELSE row_number() OVER (ORDER BY gap NULLS LAST, cell, run_start) END AS place FROM g),
m AS (SELECT *, sum(CASE WHEN place <= (SELECT spare FROM c) THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY run_start) AS kept FROM k)
SELECT cell, min(run_start) AS run_start, max(run_end) AS run_end FROM m GROUP BY cell, kept""",
    "covered_points": _PC + _RUNS + " SELECT cell, CAST(sum(run_end - run_start + 1) AS BIGINT) AS covered, CAST(sum(points) AS BIGINT) AS points FROM runs GROUP BY cell",
    "indexed_rect": _PC + f" SELECT point_index, x, y FROM xy WHERE {_RECT_SQL}",
    "indexed_circle": _PC + f" SELECT point_index, x, y FROM xy WHERE {_CIRCLE_SQL}",
    "zone_counts": """WITH q AS (SELECT DISTINCT point_id, CAST(X AS BIGINT) AS x, CAST(Y AS BIGINT) AS y FROM las_points WHERE X IS NOT NULL)
SELECT zone_id, count(*) AS n FROM q JOIN zones z ON (z.shape = 'rect' AND q.x >= z.min_x AND q.x < z.max_x AND q.y >= z.min_y AND q.y < z.max_y)
  OR (z.shape = 'circle' AND (q.x - z.centre_x) * (q.x - z.centre_x) + (q.y - z.centre_y) * (q.y - z.centre_y) < CAST(z.radius AS BIGINT) * z.radius) GROUP BY zone_id""",
    "top_sources": """SELECT point_source_ID AS "point_source_ID", count(DISTINCT point_id) AS n FROM las_points WHERE point_source_ID IS NOT NULL
GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""",
    "return_cube": """SELECT classification, return_number, count(*) AS n, CAST(grouping(classification) * 2 + grouping(return_number) AS BIGINT) AS g
FROM (SELECT DISTINCT point_id, classification, return_number FROM las_points) GROUP BY CUBE (classification, return_number)""",
    "asof_header": """WITH d AS (SELECT dump_id, file_id, min(received_at) AS at FROM header_dumps GROUP BY ALL)
SELECT dump_id, epoch_us((SELECT max(h.received_at) FROM las_headers h WHERE h.file_id = d.file_id AND h.received_at <= d.at)) AS header_us FROM d""",
    "gps_steps": """WITH p AS (SELECT DISTINCT file_id, point_index, gps_time FROM las_points WHERE gps_time IS NOT NULL),
s AS (SELECT file_id, gps_time - lag(gps_time) OVER (PARTITION BY file_id ORDER BY point_index) AS step FROM p)
SELECT file_id, min(step) AS least, max(step) AS most, count(*) AS steps FROM s WHERE step IS NOT NULL GROUP BY file_id""",
}
