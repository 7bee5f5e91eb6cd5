"""Queries that go through point files: clouds are written with the sink, read back with the source, and must be what they were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions import bits
from cloudloom.operators import folds, runindex
from cloudloom.plans.clouds import _PC, _RECT_SQL, RECT, cloud, double_bytes, fnv_sql, low_first, zeros
from cloudloom.runtime import scratch, table
from cloudloom.sources.las.datasource import read_headers, read_las, register, take_points
from cloudloom.streaming.landing import parquet_counts, stream_las

_CHUNK = 5000


def _folder(spark: SparkSession) -> str:
    return scratch(spark).removeprefix("file://").removeprefix("file:")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events cloud in the columns of old point formats."""
    pc = cloud(spark, sf_dir)
    old = [f for f, (b, _, _) in bits.PACKED.items() if b in ("returns_and_flags", "classification_byte")]
    return pc.select(
        "point_index", "X", "Y", "Z", "intensity", *[bits.unpack(F.col(bits.PACKED[f][0]), f).alias(f) for f in old],
        (F.col("point_index") % 181 - 90).cast("byte").alias("scan_angle_rank"), (F.col("X") % 256).cast("short").alias("user_data"),
        (F.col("Y") % 65536).cast("int").alias("point_source_ID"), "gps_time",
        (F.col("Z") * 60).cast("int").alias("red"), (F.col("X") * 3).cast("int").alias("green"), (F.col("Y") * 3).cast("int").alias("blue"),
    )


def _write(df: DataFrame, **options) -> str:
    """Writes one file in order of the ordinals, so that the file's ordinals are the table's."""
    spark = df.sparkSession
    register(spark)
    path = _folder(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    w = df.repartitionByRange(parts, "point_index").sortWithinPartitions("point_index").write.format("las").mode("append")
    for k, v in ({"single": "true", "chunkSize": "0"} | options).items():
        w = w.option(k, v)
    w.save(path)
    return path


_OLD = ["point_index", "X", "Y", "Z", "intensity", "return_number", "number_of_returns", "scan_direction_flag", "edge_of_flight_line", "classification", "scan_angle_rank", "user_data", "point_source_ID"]


def las_scan(spark, sf_dir):
    """Uncompressed records of format 3."""
    path = _write(_fields(spark, sf_dir), pointFormat="3", compressed="false")
    return read_las(spark, path, [*_OLD, "gps_time", "red", "green", "blue"])


def laz_scan(spark, sf_dir):
    """Compressed chunks of format 3."""
    path = _write(_fields(spark, sf_dir), pointFormat="3")
    return read_las(spark, path, [*_OLD, "gps_time", "red", "green", "blue"])


def laz_first_version(spark, sf_dir):
    """The first codec versions."""
    path = _write(_fields(spark, sf_dir), pointFormat="1", itemVersion="1")
    return read_las(spark, path, [*_OLD, "gps_time"])


def _wide(spark, sf_dir) -> DataFrame:
    f = _fields(spark, sf_dir)
    return f.select(
        "point_index", "X", "Y", "Z", "intensity", "scan_direction_flag", "edge_of_flight_line", "user_data", "point_source_ID", "gps_time", "red", "green", "blue",
        (F.col("X") % 65536).alias("nir"),
        F.col("return_number").alias("extended_return_number"), F.col("number_of_returns").alias("extended_number_of_returns"),
        (F.col("point_index") % 256).cast("short").alias("extended_classification"), (F.col("point_index") % 4).cast("short").alias("extended_scanner_channel"),
        (F.col("point_index") % 60001 - 30000).cast("short").alias("extended_scan_angle"),
    )


_NEW = ["point_index", "X", "Y", "Z", "intensity", "extended_return_number", "extended_number_of_returns", "extended_classification", "extended_scanner_channel", "extended_scan_angle", "user_data", "point_source_ID", "gps_time"]


def laz_layered_scan(spark, sf_dir):
    """Layered chunks of format 8, fourth codec version."""
    path = _write(_wide(spark, sf_dir), pointFormat="8", itemVersion="4")
    return read_las(spark, path, [*_NEW, "red", "green", "blue", "nir"])


def laz_layers_skipped(spark, sf_dir):
    """Two columns of layered chunks: no other layer is decoded."""
    path = _write(_wide(spark, sf_dir), pointFormat="8")
    return read_las(spark, path, ["point_index", "X", "intensity"])


def laz_compatibility(spark, sf_dir):
    """Wide points kept in old records and read as what they are."""
    path = _write(_wide(spark, sf_dir), pointFormat="8", compatibility="true")
    return read_las(spark, path, [*_NEW, "nir"])


def laz_rect(spark, sf_dir):
    """A rectangle of a compressed file through the spatial index beside it."""
    path = _write(_fields(spark, sf_dir), pointFormat="1")
    xy = read_las(spark, path, ["point_index", "x", "y"], scaled=True)
    index = runindex.build(xy, cell_size=4.0, minimum_points=50).serialize()
    with open(f"{path}/points.lax", "wb") as f:
        f.write(index)
    return read_las(spark, path, ["point_index", "x", "y"], scaled=True, rect=RECT)


def laz_headers(spark, sf_dir):
    """What the header of a written file says of its points."""
    h = read_headers(spark, _write(_fields(spark, sf_dir), pointFormat="1"))
    return h.select("points", "point_format", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z")


def laz_checksum(spark, sf_dir):
    """The ordered checksum of what is read back."""
    c = folds.checksum(read_las(spark, _write(_fields(spark, sf_dir), pointFormat="3")))
    return c.select("hash", "n")


def laz_chunks(spark, sf_dir):
    """Points per chunk where a column decides: a chunk ends when it changes."""
    df = _fields(spark, sf_dir).withColumn("strip", F.floor(F.col("point_index") / 700))
    path = _write(df, pointFormat="1", chunkBy="strip")
    back = read_las(spark, path, ["point_index", "X"])
    return back.groupBy(F.floor(F.col("point_index") / 700).alias("strip")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("X").cast("long")).alias("sum_x"))


def laz_seek(spark, sf_dir):
    """Every twentieth point of a compressed file by random access."""
    path = _write(_fields(spark, sf_dir), pointFormat="1")
    schema = read_las(spark, path, ["point_index", "X", "Y", "Z", "gps_time"]).schema
    wanted = table(spark, sf_dir, "events").where("event_id % 20 = 0").select(F.lit(f"{path}/points.laz").alias("file"), F.col("event_id").alias("point_index"))
    return take_points(wanted, schema)


def stream_landing(spark, sf_dir):
    """Files that land in a folder, read as a stream: points and lowest Z per source."""
    path = _folder(spark)
    register(spark)
    _fields(spark, sf_dir).write.format("las").option("pointFormat", "1").mode("append").save(path)
    return stream_las(spark, path, ["point_source_ID", "Z"], lambda b: b.groupBy("point_source_ID").agg(F.count(F.lit(1)).alias("n"), F.min("Z").alias("least_z")),
                      lambda parts: parts.groupBy("point_source_ID").agg(F.sum("n").alias("n"), F.min("least_z").alias("least_z")))


def stream_windows(spark, sf_dir):
    """Events per hour and type as a stream with a watermark."""
    return parquet_counts(spark, sf_dir, "events", "ts", "1 hour", ["event_type"])


QUERIES = {
    f.__name__: f
    for f in (las_scan, laz_scan, laz_first_version, laz_layered_scan, laz_layers_skipped, laz_compatibility, laz_rect, laz_headers, laz_checksum, laz_seek, laz_chunks, stream_landing, stream_windows)
}

_F = (
    _PC
    + """, f AS (SELECT point_index, X, Y, Z, intensity, CAST(returns_and_flags & 7 AS SMALLINT) AS return_number, CAST((returns_and_flags >> 3) & 7 AS SMALLINT) AS number_of_returns,
  CAST((returns_and_flags >> 6) & 1 AS SMALLINT) AS scan_direction_flag, CAST((returns_and_flags >> 7) & 1 AS SMALLINT) AS edge_of_flight_line, CAST(classification_byte & 31 AS SMALLINT) AS classification,
  CAST(point_index % 181 - 90 AS TINYINT) AS scan_angle_rank, CAST(X % 256 AS SMALLINT) AS user_data, CAST(Y % 65536 AS INT) AS point_source_ID, gps_time,
  CAST(Z * 60 AS INT) AS red, CAST(X * 3 AS INT) AS green, CAST(Y * 3 AS INT) AS blue, CAST(X % 65536 AS INT) AS nir,
  CAST(returns_and_flags & 7 AS SMALLINT) AS extended_return_number, CAST((returns_and_flags >> 3) & 7 AS SMALLINT) AS extended_number_of_returns,
  CAST(point_index % 256 AS SMALLINT) AS extended_classification, CAST(point_index % 4 AS SMALLINT) AS extended_scanner_channel, CAST(point_index % 60001 - 30000 AS SMALLINT) AS extended_scan_angle FROM pc)"""
)


def _names(cols: list[str]) -> str:
    return ", ".join(f'{c} AS "{c}"' for c in cols)


SQL = {
    "las_scan": _F + f" SELECT {_names([*_OLD, 'gps_time', 'red', 'green', 'blue'])} FROM f",
    "laz_scan": _F + f" SELECT {_names([*_OLD, 'gps_time', 'red', 'green', 'blue'])} FROM f",
    "laz_first_version": _F + f" SELECT {_names([*_OLD, 'gps_time'])} FROM f",
    # the sink has no old class for these points, so the first point of a chunk keeps its new one as well
    "laz_layered_scan": _F + f" SELECT {_names([*_NEW, 'red', 'green', 'blue', 'nir'])} FROM f",
    "laz_layers_skipped": _F + " SELECT point_index, X, intensity FROM f",
    "laz_compatibility": _F + f" SELECT {_names([*_NEW, 'nir'])} FROM f",
    "laz_checksum": _PC
    + ", r AS (SELECT point_index, "
    + " || ".join(
        [low_first(c, 4) for c in ("X", "Y", "Z")]
        + [low_first("intensity", 2), low_first("returns_and_flags", 1), low_first("classification_byte", 1), low_first("point_index % 181 - 90", 1), low_first("X % 256", 1), low_first("Y % 65536", 2)]
        + [double_bytes("gps_time"), low_first("Z * 60", 2), low_first("X * 3", 2), low_first("Y * 3", 2), zeros(36)]
    )
    + " AS bytes FROM pc) SELECT "
    + fnv_sql("flatten(list(bytes ORDER BY point_index))")
    + " AS hash, count(*) AS n FROM r",
    "laz_seek": _F + " SELECT point_index, X, Y, Z, gps_time FROM f WHERE point_index % 20 = 0",
    "laz_rect": _PC + f" SELECT point_index, x, y FROM xy WHERE {_RECT_SQL}",
    "laz_headers": _PC
    + " SELECT count(*) AS points, CAST(1 AS INT) AS point_format, min(X) * 0.01::DOUBLE AS min_x, min(Y) * 0.01::DOUBLE AS min_y, min(Z) * 0.01::DOUBLE AS min_z,"
    " max(X) * 0.01::DOUBLE AS max_x, max(Y) * 0.01::DOUBLE AS max_y, max(Z) * 0.01::DOUBLE AS max_z FROM pc",
    "laz_chunks": _PC + " SELECT point_index // 700 AS strip, count(*) AS n, CAST(sum(X) AS BIGINT) AS sum_x FROM pc GROUP BY 1",
    "stream_landing": _F + ' SELECT point_source_ID AS "point_source_ID", count(*) AS n, min(Z) AS least_z FROM f GROUP BY 1',
    "stream_windows": "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
