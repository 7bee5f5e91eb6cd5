"""Whole-cloud folds: bounds, counts by return, rasters, ordered checksums.

Folds combine on the map side; nulls are skipped. Checksums depend on order: each file is folded in order of its ordinals by one
task as the sorted rows stream past, files in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: FNV-1a, 64 bits (fixed values).
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
_WORD = (1 << 64) - 1


def bounds(points: DataFrame, axes: tuple[str, ...] = ("X", "Y")) -> DataFrame:
    """One row: lowest and highest of each axis. An empty cloud has nulls."""
    low = [F.min(a).alias(f"min_{a}") for a in axes]
    return points.agg(*low, *[F.max(a).alias(f"max_{a}") for a in axes])


def header_stats(points: DataFrame, returns: str = "return_number") -> DataFrame:
    """What a file header says of its points: count, bounds (0 where there are none) and counts of the first five returns."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return points.agg(
        F.count(F.lit(1)).alias("number_of_point_records"),
        *[F.count_if(F.col(returns) == r).alias(f"returns_{r}") for r in range(1, 6)],
        *[zero(f(a)).alias(f"{n}_{a}") for a in ("x", "y", "z") for n, f in (("max", F.max), ("min", F.min))],
    )


def by_return(points: DataFrame, returns: str = "return_number") -> DataFrame:
    return points.groupBy(F.col(returns).alias("return_number")).agg(F.count(F.lit(1)).alias("n"))


def raster(points: DataFrame, x: Column, y: Column, value: Column, min_x: float, max_y: float, cell: float, how=F.max) -> DataFrame:
    """North-up raster: rows (row, col, value) of cells that hold points."""
    row = F.floor((F.lit(float(max_y)) - y) / F.lit(float(cell))).alias("row")
    col = F.floor((x - F.lit(float(min_x))) / F.lit(float(cell))).alias("col")
    return points.groupBy(row, col).agg(how(value).alias("value"))


def dense_raster(sparse: DataFrame, rows: int, cols: int) -> DataFrame:
    """All cells of the raster, empty ones NaN."""
    spark = sparse.sparkSession
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    return grid.join(sparse, ["row", "col"], "left").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))))


def steps(points: DataFrame, key: str, value: str, index: str = "point_index", block: int = 1 << 16) -> DataFrame:
    """Per key: the least and largest step of ``value`` from one point to the next in order of ``index``, and how many steps there are.

    Steps are taken inside blocks of ordinals, and between blocks from their first and last values, so a key with many points
    is spread over many tasks. Points without a value are passed over.
    """
    p = points.where(F.col(key).isNotNull() & F.col(value).isNotNull() & F.col(index).isNotNull()).select(
        F.col(key).alias("__key"), F.col(index).alias("__at"), F.col(value).alias("__v"), F.floor(F.col(index) / block).alias("__block")
    )
    inside = p.withColumn("__step", F.col("__v") - F.lag("__v").over(Window.partitionBy("__key", "__block").orderBy("__at")))
    each = inside.groupBy("__key", "__block").agg(
        F.min("__step").alias("low"), F.max("__step").alias("high"), F.count("__step").alias("n"), F.min_by("__v", "__at").alias("first"), F.max_by("__v", "__at").alias("last")
    )
    over = F.col("first") - F.lag("last").over(Window.partitionBy("__key").orderBy("__block"))
    joined = each.withColumn("over", over)
    # least() and greatest() pass over nulls
    return (
        joined.groupBy(F.col("__key").alias(key))
        .agg(F.min(F.least("low", "over")).alias("least"), F.max(F.greatest("high", "over")).alias("most"), (F.sum("n") + F.count("over")).alias("steps"))
        .where("steps > 0")
    )


def fnv1a(data: bytes, h: int = FNV_OFFSET) -> int:
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & _WORD
    return h


#: The 64-byte record a point is summed as (fixed by the checksum's definition).
RECORD = np.dtype(
    {
        "names": ["X", "Y", "Z", "intensity", "b14", "b15", "scan_angle_rank", "user_data", "point_source_ID", "gps_time", "red", "green", "blue", "nir",
                  "extended_scan_angle", "ext_flags", "extended_classification", "ext_returns", "wave"],
        "formats": ["<i4", "<i4", "<i4", "<u2", "u1", "u1", "i1", "u1", "<u2", "<f8", "<u2", "<u2", "<u2", "<u2", "<i2", "u1", "u1", "u1", "V23"],
        "offsets": [0, 4, 8, 12, 14, 15, 16, 17, 18, 20, 28, 30, 32, 34, 36, 38, 39, 40, 41],
        "itemsize": 64,
    }
)


def records(cols: dict[str, np.ndarray], n: int) -> list[bytes]:
    """Bytes of each point that enter the checksum, from column arrays; columns that are missing count as 0."""
    zero = np.zeros(n, np.int64)
    g = lambda c: cols[c].astype(np.int64) if c in cols else zero
    rec = np.zeros(n, RECORD)
    for f in ("X", "Y", "Z", "intensity", "scan_angle_rank", "user_data", "point_source_ID", "red", "green", "blue", "nir", "extended_scan_angle", "extended_classification"):
        rec[f] = g(f)
    if "gps_time" in cols:
        rec["gps_time"] = cols["gps_time"]
    rec["b14"] = g("return_number") & 7 | (g("number_of_returns") & 7) << 3 | (g("scan_direction_flag") & 1) << 6 | (g("edge_of_flight_line") & 1) << 7
    rec["b15"] = g("classification") & 31 | (g("synthetic_flag") & 1) << 5 | (g("keypoint_flag") & 1) << 6 | (g("withheld_flag") & 1) << 7
    rec["ext_flags"] = g("extended_point_type") & 3 | (g("extended_scanner_channel") & 3) << 2 | (g("extended_classification_flags") & 15) << 4
    rec["ext_returns"] = g("extended_return_number") & 15 | (g("extended_number_of_returns") & 15) << 4
    raw = rec.tobytes()
    wave, extra = cols.get("wave_packet"), cols.get("extra_bytes")
    out = []
    for i in range(n):
        r = raw[64 * i : 64 * i + 64]
        w = bytes(wave[i]) if wave is not None and wave[i] is not None else bytes(29)
        out.append(r[:41] + w[:23] + w[23:29] + (bytes(extra[i]) if extra is not None and extra[i] is not None else b""))
    return out


def _ordered_fold(points: DataFrame, key: str, index: str, columns: list[str], step) -> DataFrame:
    """Folds each key's rows in order. Rows of one key meet in one task and stream past, a state per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, n = None, FNV_OFFSET, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([f"{h:016x}"]), pa.array([n], pa.int64())], names=["file", "hash", "n"])

        for b in batches:
            keys = b["__key"].to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if keys[a] != at:
                    if at is not None:
                        yield done()
                    at, h, n = keys[a], FNV_OFFSET, 0
                h, n = step(b.slice(a, z - a), h), n + z - a
        if at is not None:
            yield done()

    flat = points.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("__key"), F.col(index).alias("__index"), *[c for c in columns if c != index] + ([index] if index in columns else []))
    return flat.repartition("__key").sortWithinPartitions("__key", "__index").mapInArrow(run, "file string, hash string, n long")


def checksum(points: DataFrame, key: str = "file", index: str = "point_index") -> DataFrame:
    """Per file: ordered checksum of every decoded field (hex) and number of points."""
    columns = [c for c in points.columns if c not in (key, index)]

    def step(b: pa.RecordBatch, h: int) -> int:
        cols = {}
        for c in columns:
            a = b[c]
            if a.null_count == len(a):
                continue
            cols[c] = a.to_pylist() if pa.types.is_binary(a.type) else a.fill_null(0).to_numpy(zero_copy_only=False)
        for r in records(cols, b.num_rows):
            h = fnv1a(r, h)
        return h

    return _ordered_fold(points, key, index, columns, step)


def index_checksum(points: DataFrame, key: str = "file", index: str = "point_index") -> DataFrame:
    """Per file: ordered checksum of the selected ordinals (hex) and their number."""

    def step(b: pa.RecordBatch, h: int) -> int:
        return fnv1a(b["__index"].to_numpy().astype("<u8").tobytes(), h)

    return _ordered_fold(points, key, index, [], step)
