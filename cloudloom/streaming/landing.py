"""Streams: folders where files land, read incrementally with exactly-once batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.runtime import scratch
from cloudloom.sources.las.datasource import register


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_las(
    spark: SparkSession, path: str, columns: Sequence[str], each: Callable[[DataFrame], DataFrame], whole: Callable[[DataFrame], DataFrame], checkpoint: str | None = None
) -> DataFrame:
    """Points of the files that have landed under ``path``: ``each`` shrinks a batch, ``whole`` puts the batches' results together.

    A batch's result is written under its number, so that a batch run again replaces itself. With a ``checkpoint`` kept between calls
    only new files are read; the partial results lie beside it.
    """
    register(spark)
    base = checkpoint or scratch(spark)
    stream = spark.readStream.format("las").option("columns", ",".join(columns))
    if "://" not in base.removeprefix("file://"):
        stream = stream.option("log", f"{base}/files")
    stream = stream.load(path)

    def save(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{base}/parts/batch={number}")

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/checkpoint").trigger(once=True).start()
    q.awaitTermination()
    return whole(spark.read.parquet(f"{base}/parts").drop("batch"))


def parquet_counts(spark: SparkSession, sf_dir: str, name: str, time: str, window: str, by: Sequence[str], late: str = "30 days") -> DataFrame:
    """Rows per time window and key of a table read as a stream, with a watermark ``late`` behind the latest row.

    Rows later than the watermark are dropped by Spark; every batch's updated counts are kept under its number and the last one of a window counts.
    """
    base = scratch(spark)
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    # a stream reads folders; a table that is a single file is picked out of its folder
    rows = source.parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    if isinstance(schema[time].dataType, T.TimestampNTZType):
        # a time without a zone is taken as UTC, whatever the session's zone
        rows = rows.withColumn(time, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`))"))
    counts = rows.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        batch.select(F.unix_micros("window.start").alias("window_us"), *by, "n").write.mode("overwrite").parquet(f"{base}/parts/batch={number}")

    q = counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/parts").groupBy("window_us", *by).agg(F.max_by("n", "batch").alias("n"))
