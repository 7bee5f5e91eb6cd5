"""Session helpers: table loading, materialisation in the shared folder, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a helper table that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000

_scratch: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set.

    Only a local master may fall back on a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
    base = "file://" + tempfile.mkdtemp(prefix="cloudloom-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers that don't have it, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_cloudloom_shipped", False):
        return
    name = __package__

    def there(_) -> bool:
        import importlib.util

        return importlib.util.find_spec(name) is not None

    if not sc.parallelize([0], 1).map(there).first():
        root = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="cloudloom-"), name)
        # the driver's file server hands the archive to the executors
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
    sc._cloudloom_shipped = True


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by ``release`` or at the end of the Python process."""
    path = f"{shared_dir(spark).rstrip('/')}/cloudloom/{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage at files every executor can read, so a lost executor costs no recomputation.
    The files stay until ``release`` or the end of the Python process.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None) -> None:
    """Delete what lies in scratch paths. Frames built on it can't be read afterwards."""
    for path, owner in list(_scratch.items()):
        if spark is None or owner is spark:
            try:
                jvm = owner.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:
                continue
            _scratch.pop(path, None)


atexit.register(release)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input is in fewer pieces than there are cores.

    For work that is heavy per byte. Large inputs come in many pieces anyway and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
