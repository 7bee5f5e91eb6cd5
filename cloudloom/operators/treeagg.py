"""Per-key results without imbalance: multi-level tree aggregation.

A chunk is what one task holds after the shuffle that makes rows unique; adaptive execution keeps chunks at
``spark.sql.adaptive.advisoryPartitionSizeInBytes``. Each chunk is combined where it lies, so a task hands on one
state per key it holds, however many rows or chunks there are. States are then merged in rounds of ``fan_in`` chunks
at a time until one state per key is left: no task receives more than ``fan_in`` partial states of a key, and no
round moves more than the states of the one before.

A chunk is told by the number of its task, which stays the same when a lost task is run again, so a rerun can
neither count a row twice nor lose it.

Defined cases: a null key is no key and has no row, but counts in the total; ties and repeated rows count as often as they
occur unless ``identity`` names the column that makes a row unique; a sum that leaves 64 bits raises; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States merged at a time.
FAN_IN = 16

#: How each kind of state is made from a column and merged with others of its kind.
_MAKE = {"count": lambda c: F.count(c), "sum": lambda c: F.sum(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c)}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}

States = dict[str, tuple[str, str | Column]]


def most_chunks(df: DataFrame) -> int:
    """Bound on the tasks that can follow a shuffle; adaptive execution only ever joins some."""
    conf = df.sparkSession.conf
    first = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(conf.get("spark.sql.shuffle.partitions")), int(first or 1))


def combine(df: DataFrame, keys: list[str], states: States, fan_in: int = FAN_IN) -> DataFrame:
    """First round: every chunk by itself, on the side of the task that holds it, then ``fan_in`` chunks together.

    ``states`` maps an output name to (kind, column), kind one of count, sum, min, max. The result has a ``chunk`` column.
    """
    return df.groupBy(*keys, F.floor(F.spark_partition_id() / fan_in).cast("int").alias("chunk")).agg(*[_MAKE[kind](c).alias(name) for name, (kind, c) in states.items()])


def merge_rounds(part: DataFrame, keys: list[str], states: States, chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Further rounds: merges the states of ``part``, whose ``chunk`` is below ``chunks``, until one is left per key."""
    while chunks > 1:
        chunks = -(-chunks // fan_in)
        up = [F.floor(F.col("chunk") / fan_in).cast("int").alias("chunk")] if chunks > 1 else []
        part = part.groupBy(*keys, *up).agg(*[_MERGE[kind](name).alias(name) for name, (kind, _) in states.items()])
    return part.drop("chunk")


def tree_aggregate(df: DataFrame, keys: list[str], states: States, chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """One row per key: chunks (tasks of ``df``, at most ``chunks``) are combined where they lie and merged in rounds."""
    return merge_rounds(combine(df, keys, states, fan_in), keys, states, -(-chunks // fan_in), fan_in)


def per_value(df: DataFrame, fields: list[str], identity: str, values: list[str] = (), fan_in: int = FAN_IN) -> DataFrame:
    """For every value of every field: rows, and count, sum, lowest and highest of each column in ``values``.

    Columns: field_name, key_value (null stands for rows without a value), rows, then n_, sum_, min_, max_ per value.
    Rows count once per ``identity``. All fields are served by one pass: chunks are combined by the
    tuple of fields first and taken apart when few states are left.
    """
    one = df.where(F.col(identity).isNotNull()).groupBy(identity).agg(*[F.min(c).alias(c) for c in dict.fromkeys([*fields, *values])])
    states: States = {"rows": ("count", F.lit(1))}
    for v in values:
        states |= {f"n_{v}": ("count", v), f"sum_{v}": ("sum", F.col(v).cast("long")), f"min_{v}": ("min", v), f"max_{v}": ("max", v)}
    local = combine(one, fields, states, fan_in)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("long").alias("key_value")) for f in fields])).alias("kv")
    flat = local.select(each, "chunk", *states).select("kv.field_name", "kv.key_value", "chunk", *states)
    # taking tuples apart leaves several states of a value in a chunk: at least one more round puts them together
    return merge_rounds(flat, ["field_name", "key_value"], states, max(2, -(-most_chunks(df) // fan_in)), fan_in)


def heavy_values(per: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Values that hold more than the given share of all rows of their field: field_name, key_value, rows, share.

    The total of a field counts rows without a value too. ``limits`` maps field names to shares.
    """
    # one row per value: at most 1/limit values of a field can pass, and the totals are one row per field
    totals = per.groupBy("field_name").agg(F.sum("rows").alias("total"))
    at = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return (
        per.join(F.broadcast(totals), "field_name")
        .where(F.col("key_value").isNotNull() & (F.col("rows") > at[F.col("field_name")] * F.col("total")))
        .select("field_name", "key_value", "rows", (F.col("rows") / F.col("total")).alias("share"))
    )
