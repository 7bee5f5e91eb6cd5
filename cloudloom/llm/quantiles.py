"""Percentiles of very large numeric columns from mergeable sketches.

The sketch is a hierarchy of randomized compactors: a full level is sorted and every second value, from
a random start, moves up with twice the weight; sketches merge level by level. Spark has it built in
(``kll_sketch_agg``), so building, merging and reading run inside the JVM with partial aggregation: a group
with a third of all rows is sketched where its rows lie and only sketches of a few kB move.

Error: a percentile read from a sketch of parameter ``k`` has a rank within ``rank_error(k)`` of the asked one,
as a share of the rows, with probability 0.99. Merging does not widen the bound.

Defined cases: null values and null groups are left out; a group without values has no row; ties and
repeated rows count as often as they occur unless ``identity`` names the columns that make a row unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.runtime import BROADCAST_ROWS, is_small

#: Sketch parameter: 0.13 % rank error, under 40 kB a sketch.
K = 4000


def rank_error(k: int = K) -> float:
    """Bound on the rank error at 99 % confidence for one percentile, as a share of the rows (published fit for this sketch)."""
    return 2.296 / k**0.9021


def sketches(df: DataFrame, value: str, by: list[str | Column], k: int = K) -> DataFrame:
    """One sketch per group in column ``sketch``, with its exact ``n``, lowest and highest value."""
    v = F.col(value).cast("long")
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.kll_sketch_agg_bigint(v, k).alias("sketch"), F.count(v).alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest")
    )


def merge(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Puts sketches of separate files or days together, per group."""
    return parts.groupBy(*by).agg(
        F.kll_merge_agg_bigint("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest")
    )


def percentiles(parts: DataFrame, shares: tuple[float, ...], prefix: str = "p") -> DataFrame:
    """Adds a column per asked share (0.5 becomes ``p50``) and the rank error bound; drops the sketch."""
    # a sketch of few values keeps them all, so the ends are exact anyway; the clamp keeps estimates inside the data
    got = {
        f"{prefix}{share * 100:g}".replace(".", "_"): F.greatest("lowest", F.least("highest", F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(share)))))
        for share in shares
    }
    return parts.withColumns(got).drop("sketch")


def once(df: DataFrame, identity: str, columns: list[str]) -> DataFrame:
    """One row per ``identity`` whose copies agree in ``columns``; min() keeps this inside hash aggregation."""
    return df.where(F.col(identity).isNotNull()).groupBy(identity).agg(*[F.min(c).alias(c) for c in columns])


def within_bound(df: DataFrame, answers: DataFrame, value: str, by: str, shares: tuple[float, ...], k: int = K, prefix: str = "p") -> DataFrame:
    """Per group of ``by``: rows, and for each asked share whether the answer's true rank is within the bound (column ``p50_ok``).

    Counts every row against the answers of its group. A value that occurs often has a range of ranks; any of them counts.
    """
    names = {share: f"{prefix}{share * 100:g}".replace(".", "_") for share in shares}
    held = answers.select(by, *[F.col(c).alias(f"__{c}") for c in names.values()])
    v = F.col(value).cast("long")
    rows = df.where(v.isNotNull()).join(F.broadcast(held) if is_small(held, BROADCAST_ROWS) else held, by)
    n = F.count(F.lit(1))
    got = [
        ((F.count_if(v < F.col(f"__{c}")) / n <= share + rank_error(k)) & (F.count_if(v <= F.col(f"__{c}")) / n >= share - rank_error(k))).alias(f"{c}_ok")
        for share, c in names.items()
    ]
    return rows.groupBy(by).agg(n.alias("n"), *got)
