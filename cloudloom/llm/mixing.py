"""Mixing sources to target weights by Poisson replication.

A source that holds ``t`` of all ``T`` tokens and shall contribute a share ``w`` needs a mean repetition of
``w * T / t``. Each document draws its number of copies from a Poisson law by inverting the distribution at a
uniform number hashed from its id, source, text and a seed, capped at the source's ``max_repeats``; the law's mean is chosen so
that the capped mean is the wanted repetition. A source that can't reach its target takes every document
``max_repeats`` times. Copies are exploded and shuffled globally by a hash of id, copy and seed.

How it scales: tokens per source are summed on the map side; draws are made row by row inside the JVM;
the one shuffle is the final range partitioning by hash, in which no key is heavy.

Defined cases: documents of a null source or one without target count in the total but contribute nothing; a
target without documents can't be reached; null texts have 0 tokens and are drawn like others; null shares
and caps count as 0; rows equal in id, source and text draw alike, but rows without an id each for themselves; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import exp, inf, isinf, lgamma, log, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.tokens import token_sizes
from cloudloom.runtime import BROADCAST_ROWS, is_small, materialize

#: Mean from which probabilities are taken from logarithms: exp(-mean) is too small for a double beyond 745.
LARGE = 500


def _around(mean: float, cap: int) -> tuple[range, list[float]]:
    """Numbers of copies below ``cap`` that a Poisson law of a large mean reaches at all, and their probabilities."""
    reach = 40 * sqrt(mean) + 40
    near = range(min(cap, max(0, int(mean - reach))), min(cap, int(mean + reach)))
    return near, [exp(k * log(mean) - mean - lgamma(k + 1)) for k in near]


def capped_mean(mean: float, cap: int) -> float:
    """Expected copies: E[min(Poisson(mean), cap)]."""
    if isinf(mean):
        return cap
    if mean > LARGE:
        return cap - sum((cap - k) * p for k, p in zip(*_around(mean, cap)))
    p, below, tail_free = exp(-mean), 0.0, 0.0
    for k in range(cap):
        below += k * p
        tail_free += p
        p *= mean / (k + 1)
    return below + cap * (1 - tail_free)


def poisson_mean(rate: float, cap: int) -> float:
    """Mean of the Poisson law whose capped mean is ``rate``; infinite where even the cap falls short."""
    if rate <= 0 or cap <= 0:
        return 0.0
    if rate >= cap:
        return inf
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < rate:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < rate else (low, mid)
    return high


def thresholds(mean: float, cap: int) -> list[float]:
    """Cumulative Poisson probabilities of 0 .. cap - 1 copies; a uniform number has passed as many as it takes copies."""
    if isinf(mean):
        return [-1.0] * cap
    if mean > LARGE:
        near, ps = _around(mean, cap)
        sums = list(accumulate(ps))
        return [0.0] * near.start + sums + [sums[-1] if sums else 0.0] * (cap - near.stop)
    out, p, total = [], exp(-mean), 0.0
    for k in range(cap):
        total += p
        out.append(total)
        p *= mean / (k + 1)
    return out


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: tokens held, wanted tokens, repetition, and whether its cap keeps it below the target."""
    goals = targets.where("source is not null").groupBy("source").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats")
    )
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    total = held.agg(F.sum("tokens")).first()[0] or 0
    return (
        goals.join(held, "source", "left")
        .fillna(0, ["tokens", "documents"])
        .withColumn("total", F.lit(total))
        .withColumn("wanted", F.col("target_share") * F.col("total"))
        .withColumn("short", F.col("tokens") * F.col("max_repeats") < F.col("wanted"))
    )


def _laws(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        steps = [thresholds(poisson_mean(wanted / tokens, cap), cap) if tokens else [] for wanted, tokens, cap in zip(part["wanted"], part["tokens"], part["max_repeats"].astype(int))]
        yield pd.DataFrame({"source": part["source"], "steps": pd.Series(steps, index=part.index, dtype=object)})


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): one row per chosen copy in mixing order, and per source target and actual shares."""
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    # 53 bits of a hash, as a number in [0, 1)
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", "source", "text", own, F.lit(seed)), 11) / F.lit(float(1 << 53))
    sized = materialize(token_sizes(docs.select("doc_id", "source", "text", uniform.alias("u")), ["doc_id", "source", "u"], path=tokenizer))
    plans = materialize(plan(sized, targets))
    law = materialize(plans.select("source", "wanted", "tokens", "max_repeats").mapInPandas(_laws, "source string, steps array<double>"))
    if is_small(law, BROADCAST_ROWS):
        law = F.broadcast(law)
    drawn = sized.join(law, "source")
    copies = F.size(F.filter("steps", lambda s: F.col("u") >= s))
    chosen = drawn.withColumn("copies", copies).where("copies > 0").select(
        "doc_id", "source", "n_tokens", "u", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )
    chosen = materialize(chosen.withColumn("mix_key", F.xxhash64("u", "copy", F.lit(seed + 1))).drop("u"))
    got = chosen.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_records"), F.max("copy").alias("most_repeats"))
    got = materialize(got)
    mixed = got.agg(F.sum("mixed_tokens")).first()[0] or 0
    shares = (
        plans.join(got, "source", "left")
        .fillna(0, ["mixed_tokens", "mixed_records", "most_repeats"])
        .select(
            "source", "target_share", "max_repeats", "documents", "tokens", "wanted", "short", "mixed_records", "mixed_tokens", "most_repeats",
            (F.col("mixed_tokens") / F.nullif("total", F.lit(0))).alias("share_of_input"), (F.col("mixed_tokens") / F.lit(mixed or None).cast("double")).alias("share_of_mix"),
        )
    )
    return chosen.orderBy("mix_key", "doc_id", "copy"), shares
