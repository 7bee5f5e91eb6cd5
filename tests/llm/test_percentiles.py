"""Percentiles against sorted values."""

import random

import numpy as np
from pyspark.sql import functions as F

from cloudloom.llm import quantiles

POINTS = "point_id long, file_id long, classification short, Z int, sketch string"


def cloud(spark, rows):
    return spark.createDataFrame([(r["point_id"], r["file_id"], r["classification"], r["Z"], "other") for r in rows], POINTS)


def test_percentiles(spark):
    rng = random.Random(3)
    rows = [{"point_id": i, "classification": rng.choice((1, 1, 1, 1, 2)), "file_id": i % 7, "Z": rng.randint(-(10**6), 10**6)} for i in range(30000)]
    rows += [dict(rows[0]), {"point_id": 99999, "classification": 1, "file_id": 1, "Z": None}, {"point_id": 99998, "classification": None, "file_id": 1, "Z": 4}]
    once = quantiles.once(cloud(spark, rows), "point_id", ["file_id", "classification", "Z"])
    parts = quantiles.sketches(once.where("classification is not null"), "Z", ["classification", "file_id"], k=400)
    whole = quantiles.percentiles(quantiles.merge(parts, ["classification"], k=400), (0.01, 0.5, 0.99)).collect()
    bound = quantiles.rank_error(400)
    for r in whole:
        v = np.sort([x["Z"] for x in rows[:30000] if x["classification"] == r.classification])
        assert r.n == len(v) and (r.lowest, r.highest) == (v[0], v[-1])
        for share, got in ((0.01, r.p1), (0.5, r.p50), (0.99, r.p99)):
            assert abs(np.searchsorted(v, got) / len(v) - share) < 2 * bound
    assert quantiles.sketches(once.limit(0), "Z", ["classification"]).count() == 0
    assert quantiles.rank_error() < 0.0014


def test_bounds_are_checked(spark):
    rows = [{"point_id": i, "classification": i % 2, "file_id": i % 5, "Z": i // 2 if i % 2 else 7} for i in range(8000)]
    df = cloud(spark, rows)
    answers = quantiles.percentiles(quantiles.sketches(df, "Z", ["classification"], k=200), (0.05, 0.5))
    good = {r.classification: r for r in quantiles.within_bound(df, answers, "Z", "classification", (0.05, 0.5), k=200).collect()}
    assert all(r.n == 4000 and r.p5_ok and r.p50_ok for r in good.values()) and len(good) == 2
    off = quantiles.within_bound(df, answers.withColumn("p50", F.col("p50") + 500), "Z", "classification", (0.05, 0.5), k=200).collect()
    assert all(r.p5_ok and not r.p50_ok for r in off)
    assert quantiles.within_bound(df.limit(0), answers.limit(0), "Z", "classification", (0.5,)).count() == 0
