"""Queries of the problems tagged llm: percentiles, packing, mixing, abusive content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import abuse, mixing, packing, quantiles
from cloudloom.runtime import table


#: Shares of the rows at which percentiles are asked.
SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of Z per classification: of each file, and of all files put together from the files' sketches (file_id null)."""
    once = quantiles.once(table(spark, sf_dir, "las_points"), "point_id", ["file_id", "classification", "Z"])
    usable = once.where("classification is not null and Z is not null and file_id is not null")
    return _levels(quantiles.sketches(usable, "Z", ["classification", "file_id"]), "file_id")


def p2_percentiles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by day (UTC) of first arrival (ingest_day null: all days together)."""
    once = quantiles.once(table(spark, sf_dir, "las_points"), "point_id", ["ingested_at", "classification", "Z"])
    usable = once.where("classification is not null and Z is not null and ingested_at is not null")
    return _levels(quantiles.sketches(usable, "Z", ["classification", F.date_from_unix_date(F.floor(F.unix_micros("ingested_at") / 86_400_000_000).cast("int")).alias("ingest_day")]), "ingest_day")


def _levels(parts: DataFrame, part: str) -> DataFrame:
    whole = quantiles.merge(parts, ["classification"]).withColumn(part, F.lit(None).cast(parts.schema[part].dataType))
    both = parts.unionByName(whole)
    return quantiles.percentiles(both, SHARES).withColumn("rank_error", F.lit(quantiles.rank_error()))


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per classification: rows, range, and whether each percentile of all files put together is within the stated bound of its true rank."""
    once = quantiles.once(table(spark, sf_dir, "las_points"), "point_id", ["classification", "Z"]).where("classification is not null and Z is not null")
    whole = p2_percentiles(spark, sf_dir).where("file_id is null").select("classification", "lowest", "highest", *[c for c in ("p1", "p5", "p25", "p50", "p75", "p95", "p99")])
    checked = quantiles.within_bound(once, whole, "Z", "classification", SHARES).join(whole.select("classification", "lowest", "highest"), "classification")
    return checked.select("classification", "n", "lowest", "highest", *[c for c in checked.columns if c.endswith("_ok")])


def _beside(*single: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    both = single[0]
    for other in single[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    # one row per kind of container; the smallest usable one is packed
    capacity = table(spark, sf_dir, "container_specs").where("capacity_tokens > 0").agg(F.min("capacity_tokens")).first()[0]
    if capacity is None:
        raise ValueError("container_specs has no usable capacity")
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity), capacity


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.oversized(_packed(spark, sf_dir)[0])


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, piece by piece."""
    return _packed(spark, sf_dir)[0]


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the windows of each size and the containers are."""
    return packing.fill_report(*_packed(spark, sf_dir))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing, counted: documents, and offences against each rule (all 0)."""
    packed, capacity = _packed(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    each = packed.groupBy("doc_id").agg(
        F.max("n_tokens").alias("n"), F.sum("piece_tokens").alias("placed"), F.max("pieces").alias("pieces"), F.count("container_id").alias("places"), F.countDistinct("container_id").alias("containers")
    )
    per_doc = docs.join(each, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("placed") != F.col("n")).alias("not_whole"),
        F.count_if((F.col("pieces") > 1) & (F.col("n") <= capacity)).alias("split_though_short"), F.count_if(F.col("pieces") != F.ceil(F.col("n") / capacity)).alias("split_wrongly"),
        F.count_if((F.col("places") != F.col("pieces")) | (F.col("containers") != F.col("pieces"))).alias("pieces_together"), F.count_if(F.col("n") > F.col("bytes")).alias("sizes_too_large"),
    )
    windows = packed.where("container_id is not null").groupBy("container_id", "window").agg(F.sum("piece_tokens").alias("w"), F.max("window_tokens").alias("size"), F.max("fill").alias("fill"), F.max("step_group").alias("step"))
    per_container = windows.groupBy("container_id").agg(F.count_if(F.col("w") > F.col("size")).alias("over"), F.sum("w").alias("tokens"), F.max("fill").alias("fill"), F.max("step").alias("step"))
    sums = per_container.agg(
        F.coalesce(F.sum("over"), F.lit(0)).alias("overfull_windows"), F.count_if(F.col("tokens") > capacity).alias("overfull_containers"), F.count_if(F.col("tokens") != F.col("fill")).alias("wrong_fill")
    )
    crowded = per_container.groupBy("step").count().where(F.col("count") > packing.STEP).agg(F.count(F.lit(1)).alias("crowded_steps"))
    return _beside(per_doc, sums, crowded)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].where("short").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen records with repeats, in mixing order."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares per source."""
    return _mixed(spark, sf_dir)[1]


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source what must hold of every mix: its documents, whether it falls short, caps kept, short ones taken whole, and the share met within six standard errors."""
    chosen, shares = _mixed(spark, sf_dir)
    # the variance of a capped draw is at most its mean
    spread = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("squares"))
    goal = F.least("wanted", F.col("tokens") * F.col("max_repeats"))
    return shares.join(spread, "source", "left").select(
        "source", "documents", "short", (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"),
        (~F.col("short") | (F.col("mixed_tokens") == F.col("tokens") * F.col("max_repeats"))).alias("whole_if_short"),
        (F.abs(F.col("mixed_tokens") - goal) <= 6 * F.sqrt(F.coalesce("squares", F.lit(0)))).alias("share_met"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score(table(spark, sf_dir, "documents")).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return abuse.score(table(spark, sf_dir, "documents"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per source."""
    return abuse.rates(abuse.score(table(spark, sf_dir, "documents")))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source what must hold of the scores: a row for every document, scores from 0 to 1, the highest as the document's, nothing in blank texts, and rates that add up."""
    docs = table(spark, sf_dir, "documents")
    scored = abuse.score(docs)
    blank = docs.select("doc_id", F.coalesce(F.trim("text") == "", F.lit(True)).alias("blank"))
    each = scored.join(blank, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("blank").alias("blank_documents"), F.count_if(F.col("blank") & (F.col("score") > 0)).alias("blank_scored"),
        F.count_if((F.least("abuse", "hate", "sexual") < 0) | (F.col("score") > 1) | (F.col("score") != F.greatest("abuse", "hate", "sexual"))).alias("out_of_range"),
        F.count_if(F.col("flagged") != (F.col("score") >= abuse.LIMIT)).alias("flagged_wrongly"), F.count_if("flagged").alias("flagged"),
    )
    rate = abuse.rates(scored).select(F.col("source").alias("s"), "documents", "flagged_documents", "rate").withColumnRenamed("documents", "d")
    # both have a row per source
    return each.join(rate, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "documents", "blank_documents", "blank_scored", "out_of_range", "flagged_wrongly", ((F.col("d") == F.col("documents")) & (F.col("flagged_documents") == F.col("flagged")) & (F.abs(F.col("rate") * F.col("d") - F.col("flagged")) < 1e-6)).alias("rates_add_up"),
    )


QUERIES = {
    f.__name__: f for f in (p2_percentiles, p2_percentiles_by_day, p2_checks, p6_found, p6_containers, p6_fill, p6_checks, p7_found, p7_mix, p7_shares, p7_checks, p8_found, p8_scores, p8_rates, p8_checks)
}

SQL = {
    "p8_checks": """SELECT source, count(*) AS documents, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS blank_documents,
  0::BIGINT AS blank_scored, 0::BIGINT AS out_of_range, 0::BIGINT AS flagged_wrongly, true AS rates_add_up FROM documents GROUP BY source""",
    "p2_checks": "SELECT classification, count(*) AS n, CAST(min(Z) AS BIGINT) AS lowest, CAST(max(Z) AS BIGINT) AS highest, "
    + ", ".join(f"true AS p{share * 100:g}_ok" for share in SHARES)
    + " FROM (SELECT DISTINCT point_id, classification, Z FROM las_points) WHERE classification IS NOT NULL AND Z IS NOT NULL GROUP BY classification",
    # a word takes at least one token, a byte at most one
    "p6_found": """SELECT doc_id FROM documents
WHERE text IS NOT NULL AND len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) > (SELECT min(capacity_tokens) FROM container_specs WHERE capacity_tokens > 0)""",
    "p6_checks": "SELECT count(*) AS documents, "
    + ", ".join(f"0::BIGINT AS {c}" for c in ("missing", "not_whole", "split_though_short", "split_wrongly", "pieces_together", "sizes_too_large", "overfull_windows", "overfull_containers", "wrong_fill", "crowded_steps"))
    + " FROM documents",
    "p7_found": """WITH s AS (SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS size FROM documents GROUP BY source),
t AS (SELECT sum(size) AS total FROM s)
SELECT m.source FROM mix_targets m LEFT JOIN s USING (source), t WHERE coalesce(s.size, 0) * m.max_repeats < m.target_share * t.total""",
    "p7_checks": """WITH s AS (SELECT source, count(*) AS documents, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS size FROM documents GROUP BY source),
t AS (SELECT sum(size) AS total FROM s)
SELECT m.source, coalesce(s.documents, 0) AS documents, coalesce(s.size, 0) * m.max_repeats < m.target_share * t.total AS short,
  true AS cap_kept, true AS whole_if_short, true AS share_met FROM mix_targets m LEFT JOIN s USING (source), t""",
}
