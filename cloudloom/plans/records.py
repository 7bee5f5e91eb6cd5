"""Queries over the record tables: implausible readings, heavy keys, proximity, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.operators import drift, proximity, spikes, treeagg
from cloudloom.plans import drift_sql
from cloudloom.runtime import table

#: Distance under which two points are near each other, in raw units.
NEAR_UNITS = 25
#: Shares of all points above which a value is a heavy one.
HEAVY = {"classification": 0.10, "point_source_ID": 0.04}
#: Readings of a season that p1_flags looks for.
PERIOD = 10


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible(table(spark, sf_dir, "las_points"), only_spikes=True).select("point_id", "field_name")


def p1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading beyond the ESD limit of its source, impossible or stuck, with what is wrong with it; seasons of ``PERIOD`` readings are taken out."""
    return spikes.implausible(table(spark, sf_dir, "las_points"), period=PERIOD)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = treeagg.per_value(table(spark, sf_dir, "las_points"), list(HEAVY), "point_id")
    return treeagg.heavy_values(per, HEAVY).select("field_name", "key_value")


def p3_per_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the range and sum of Z and intensity for every value of both key fields."""
    return treeagg.per_value(table(spark, sf_dir, "las_points"), list(HEAVY), "point_id", ["Z", "intensity"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.neighbours_and_zones(table(spark, sf_dir, "las_points"), table(spark, sf_dir, "zones"), NEAR_UNITS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "header_dumps"), table(spark, sf_dir, "las_headers"))


def p5_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable dumps as one table with the columns of las_headers (time of arrival in microseconds), their version and what could not be cast."""
    flat = drift.conform(table(spark, sf_dir, "header_dumps"), table(spark, sf_dir, "las_headers"))
    return flat.withColumn("received_us", F.unix_micros("received_at")).drop("received_at")


def p5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema versions as they came: per feed, each fingerprint with its shape, first dump and number of dumps."""
    return drift.versions(table(spark, sf_dir, "header_dumps"), table(spark, sf_dir, "las_headers"))


def p5_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored migrations: the steps of every pair of versions met one after the other in a feed."""
    return drift.all_migrations(table(spark, sf_dir, "header_dumps"), table(spark, sf_dir, "las_headers"))


def p5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rename, default and cast rules of every version."""
    return drift.rules(table(spark, sf_dir, "header_dumps"), table(spark, sf_dir, "las_headers"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_flags, p3_found, p3_per_value, p4_found, p5_found, p5_headers, p5_versions, p5_migrations, p5_rules)
}

_ONCE = "WITH pts AS (SELECT DISTINCT point_id, file_id, point_index, X, Y, Z, intensity, classification, point_source_ID FROM las_points)"

SQL = {
    "p1_found": _ONCE
    + """
, r AS (
  SELECT 'Z' AS field_name, point_source_ID AS src, file_id, point_index, point_id, CAST(Z AS BIGINT) AS v, -50000 AS lo, 900000 AS hi
    FROM pts WHERE Z IS NOT NULL AND point_source_ID IS NOT NULL
  UNION ALL
  SELECT 'intensity', point_source_ID, file_id, point_index, point_id, CAST(intensity AS BIGINT), 0, 65535
    FROM pts WHERE intensity IS NOT NULL AND point_source_ID IS NOT NULL),
n AS (SELECT *, row_number() OVER s AS rn,
        median(v) OVER (s ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS lev,
        max(v) OVER (s ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS top, min(v) OVER (s ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS low,
        count(*) OVER (s ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS left_
      FROM r WINDOW s AS (PARTITION BY field_name, src, file_id ORDER BY point_index)),
sc AS (SELECT field_name, src, greatest(1.0::DOUBLE, 1.4826::DOUBLE * median(abs(v - lev))) AS scatter FROM n GROUP BY ALL),
st AS (SELECT n.* FROM n JOIN sc USING (field_name, src) WHERE scatter > 2 AND left_ = 20 AND top - v <= 1 AND v - low <= 1),
en AS (SELECT st.field_name, st.src, st.file_id, st.rn, min(n.rn) AS stop FROM st LEFT JOIN n
         ON n.field_name = st.field_name AND n.src = st.src AND n.file_id = st.file_id AND n.rn > st.rn AND abs(n.v - st.v) > 1
       GROUP BY ALL)
SELECT DISTINCT n.point_id, n.field_name FROM n JOIN sc USING (field_name, src)
WHERE n.v < lo OR n.v > hi OR abs(n.v - lev) > 10 * scatter
   OR EXISTS (SELECT 1 FROM en WHERE en.field_name = n.field_name AND en.src = n.src AND en.file_id = n.file_id
              AND en.rn <= n.rn AND (en.stop IS NULL OR n.rn < en.stop))""",
    "p1_flags": _ONCE
    + f"""
, r AS (
  SELECT 'Z' AS field_name, point_source_ID AS src, file_id, point_index, point_id, CAST(Z AS BIGINT) AS v, -50000 AS lo, 900000 AS hi
    FROM pts WHERE Z IS NOT NULL AND point_source_ID IS NOT NULL
  UNION ALL
  SELECT 'intensity', point_source_ID, file_id, point_index, point_id, CAST(intensity AS BIGINT), 0, 65535
    FROM pts WHERE intensity IS NOT NULL AND point_source_ID IS NOT NULL),
n AS (SELECT *, row_number() OVER s AS rn, (row_number() OVER s - 1) % {PERIOD} AS phase,
        2 * v - 2 * median(v) OVER (s ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS away,
        max(v) OVER (s ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS top, min(v) OVER (s ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS low,
        count(*) OVER (s ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS left_
      FROM r WINDOW s AS (PARTITION BY field_name, src, file_id ORDER BY point_index)),
usual AS (SELECT field_name, src, greatest(1.0::DOUBLE, 1.4826::DOUBLE * median(abs(away)) / 2) AS usual FROM n GROUP BY ALL),
ph AS (SELECT field_name, src, file_id, phase, median(away) AS mid, count(*) AS c FROM n GROUP BY ALL),
season AS (SELECT field_name, src, file_id, phase, round_even(mid, 0) AS season FROM ph JOIN usual USING (field_name, src)
           WHERE c >= 8 AND abs(mid) / 2 > 5::DOUBLE * 1.2533::DOUBLE * usual / sqrt(c)),
d AS (SELECT n.*, coalesce(season, 0) AS season, away - coalesce(season, 0) AS res FROM n LEFT JOIN season USING (field_name, src, file_id, phase)),
sc AS (SELECT field_name, src, count(*) AS n, greatest(1.0::DOUBLE, 1.4826::DOUBLE * median(abs(res)) / 2) AS scatter FROM d GROUP BY ALL),
ranked AS (SELECT field_name, src, abs(res) AS size, n::DOUBLE AS n, scatter, (count(*) OVER (PARTITION BY field_name, src ORDER BY abs(res) DESC))::DOUBLE AS i
           FROM d JOIN sc USING (field_name, src)),
q AS (SELECT *, sqrt(-2 * ln(0.05::DOUBLE / (2 * (n - i + 1)))) AS q FROM ranked WHERE n > 2 AND i <= floor(n / 2)),
z AS (SELECT *, n - i - 1 AS free, -(((((-7.784894002430293e-03 * q - 3.223964580411365e-01) * q - 2.400758277161838e+00) * q - 2.549732539343734e+00) * q + 4.374664141464968e+00) * q + 2.938163982698783e+00)
        / ((((7.784695709041462e-03 * q + 3.224671290700398e-01) * q + 2.445134137142996e+00) * q + 3.754408661907416e+00) * q + 1) AS z FROM q),
t AS (SELECT *, z + (z ** 3 + z) / (4 * free) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * free ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * free ** 3) AS t FROM z),
esd AS (SELECT field_name, src, min(size) AS from_ FROM t WHERE size / 2 / scatter > (n - i) * t / sqrt((free + t * t) * (n - i + 1)) GROUP BY ALL),
st AS (SELECT d.* FROM d JOIN sc USING (field_name, src) WHERE scatter > 2 AND left_ = 20 AND top - v <= 1 AND v - low <= 1),
en AS (SELECT st.field_name, st.src, st.file_id, st.rn, min(n.rn) AS stop FROM st LEFT JOIN n
         ON n.field_name = st.field_name AND n.src = st.src AND n.file_id = st.file_id AND n.rn > st.rn AND abs(n.v - st.v) > 1
       GROUP BY ALL),
f AS (SELECT d.point_id, d.field_name, d.src AS "point_source_ID", d.v < d.lo OR d.v > d.hi AS is_impossible, coalesce(abs(d.res) >= esd.from_, false) AS is_outlier,
        coalesce(abs(d.res) >= esd.from_, false) AND abs(d.res) / 2 > 10 * sc.scatter AS is_spike,
        EXISTS (SELECT 1 FROM en WHERE en.field_name = d.field_name AND en.src = d.src AND en.file_id = d.file_id AND en.rn <= d.rn AND (en.stop IS NULL OR d.rn < en.stop)) AS is_stuck,
        d.res / 2 AS residual, d.season / 2 AS season, sc.scatter, esd.from_ / 2 AS outlier_from
      FROM d JOIN sc USING (field_name, src) LEFT JOIN esd USING (field_name, src))
SELECT * FROM f WHERE is_impossible OR is_outlier OR is_stuck""",
    "p3_found": _ONCE
    + """
, k AS (SELECT 'classification' AS field_name, CAST(classification AS BIGINT) AS key_value, 0.10::DOUBLE AS lim FROM pts
        UNION ALL SELECT 'point_source_ID', CAST(point_source_ID AS BIGINT), 0.04::DOUBLE FROM pts),
c AS (SELECT field_name, key_value, lim, count(*) AS n, (SELECT count(*) FROM pts) AS total FROM k GROUP BY ALL)
SELECT field_name, key_value FROM c WHERE key_value IS NOT NULL AND n > lim * total""",
    "p3_per_value": _ONCE
    + """
, k AS (SELECT 'classification' AS field_name, CAST(classification AS BIGINT) AS key_value, Z, intensity FROM pts
        UNION ALL SELECT 'point_source_ID', CAST(point_source_ID AS BIGINT), Z, intensity FROM pts)
SELECT field_name, key_value, CAST(count(*) AS BIGINT) AS "rows",
  CAST(count(Z) AS BIGINT) AS "n_Z", CAST(sum(Z) AS BIGINT) AS "sum_Z", min(Z) AS "min_Z", max(Z) AS "max_Z",
  CAST(count(intensity) AS BIGINT) AS n_intensity, CAST(sum(intensity) AS BIGINT) AS sum_intensity,
  min(intensity) AS min_intensity, max(intensity) AS max_intensity
FROM k GROUP BY field_name, key_value""",
    "p4_found": _ONCE
    + """
, q AS (SELECT point_id, CAST(X AS BIGINT) AS x, CAST(Y AS BIGINT) AS y, CAST(floor(X / 25.0) AS BIGINT) AS cx, CAST(floor(Y / 25.0) AS BIGINT) AS cy
        FROM pts WHERE X IS NOT NULL AND Y IS NOT NULL),
o AS (SELECT q.point_id, q.x, q.y, q.cx + a.d AS cx, q.cy + b.d AS cy FROM q, (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d))
SELECT 'near' AS kind, l.point_id AS left_id, r.point_id AS right_id FROM q l JOIN o r ON l.cx = r.cx AND l.cy = r.cy
WHERE l.point_id < r.point_id AND (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) < 625
UNION ALL
SELECT 'inside', z.zone_id, q.point_id FROM q JOIN zones z ON
  (z.shape = 'rect' AND q.x >= z.min_x AND q.x < z.max_x AND q.y >= z.min_y AND q.y < z.max_y)
  OR (z.shape = 'circle' AND (q.x - z.centre_x) * (q.x - z.centre_x) + (q.y - z.centre_y) * (q.y - z.centre_y) < CAST(z.radius AS BIGINT) * z.radius)""",
}
SQL |= drift_sql.SQL
