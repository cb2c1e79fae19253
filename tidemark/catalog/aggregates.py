"""Aggregations, rankings, set operations and cohort statistics: A1-A20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog import query
from tidemark.catalog.fragments import COMPANIES, FACTS, FILINGS, ISSUERS, SCORES, VERSIONS, WIDE
from tidemark.catalog.governed import CATALOG
from tidemark.config import SCORE_MEASURES
from tidemark.functions.exprs import safe_ratio
from tidemark.operators import relational as r
from tidemark.operators import stats

GROUP = ["fy", "metric_key"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name).cast("double"), 6) for name in names})


@query(
    "a1_grouped_having",
    f"""WITH {COMPANIES}, {SCORES} SELECT sector, fy, score_key AS measure, count(*) AS company_count,
      round(CAST(sum(value) AS DOUBLE) / count(*), 4) AS average_value
    FROM scores JOIN companies USING (company_id) WHERE method_version = (SELECT max(method_version) FROM scores)
    GROUP BY 1, 2, 3 HAVING count(*) >= 5 ORDER BY 1, 2, 3""",
)
def _a1(spark: SparkSession, d: str) -> DataFrame:
    rows = r.aggregate_dataset(b.scores(spark, d), b.companies(spark, d), SCORE_MEASURES)
    return rows.withColumn("average_value", F.col("average_value").cast("double")).orderBy("sector", "fy", "measure")


@query(
    "a2_conditional_coverage",
    f"""WITH {ISSUERS}, {FILINGS} SELECT sector, mcap_band, count(*) AS companies, count(*) FILTER (WHERE status = 'fetched') AS fetched,
      round_even(count(*) FILTER (WHERE status = 'fetched') * 100.0::DOUBLE / count(*), 2) AS coverage_percent
    FROM issuers i LEFT JOIN filings f ON f.company_id = i.company_id AND f.fy = 1997
    GROUP BY GROUPING SETS ((sector, mcap_band), ())""",
)
def _a2(spark: SparkSession, d: str) -> DataFrame:
    return r.coverage(b.issuers(spark, d), b.filings(spark, d), 1997)


@query("a3_simple_counts", "SELECT p_type, count(*) AS fields FROM part GROUP BY 1")
def _a3(spark: SparkSession, d: str) -> DataFrame:
    return r.count_by(b.table(spark, d, "part"), "p_type", "fields")


@query(
    "a4_usage_since_month_start",
    """SELECT CAST(user_id % 20 AS BIGINT) AS org_id,
      CAST(coalesce(sum(CASE WHEN ts >= TIMESTAMP '2024-01-29' AND event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END), 0) AS BIGINT) AS used
    FROM events GROUP BY 1""",
)
def _a4(spark: SparkSession, d: str) -> DataFrame:
    ledger = b.table(spark, d, "events").withColumn("org_id", F.col("user_id") % 20)
    tokens = F.when(F.col("event_type") == "purchase", F.floor("value"))
    return r.usage_since(ledger, "org_id", tokens, F.col("ts"), "2024-01-29")


@query(
    "a5_next_version",
    f"WITH {VERSIONS} SELECT filing_id, field_key, max(version) + 1 AS next_version FROM versions GROUP BY 1, 2",
)
def _a5(spark: SparkSession, d: str) -> DataFrame:
    return r.next_versions(b.versions(spark, d), ["filing_id", "field_key"])


@query(
    "a7_most_common",
    "SELECT event_type, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1",
)
def _a7(spark: SparkSession, d: str) -> DataFrame:
    return r.count_by(b.table(spark, d, "events"), "event_type")


@query(
    "a8_five_number_summary",
    f"""WITH {FACTS} SELECT fy, metric_key, count(*) AS n, CAST(min(value) AS DOUBLE) AS min, CAST(max(value) AS DOUBLE) AS max,
      round(quantile_cont(CAST(value AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS median,
      round(quantile_cont(CAST(value AS DOUBLE), 0.75), 6) AS q3, CAST(sum(value) AS DOUBLE) AS total,
      round(CAST(sum(value) AS DOUBLE) / count(*), 6) AS mean,
      round(quantile_cont(CAST(value AS DOUBLE), 0.75) - quantile_cont(CAST(value AS DOUBLE), 0.25), 6) AS iqr
    FROM facts GROUP BY 1, 2""",
)
def _a8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.five_number_summary(b.facts(spark, d), GROUP, "value"), "q1", "median", "q3", "mean", "iqr")


@query(
    "a9_at_or_below_percentile",
    f"""WITH {FACTS} SELECT company_id, fy, metric_key,
      round(cume_dist() OVER (PARTITION BY fy, metric_key ORDER BY value) * 100, 6) AS percentile FROM facts""",
)
def _a9(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.at_or_below_rank(b.facts(spark, d), GROUP, "value")
    return rounded(rows.select("company_id", "fy", "metric_key", "percentile"), "percentile")


@query(
    "a10_safe_ratio",
    f"""WITH {WIDE} SELECT company_id, fy, round(CAST(revenue AS DOUBLE) / nullif(CAST(qty AS DOUBLE) * (company_id % 3), 0), 6) AS ratio FROM wide""",
)
def _a10(spark: SparkSession, d: str) -> DataFrame:
    reference = F.col("qty").cast("double") * (F.col("company_id") % 3)
    rows = b.wide_facts(spark, d).select("company_id", "fy", safe_ratio(F.col("revenue"), reference).alias("ratio"))
    return rounded(rows, "ratio")


@query(
    "a11_top_share",
    f"""WITH {FACTS}, o AS (SELECT fy, metric_key, value, row_number() OVER (PARTITION BY fy, metric_key ORDER BY value DESC) AS k
      FROM facts WHERE value >= 0)
    SELECT fy, metric_key, count(*) AS n, CASE WHEN count(*) > 3 AND sum(value) > 0 THEN
      round(CAST(sum(value) FILTER (WHERE k <= 3) AS DOUBLE) / CAST(sum(value) AS DOUBLE) * 100, 6) END AS share FROM o GROUP BY 1, 2""",
)
def _a11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.top_share(b.facts(spark, d), GROUP, "value", 3), "share")


@query(
    "a12_histogram",
    f"""WITH {FACTS}, x AS (SELECT fy, metric_key, CAST(value AS DOUBLE) AS x FROM facts),
    e AS (SELECT fy, metric_key, min(x) AS lo, max(x) AS hi, CASE WHEN min(x) = max(x) THEN 1 ELSE 8 END AS bins FROM x GROUP BY 1, 2),
    w AS (SELECT *, (hi - lo) / bins AS width FROM e),
    f AS (SELECT w.*, CAST(bin AS INTEGER) AS bin FROM w, unnest(range(w.bins)) AS t(bin)),
    c AS (SELECT x.fy, x.metric_key, CASE WHEN bins = 1 THEN 0 ELSE CAST(least(bins - 1, floor((x - lo) / width)) AS INTEGER) END AS bin,
      count(*) AS n FROM x JOIN w ON w.fy = x.fy AND w.metric_key = x.metric_key GROUP BY 1, 2, 3)
    SELECT f.fy, f.metric_key, f.bin, round(lo + f.bin * width, 6) AS "from",
      round(CASE WHEN bins = 1 THEN hi ELSE lo + (f.bin + 1) * width END, 6) AS "to", coalesce(n, 0) AS count
    FROM f LEFT JOIN c ON c.fy = f.fy AND c.metric_key = f.metric_key AND c.bin = f.bin""",
)
def _a12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.histogram(b.facts(spark, d), GROUP, "value", 8), "from", "to")


@query(
    "a13_first_to_last_change",
    f"""WITH {FACTS}, e AS (SELECT company_id, metric_key, count(*) AS points, CAST(min_by(value, fy) AS DOUBLE) AS a,
      CAST(max_by(value, fy) AS DOUBLE) AS z FROM facts GROUP BY 1, 2)
    SELECT company_id, metric_key, points, round(z - a, 6) AS absolute, round((z - a) / nullif(abs(a), 0) * 100, 6) AS percent
    FROM e WHERE points >= 2""",
)
def _a13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.first_to_last(b.facts(spark, d), ["company_id", "metric_key"], "value", "fy"), "absolute", "percent")


DELTA = "round(CAST(value AS DOUBLE) - median(CAST(value AS DOUBLE)) OVER (PARTITION BY fy, metric_key), 6) AS delta_to_median"
CONTEXT = f"{DELTA}, round(cume_dist() OVER (PARTITION BY fy, metric_key ORDER BY value) * 100, 6) AS percentile"


@query(
    "a14_row_context",
    f"""WITH {FACTS} SELECT company_id, fy, metric_key, {CONTEXT},
      CASE WHEN sum(value) OVER (PARTITION BY fy, metric_key) > 0 AND metric_key IN ('qty', 'revenue') THEN
      round(CAST(value AS DOUBLE) / CAST(sum(value) OVER (PARTITION BY fy, metric_key) AS DOUBLE) * 100, 6) END AS share_of_total
    FROM facts""",
)
def _a14(spark: SparkSession, d: str) -> DataFrame:
    additive = F.col("metric_key").isin([k for k, measure in CATALOG.measures.items() if measure.additive])
    rows = stats.row_context(b.facts(spark, d), GROUP, "value", additive)
    return rounded(rows.drop("value", "pin_id"), "delta_to_median", "percentile", "share_of_total")


@query(
    "a15_leading_row",
    f"""WITH {FACTS} SELECT fy, metric_key, company_id, CAST(value AS DOUBLE) AS value FROM facts
    QUALIFY row_number() OVER (PARTITION BY fy, metric_key ORDER BY value, company_id) = 1""",
)
def _a15(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.leading_row(b.facts(spark, d), GROUP, "value", "company_id", ascending=True)
    return rows.select(*GROUP, "company_id", F.col("value").cast("double").alias("value"))


@query(
    "a16_insight_flags",
    f"""WITH {COMPANIES}, {FACTS}, g AS (SELECT fy, industry, avg(CAST(value AS DOUBLE)) AS value, count(*) < 5 AS thin
      FROM facts JOIN companies USING (company_id) WHERE metric_key = 'revenue' GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY value DESC) AS k FROM g),
    s AS (SELECT industry, count(*) AS n, median(value) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
      min(value) AS lo, max(value) AS hi, sum(value) AS total, sum(value) FILTER (WHERE k <= 3) AS top3,
      min_by(value, fy) AS a, max_by(value, fy) AS z, count(*) FILTER (WHERE thin) AS thin_rows FROM k GROUP BY 1)
    SELECT industry, n, round(median, 4) AS median, round(q1, 4) AS q1, round(q3, 4) AS q3, lo > 0 AND hi / lo >= 1.5 AS has_range,
      round(CASE WHEN lo > 0 AND hi / lo >= 1.5 THEN hi / lo END, 4) AS span, n > 3 AND total > 0 AS has_concentration,
      round(CASE WHEN n > 3 AND total > 0 THEN top3 / total * 100 END, 4) AS top3_share, a <> 0 AS has_trend,
      round((z - a) / nullif(abs(a), 0) * 100, 4) AS trend_percent, thin_rows, thin_rows > 0 AS has_thin, true AS has_scale_caution
    FROM s WHERE n >= 2""",
)
def _a16(spark: SparkSession, d: str) -> DataFrame:
    revenue = b.facts(spark, d).where("metric_key = 'revenue'").join(b.companies(spark, d), "company_id")
    series = revenue.groupBy("fy", "industry").agg(
        F.avg(F.col("value").cast("double")).alias("value"), (F.count(F.lit(1)) < 5).alias("thin")
    )
    flags = stats.insight_flags(
        series, ["industry"], "value", order="fy", thin="thin", additive=True, polarity="neutral", timeseries=True
    )
    names = ("median", "q1", "q3", "span", "top3_share", "trend_percent")
    return flags.withColumns({name: F.round(name, 4) for name in names})


@query(
    "a17_deviation_from_median",
    f"WITH {FACTS} SELECT company_id, fy, metric_key, {DELTA} FROM facts",
)
def _a17(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.deviation_from_median(b.facts(spark, d), GROUP, "value")
    return rounded(rows.drop("value", "pin_id"), "delta_to_median")


@query(
    "a18_measure_registry",
    f"""WITH {FACTS}, reg(metric_key, additive, polarity) AS (VALUES ('qty', true, 'neutral'), ('revenue', true, 'neutral'),
      ('discount', false, 'down'), ('tax', false, 'down'))
    SELECT metric_key, additive, polarity, count(*) AS n, CASE WHEN additive THEN CAST(sum(value) AS DOUBLE) END AS total
    FROM facts JOIN reg USING (metric_key) GROUP BY 1, 2, 3""",
)
def _a18(spark: SparkSession, d: str) -> DataFrame:
    registry = r.measure_registry(spark, CATALOG.measures)
    rows = b.facts(spark, d).join(F.broadcast(registry), "metric_key")  # the measure catalogue
    total = F.when(F.col("additive"), F.sum("value").cast("double"))
    return rows.groupBy("metric_key", "additive", "polarity").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


@query(
    "a19_upsert_delete_update",
    """WITH cur AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS status FROM orders WHERE o_orderkey % 4 <> 3),
    chg AS (SELECT o_orderkey AS id, o_custkey AS owner, 'X' AS status FROM orders WHERE o_orderkey % 4 >= 2),
    ups AS (SELECT * FROM cur WHERE id NOT IN (SELECT id FROM chg) UNION ALL SELECT * FROM chg)
    SELECT id, owner, CASE WHEN owner % 10 = 1 AND status = 'O' THEN 'U' ELSE status END AS status FROM ups
    WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 50000)""",
)
def _a19(spark: SparkSession, d: str) -> DataFrame:
    orders = b.table(spark, d, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status")
    )
    changes = rows.where("id % 4 >= 2").withColumn("status", F.lit("X"))
    table = r.upsert(rows.where("id % 4 <> 3"), changes, ["id"])
    table = r.delete_keys(table, orders.where("o_totalprice < 50000").select(F.col("o_orderkey").alias("id")), ["id"])
    return r.update_where(table, F.expr("owner % 10 = 1 AND status = 'O'"), status=F.lit("U"))


@query(
    "a20_key_set_operations",
    """WITH p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
    r AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
    SELECT coalesce(p.k, r.k) AS k, CASE WHEN p.k IS NOT NULL AND r.k IS NOT NULL THEN 'both'
      WHEN p.k IS NOT NULL THEN 'present_only' ELSE 'reference_only' END AS side FROM p FULL JOIN r ON p.k = r.k""",
)
def _a20(spark: SparkSession, d: str) -> DataFrame:
    present = b.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    core = b.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return r.key_sets(present, core, ["k"])
