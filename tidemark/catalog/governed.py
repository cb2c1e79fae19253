"""Governed query language: Q1-Q15."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog import query
from tidemark.catalog.fragments import COMPANIES, SCORES, STAR
from tidemark.config import COHORT_LABEL, TIERS_PAID
from tidemark.plans import semantic as s
from tidemark.plans import store

CATALOG = s.Catalog(
    measures={
        "qty": s.Measure("metric", additive=True, polarity="neutral"),
        "revenue": s.Measure("metric", additive=True, polarity="neutral"),
        "discount": s.Measure("metric", tiers=TIERS_PAID, polarity="down"),
        "tax": s.Measure("metric", tiers=TIERS_PAID, polarity="down"),
        "completeness": s.Measure("score"),
        "substance": s.Measure("score"),
        "assurance_readiness": s.Measure("score"),
    }
)

ROUNDED = "round(value, 6) AS value"


def ask(spark: SparkSession, d: str, spec: dict[str, Any], tier: str = "research") -> DataFrame:
    result = s.semantic_query(
        b.long_metrics(spark, d), b.scores(spark, d), b.companies(spark, d), spec, tier, CATALOG
    )
    assert result.data is not None
    return result.data.withColumn("value", F.round("value", 6))


def ask_store(spark: SparkSession, d: str, spec: dict[str, Any], tier: str = "research") -> DataFrame:
    """The same question, answered from the materialised facts."""
    result = store.answer(b.governed_facts(spark, d), spec, tier, CATALOG)
    assert result.data is not None
    return result.data.withColumn("value", F.round("value", 6))


def eq(dimension: str, value: Any) -> dict[str, Any]:
    return {"dimension": dimension, "operator": "eq", "value": value}


def grouped_sql(measure: str, dims: str, where: str, order: str, limit: int, extra: str = "") -> str:
    return f"""SELECT {dims}, round(CAST(avg(value) AS DOUBLE), 6) AS value, count(*) AS cohort_n,
      CAST(NULL AS VARCHAR) AS pin_id, '{measure}' AS measure, count(*) < 5 AS thin_cohort {extra}
    FROM facts JOIN companies USING (company_id)
    WHERE metric_key = '{measure}' AND {where} GROUP BY {dims} ORDER BY {order} LIMIT {limit}"""


@query(
    "q5_grouped_average",
    f"WITH {STAR} " + grouped_sql("revenue", "industry", "fy = 1998", "avg(value) DESC, industry", 20),
)
def _grouped(spark: SparkSession, d: str) -> DataFrame:
    spec = {"measures": ["revenue"], "dimensions": ["industry"], "filters": [eq("fy", 1998)],
            "shape": "distribution", "limit": 20}
    return ask_store(spark, d, spec)


@query(
    "q2_filter_operators",
    f"WITH {STAR} "
    + grouped_sql(
        "qty",
        "sector, fy",
        "sector IN ('ASIA', 'EUROPE', 'AFRICA') AND fy >= 1996 AND fy <= 2000 AND fy BETWEEN 1997 AND 2001"
        " AND mcap_band = 'mid'",
        "avg(value) DESC, sector, fy",
        250,
    ),
)
def _filters(spark: SparkSession, d: str) -> DataFrame:
    spec = {
        "measures": ["qty"],
        "dimensions": ["sector", "fy"],
        "filters": [
            {"dimension": "sector", "operator": "in", "value": ["ASIA", "EUROPE", "AFRICA"]},
            {"dimension": "fy", "operator": "gte", "value": 1996},
            {"dimension": "fy", "operator": "lte", "value": 2000},
            {"dimension": "fy", "operator": "between", "value": [1997, 2001]},
            eq("mcap_band", "mid"),
        ],
        "shape": "comparison",
        "limit": 250,
    }
    return ask(spark, d, spec)


LATEST = "method_version = (SELECT max(method_version) FROM scores)"


@query(
    "q3_score_band_filter",
    f"""WITH {COMPANIES}, {SCORES} SELECT sector, round(CAST(avg(value) AS DOUBLE), 6) AS value, count(*) AS cohort_n,
      CAST(NULL AS VARCHAR) AS pin_id, 'substance' AS measure, count(*) < 5 AS thin_cohort
    FROM scores JOIN companies USING (company_id)
    WHERE score_key = 'substance' AND {LATEST} AND value BETWEEN 30 AND 35 GROUP BY sector""",
)
def _score_band(spark: SparkSession, d: str) -> DataFrame:
    band = {"dimension": "completeness", "operator": "score_band", "value": [30, 35]}
    spec = {"measures": ["substance"], "dimensions": ["sector"], "filters": [band], "shape": "distribution"}
    return ask(spark, d, spec)


@query(
    "q4_dimension_projection",
    f"""WITH {STAR} SELECT sector, industry, mcap_band, 'materialised' AS assurance_status,
      round(CAST(avg(value) AS DOUBLE), 6) AS value, count(*) AS cohort_n, CAST(NULL AS VARCHAR) AS pin_id,
      'tax' AS measure, count(*) < 5 AS thin_cohort
    FROM facts JOIN companies USING (company_id) WHERE metric_key = 'tax'
    GROUP BY sector, industry, mcap_band ORDER BY avg(value) DESC, sector, industry, mcap_band LIMIT 250""",
)
def _projection(spark: SparkSession, d: str) -> DataFrame:
    dims = ["sector", "industry", "mcap_band", "assurance_status"]
    return ask(spark, d, {"measures": ["tax"], "dimensions": dims, "shape": "distribution", "limit": 250})


def row_sql(dims: str, measure: str, where: str, order: str, limit: int) -> str:
    return f"""SELECT {dims}, round(CAST(value AS DOUBLE), 6) AS value, CAST(NULL AS BIGINT) AS cohort_n, pin_id,
      '{measure}' AS measure, false AS thin_cohort
    FROM facts JOIN companies USING (company_id) WHERE metric_key = '{measure}' AND {where}
    ORDER BY {order} LIMIT {limit}"""


@query(
    "q6_row_level_timeseries",
    f"WITH {STAR} " + row_sql("fy, sector", "revenue", "industry = 'NATION_3'", "fy, sector, pin_id", 250),
)
def _timeseries(spark: SparkSession, d: str) -> DataFrame:
    spec = {"measures": ["revenue"], "dimensions": ["fy", "sector"], "filters": [eq("industry", "NATION_3")],
            "shape": "timeseries", "limit": 250}
    return ask(spark, d, spec)


@query(
    "q7_latest_method_version",
    f"""WITH {COMPANIES}, {SCORES} SELECT company, fy, round(CAST(value AS DOUBLE), 6) AS value,
      CAST(NULL AS BIGINT) AS cohort_n, pin_id, 'completeness' AS measure, false AS thin_cohort
    FROM scores JOIN companies USING (company_id) WHERE score_key = 'completeness' AND {LATEST}
    ORDER BY value DESC, company, fy, pin_id LIMIT 40""",
)
def _latest(spark: SparkSession, d: str) -> DataFrame:
    spec = {"measures": ["completeness"], "dimensions": ["company", "fy"], "shape": "ranking", "limit": 40}
    return ask(spark, d, spec)


@query(
    "q8_multi_measure",
    f"""WITH {STAR}, {SCORES} SELECT * FROM ({grouped_sql("qty", "sector", "true", "avg(value) DESC, sector", 3)})
    UNION ALL SELECT * FROM ({grouped_sql("tax", "sector", "true", "avg(value) DESC, sector", 3)})
    UNION ALL SELECT * FROM (SELECT sector, round(CAST(avg(value) AS DOUBLE), 6), count(*), NULL, 'substance',
      count(*) < 5 FROM scores JOIN companies USING (company_id) WHERE score_key = 'substance' AND {LATEST}
      GROUP BY sector ORDER BY avg(value) DESC, sector LIMIT 3)""",
)
def _multi(spark: SparkSession, d: str) -> DataFrame:
    spec = {"measures": ["qty", "tax", "substance"], "dimensions": ["sector"], "shape": "comparison", "limit": 3}
    return ask_store(spark, d, spec)


@query(
    "q9_thin_cohort_notice",
    f"""WITH {STAR}, r AS ({grouped_sql("revenue", "industry, mcap_band", "fy = 1999",
        "avg(value) DESC, industry, mcap_band", 250)})
    SELECT count(*) AS thin_rows, min(cohort_n) AS n_min, max(cohort_n) AS n_max FROM r WHERE thin_cohort""",
)
def _thin(spark: SparkSession, d: str) -> DataFrame:
    spec = {"measures": ["revenue"], "dimensions": ["industry", "mcap_band"], "filters": [eq("fy", 1999)],
            "shape": "distribution", "limit": 250}
    return s.thin_notice(ask(spark, d, spec))


@query(
    "q10_tier_gate",
    f"WITH {STAR} " + grouped_sql("qty", "mcap_band", "true", "avg(value) DESC, mcap_band", 25),
)
def _tier(spark: SparkSession, d: str) -> DataFrame:
    spec = {"measures": ["qty", "tax"], "dimensions": ["mcap_band"], "shape": "comparison"}
    return ask(spark, d, spec, tier="explore")


@query(
    "q11_bottom_ranking_anonymised",
    f"""WITH {STAR} SELECT '{COHORT_LABEL}' AS cohort, value, cohort_n, pin_id, measure, thin_cohort
    FROM ({row_sql("company", "revenue", "fy = 2000", "value, company, pin_id", 15)})""",
)
def _bottom(spark: SparkSession, d: str) -> DataFrame:
    rank = {"dimension": "company", "operator": "bottom_n", "value": 15}
    spec = {"measures": ["revenue"], "dimensions": ["company"], "filters": [eq("fy", 2000), rank], "shape": "ranking"}
    return ask(spark, d, spec)


@query(
    "q13_drill_down_ranking",
    f"WITH {STAR} " + row_sql("company", "qty", "fy = 1997 AND sector = 'ASIA'", "value DESC, company, pin_id", 25),
)
def _drill(spark: SparkSession, d: str) -> DataFrame:
    base = {"measures": ["qty"], "dimensions": ["sector"], "filters": [eq("fy", 1997)], "shape": "distribution"}
    return ask(spark, d, s.drill_down(base, [("sector", "ASIA")]))


@query(
    "q14_normalised_rows",
    f"""WITH {STAR}, r AS ({grouped_sql("revenue", "industry", "true", "avg(value) DESC, industry", 250)}),
    m AS (SELECT nullif(industry, 'NATION_7') AS industry, CASE WHEN industry = 'NATION_9' THEN NULL ELSE value END AS value FROM r)
    SELECT industry, value,
      coalesce(industry, 'Cohort ' || row_number() OVER (ORDER BY value DESC, industry NULLS LAST)) AS label
    FROM m WHERE value IS NOT NULL""",
)
def _normalise(spark: SparkSession, d: str) -> DataFrame:
    data = ask(spark, d, {"measures": ["revenue"], "dimensions": ["industry"], "shape": "distribution", "limit": 250})
    gaps = data.select(
        F.nullif("industry", F.lit("NATION_7")).alias("industry"),
        F.when(F.col("industry") != "NATION_9", F.col("value")).alias("value"),
    )
    return s.normalise(gaps, "industry", F.struct(-F.col("value"), F.coalesce("industry", F.lit("~"))))


@query(
    "a6_top_k_ranking",
    f"WITH {STAR} " + row_sql("company", "revenue", "fy = 1996", "value DESC, company, pin_id", 10),
)
def _top(spark: SparkSession, d: str) -> DataFrame:
    rank = {"dimension": "company", "operator": "top_n", "value": 10}
    spec = {"measures": ["revenue"], "dimensions": ["company"], "filters": [eq("fy", 1996), rank], "shape": "ranking"}
    return ask_store(spark, d, spec)


@query(
    "j2_fact_dimension_lineage",
    f"""WITH {STAR} SELECT pin_id, company_id, fy, metric_key FROM facts JOIN companies USING (company_id)
    WHERE metric_key = 'revenue' AND fy = 1996 ORDER BY value DESC, company, pin_id LIMIT 10""",
)
def _lineage(spark: SparkSession, d: str) -> DataFrame:
    return s.lineage(_top(spark, d), b.facts(spark, d).select("pin_id", "company_id", "fy", "metric_key"))


# ---- curated questions end to end: the shapes a reader starts from ----------------------------

SCORE_SQL = f"""SELECT {{dims}}, round(CAST(avg(value) AS DOUBLE), 6) AS value, count(*) AS cohort_n, CAST(NULL AS VARCHAR) AS pin_id,
  '{{key}}' AS measure, count(*) < 5 AS thin_cohort FROM scores JOIN companies USING (company_id)
  WHERE score_key = '{{key}}' AND {LATEST} AND fy = 1999 GROUP BY {{dims}} ORDER BY avg(value) {{way}}, {{dims}} LIMIT {{limit}}"""


def curated(measure: str, dims: list[str], shape: str, way: str, limit: int) -> dict[str, Any]:
    return {"measures": [measure], "dimensions": dims, "filters": [eq("fy", 1999)], "shape": shape,
            "sort": {"by": "value", "direction": way}, "limit": limit}


def curated_score(name: str, key: str, dim: str, shape: str, way: str, limit: int) -> None:
    sql = f"WITH {COMPANIES}, {SCORES} " + SCORE_SQL.format(dims=dim, key=key, way=way, limit=limit)
    query(name, sql)(lambda spark, d: ask(spark, d, curated(key, [dim], shape, way, limit), tier="explore"))


curated_score("q_most_complete_sectors", "completeness", "sector", "distribution", "desc", 20)
curated_score("q_most_substantive_sectors", "substance", "sector", "distribution", "desc", 20)
curated_score("q_readiness_gaps", "assurance_readiness", "sector", "distribution", "asc", 20)
curated_score("q_evidence_by_industry", "substance", "industry", "comparison", "desc", 20)
curated_score("q_quality_by_size_band", "completeness", "mcap_band", "comparison", "desc", 10)


def curated_ranking(name: str, key: str, limit: int) -> None:
    sql = f"WITH {STAR} " + row_sql("company", key, "fy = 1999", "value DESC, company, pin_id", limit)
    query(name, sql)(lambda spark, d: ask(spark, d, curated(key, ["company"], "ranking", "desc", limit)))


curated_ranking("q_largest_revenue_reporters", "revenue", 10)
curated_ranking("q_largest_quantity_reporters", "qty", 25)


def curated_lowest(name: str, key: str, limit: int) -> None:
    """Lower is better: the lowest rows are reported as an anonymised cohort."""
    inner = row_sql("company", key, "fy = 1999", "value, company, pin_id", limit)
    sql = f"WITH {STAR} SELECT '{COHORT_LABEL}' AS cohort, value, cohort_n, pin_id, measure, thin_cohort FROM ({inner})"
    query(name, sql)(lambda spark, d: ask(spark, d, curated(key, ["company"], "ranking", "asc", limit)))


curated_lowest("q_lowest_tax_reporters", "tax", 25)
curated_lowest("q_lowest_discount_reporters", "discount", 25)


@query(
    "q_readiness_trend",
    f"""WITH {COMPANIES}, {SCORES} SELECT fy, round(CAST(value AS DOUBLE), 6) AS value, CAST(NULL AS BIGINT) AS cohort_n, pin_id,
      'assurance_readiness' AS measure, false AS thin_cohort FROM scores WHERE score_key = 'assurance_readiness' AND {LATEST}
      AND fy BETWEEN 1998 AND 1999 ORDER BY fy, pin_id LIMIT 10""",
)
def _trend(spark: SparkSession, d: str) -> DataFrame:
    spec = {"measures": ["assurance_readiness"], "dimensions": ["fy"], "shape": "timeseries", "limit": 10,
            "filters": [{"dimension": "fy", "operator": "between", "value": [1998, 1999]}]}
    return ask(spark, d, spec, tier="explore")
