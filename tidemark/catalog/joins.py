"""Joins: J1, J3-J10, J12 (J2 is with the governed query, J11 with the events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog import query
from tidemark.catalog.fragments import FILINGS, ISSUERS, SCORES, STAR, VERSIONS
from tidemark.functions.exprs import money, rule_table
from tidemark.operators import relational as r
from tidemark.operators import stats
from tidemark.operators.publication import latest_publishable


@query(
    "j1_inner_join_chain",
    """SELECT n_name, o_orderpriority, CAST(year(l_shipdate) AS INTEGER) AS fy, count(*) AS lines,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey
    JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def _j1(spark: SparkSession, d: str) -> DataFrame:
    suppliers = b.companies(spark, d).select("company_id", F.col("industry").alias("n_name"))
    lines = b.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("company_id"), "l_orderkey", "l_shipdate", money("l_extendedprice").alias("price")
    )
    orders = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return (
        lines.join(orders, "l_orderkey")
        .join(suppliers, "company_id")
        .groupBy("n_name", "o_orderpriority", F.year("l_shipdate").alias("fy"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("price").cast("double").alias("revenue"))
    )


@query(
    "j3_left_join_condition_in_on",
    f"""WITH {ISSUERS}, {FILINGS} SELECT i.company_id, i.sector, f.filing_id, coalesce(f.status, 'registered') AS status
    FROM issuers i LEFT JOIN filings f ON f.company_id = i.company_id AND f.fy = 1998""",
)
def _j3(spark: SparkSession, d: str) -> DataFrame:
    year = b.filings(spark, d).where(F.col("fy") == 1998).select("company_id", "filing_id", "status")
    joined = b.issuers(spark, d).select("company_id", "sector").join(year, "company_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("registered")))


PINS = f"""{VERSIONS}, pins AS (
  SELECT sha256(concat_ws('/', 'pin', filing_id, field_key)) AS pin_id, field_id FROM versions
  WHERE qa_status IN ('sampled_ok', 'corrected')
  QUALIFY row_number() OVER (PARTITION BY filing_id, field_key ORDER BY version DESC) = 1)"""


def pins(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.exprs import stable_key

    current = latest_publishable(b.versions(spark, d))
    return current.select(stable_key("pin", "filing_id", "field_key").alias("pin_id"), "field_id")


@query(
    "j4_lineage_lookup",
    f"""WITH {PINS}, defs(field_key, dtype) AS (VALUES ('p1.e1.urgent', 'number'), ('p1.e2.high', 'integer'),
      ('p2.e1.medium', 'text'), ('p2.e2.not_specified', 'boolean'), ('a.basics.low', 'date')),
    pages AS (SELECT doc_id AS filing_id, CAST(doc_id % 50 + 1 AS INTEGER) AS source_page, n_chars FROM documents),
    notes AS (SELECT p.pin_id, l.doc_id AS annotation_id FROM labels l JOIN pins p ON p.field_id = l.doc_id WHERE l.quality = 1)
    SELECT p.pin_id, v.filing_id, v.field_key, dtype, v.source_page, g.n_chars, n.annotation_id
    FROM pins p JOIN versions v USING (field_id) JOIN defs USING (field_key)
    LEFT JOIN pages g ON g.filing_id = v.filing_id AND g.source_page = v.source_page
    LEFT JOIN notes n ON n.pin_id = p.pin_id""",
)
def _j4(spark: SparkSession, d: str) -> DataFrame:
    dtypes = ("number", "integer", "text", "boolean", "date")
    defs = rule_table(spark, ["field_key", "dtype"], zip(b.FIELD_OF_PRIORITY.values(), dtypes, strict=True))
    current = pins(spark, d)
    pages = b.table(spark, d, "documents").select(
        F.col("doc_id").alias("filing_id"), (F.col("doc_id") % 50 + 1).cast("int").alias("source_page"), "n_chars"
    )
    labels = b.table(spark, d, "labels").select(
        F.col("doc_id").alias("field_id"),
        F.col("doc_id").alias("annotation_id"),
        F.when(F.col("quality") == 1, "published").otherwise("draft").alias("status"),
    )
    notes = labels.join(current, "field_id")
    fields = b.versions(spark, d).select("field_id", "filing_id", "field_key", "source_page")
    return r.lineage_rows(current, fields, defs, pages, notes).select(
        "pin_id", "filing_id", "field_key", "dtype", "source_page", "n_chars", "annotation_id"
    )


@query(
    "j5_composite_key_join",
    f"""WITH {STAR}, {SCORES} SELECT f.company_id, f.fy, CAST(f.value AS DOUBLE) AS revenue, CAST(s.value AS DOUBLE) AS substance
    FROM facts f JOIN scores s ON s.company_id = f.company_id AND s.fy = f.fy
    WHERE f.metric_key = 'revenue' AND s.score_key = 'substance' AND s.method_version = 'v2' AND s.value >= 33""",
)
def _j5(spark: SparkSession, d: str) -> DataFrame:
    good = b.scores(spark, d).where("score_key = 'substance' AND method_version = 'v2' AND value >= 33")
    revenue = b.facts(spark, d).where("metric_key = 'revenue'")
    return revenue.select("company_id", "fy", F.col("value").cast("double").alias("revenue")).join(
        good.select("company_id", "fy", F.col("value").cast("double").alias("substance")), ["company_id", "fy"]
    )


@query(
    "j6_score_drift",
    f"""WITH {SCORES} SELECT o.score_key, count(*) AS compared, round(CAST(avg(abs(n.value - o.value)) AS DOUBLE), 6) AS mean_absolute_drift,
      CAST(max(abs(n.value - o.value)) AS DOUBLE) AS maximum_absolute_drift
    FROM scores o JOIN scores n ON n.company_id = o.company_id AND n.fy = o.fy AND n.score_key = o.score_key
      AND n.method_version = 'v2' WHERE o.method_version = 'v1' GROUP BY 1""",
)
def _j6(spark: SparkSession, d: str) -> DataFrame:
    return r.score_drift(b.scores(spark, d), "v1", "v2").withColumn(
        "mean_absolute_drift", F.round("mean_absolute_drift", 6)
    )


@query(
    "j7_anti_join",
    "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def _j7(spark: SparkSession, d: str) -> DataFrame:
    documents = b.table(spark, d, "documents").select("doc_id", "source")
    return r.orphans(documents, b.table(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query(
    "j8_semi_join",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _j8(spark: SparkSession, d: str) -> DataFrame:
    building = b.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    orders = b.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.join(building, orders.o_custkey == building.c_custkey, "left_semi")


@query(
    "j9_inventory_counts",
    f"""WITH {ISSUERS}, {FILINGS} SELECT i.company_id, i.company, f.filing_id, f.fy, coalesce(f.status, 'registered') AS status,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = f.filing_id) AS raw_fact_count,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = f.filing_id AND l_returnflag = 'A') AS mapped_field_count
    FROM issuers i LEFT JOIN filings f ON f.company_id = i.company_id""",
)
def _j9(spark: SparkSession, d: str) -> DataFrame:
    lines = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("filing_id"), "l_returnflag")
    companies = b.issuers(spark, d).select("company_id", "company")
    return r.filing_inventory(companies, b.filings(spark, d), lines, lines.where("l_returnflag = 'A'"))


@query(
    "j10_two_measure_comparison",
    f"""WITH {STAR}, p AS (SELECT a.company_id, CAST(a.value AS DOUBLE) AS x, CAST(z.value AS DOUBLE) AS y
      FROM facts a JOIN facts z USING (company_id, fy) WHERE a.metric_key = 'revenue' AND z.metric_key = 'tax' AND fy = 1999)
    SELECT company_id, x, y, (SELECT median(x) FROM p) AS x_median, (SELECT median(y) FROM p) AS y_median FROM p
    WHERE (SELECT count(*) FROM p) >= 2""",
)
def _j10(spark: SparkSession, d: str) -> DataFrame:
    year = b.facts(spark, d).where("fy = 1999")
    side = lambda key: year.where(F.col("metric_key") == key).select(
        "company_id", F.col("value").cast("double").alias("value")
    )
    return stats.compare_measures(side("revenue"), side("tax"), "company_id")


@query(
    "j12_referential_check",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def _j12(spark: SparkSession, d: str) -> DataFrame:
    known = b.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return r.orphans(b.table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")
