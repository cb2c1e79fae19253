"""Metric materialisation: M1-M11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog import query
from tidemark.catalog.fragments import BROKEN, CANDIDATES
from tidemark.functions.exprs import money
from tidemark.operators import metrics as m
from tidemark.session import shared_dir, staged

RULES = m.MetricRules(
    additive=[m.Additive("rev_ar", ["rev_a", "rev_r"])],
    ratios=[
        m.Ratio("tax_per_qty", ["tax"], "qty", 1000),
        m.Ratio("rev_ar_share", ["rev_ar"], "revenue", 100),
        m.Ratio("an_per_qty", ["rev_a", "rev_n"], "qty", 1),
    ],
    identities=[m.Identity("revenue", ["rev_a", "rev_n", "rev_r"])],
    non_negative=["qty", "discount"],
    minimum_sector_size=5,
)

WIDE_CAND = """w AS (SELECT company_id, fy, sector,
  max(value) FILTER (WHERE metric_key = 'qty') AS qty, max(value) FILTER (WHERE metric_key = 'tax') AS tax,
  max(value) FILTER (WHERE metric_key = 'revenue') AS revenue, max(value) FILTER (WHERE metric_key = 'discount') AS discount,
  max(value) FILTER (WHERE metric_key = 'rev_a') AS rev_a, max(value) FILTER (WHERE metric_key = 'rev_n') AS rev_n,
  max(value) FILTER (WHERE metric_key = 'rev_r') AS rev_r,
  max(pin_id) FILTER (WHERE metric_key = 'qty') AS p_qty, max(pin_id) FILTER (WHERE metric_key = 'tax') AS p_tax,
  max(pin_id) FILTER (WHERE metric_key = 'revenue') AS p_revenue, max(pin_id) FILTER (WHERE metric_key = 'rev_a') AS p_a,
  max(pin_id) FILTER (WHERE metric_key = 'rev_n') AS p_n, max(pin_id) FILTER (WHERE metric_key = 'rev_r') AS p_r
  FROM cand GROUP BY 1, 2, 3)"""

DERIVED = """derived AS (
  SELECT company_id, fy, sector, 'rev_ar' AS metric_key, CAST(rev_a + rev_r AS DOUBLE) AS value, p_a AS pin_id,
         p_a || ',' || p_r AS pins FROM w WHERE rev_a IS NOT NULL AND rev_r IS NOT NULL
  UNION ALL SELECT company_id, fy, sector, 'tax_per_qty', round(CAST(tax AS DOUBLE) * 1000 / CAST(qty AS DOUBLE), 6),
         p_tax, p_tax || ',' || p_qty FROM w WHERE tax IS NOT NULL AND qty IS NOT NULL AND qty <> 0
  UNION ALL SELECT company_id, fy, sector, 'rev_ar_share',
         round(CAST(rev_a + rev_r AS DOUBLE) * 100 / CAST(revenue AS DOUBLE), 6), p_a, p_a || ',' || p_revenue
         FROM w WHERE rev_a IS NOT NULL AND rev_r IS NOT NULL AND revenue <> 0
  UNION ALL SELECT company_id, fy, sector, 'an_per_qty',
         round(CAST(rev_a + rev_n AS DOUBLE) / CAST(qty AS DOUBLE), 6), p_a, p_a || ',' || p_n || ',' || p_qty
         FROM w WHERE rev_a IS NOT NULL AND rev_n IS NOT NULL AND qty <> 0)"""

FAILED = """failed AS (
  SELECT company_id, fy, 'identity' AS screen, 'revenue' AS metric_key, CAST(revenue AS DOUBLE) AS value,
         CAST(rev_a + rev_n + rev_r AS DOUBLE) AS expected FROM w
  WHERE abs(revenue - (rev_a + rev_n + rev_r)) > 0.01 * greatest(abs(revenue), 1)
  UNION ALL SELECT company_id, fy, 'non_negative', metric_key, CAST(value AS DOUBLE), NULL FROM cand
  WHERE metric_key IN ('qty', 'discount') AND value < 0)"""

CLOSURE = """closure(failed_key, metric_key) AS (VALUES ('revenue', 'revenue'), ('revenue', 'rev_ar_share'),
  ('qty', 'qty'), ('qty', 'tax_per_qty'), ('qty', 'an_per_qty'), ('discount', 'discount')),
blocked AS (SELECT company_id, fy, c.metric_key FROM failed f JOIN closure c ON c.failed_key = f.metric_key)"""

EVERYTHING = """everything AS (
  SELECT company_id, fy, sector, metric_key, CAST(value AS DOUBLE) AS value, pin_id, pin_id AS pins FROM cand
  UNION ALL SELECT * FROM derived),
kept AS (SELECT * FROM everything e WHERE NOT EXISTS (SELECT 1 FROM blocked x WHERE x.company_id = e.company_id
  AND x.fy = e.fy AND x.metric_key = e.metric_key))"""


def midrank_sql(part: str, minimum: int = 0) -> str:
    n = f"count(*) OVER (PARTITION BY {part})"
    below = f"(rank() OVER (PARTITION BY {part} ORDER BY value) - 1)"
    same = f"count(*) OVER (PARTITION BY {part}, value)"
    return f"""CASE WHEN {n} < {minimum} THEN NULL WHEN {n} <= 1 THEN 100.0
      ELSE round_even(({below} * 2 + {same} - 1) * 50.0::DOUBLE / ({n} - 1), 4) END"""


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and arrays as text, for comparison with another engine."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind.startswith("array"):
            column = F.array_join(column, ",")
        columns.append(column.alias(name))
    return df.select(*columns)


@query("m1_candidates", f"WITH {CANDIDATES} SELECT company_id, fy, sector, metric_key, CAST(value AS DOUBLE) AS value, pin_id FROM cand")
def _m1(spark: SparkSession, d: str) -> DataFrame:
    return plain(m.build_candidates(b.candidates(spark, d)))


@query(
    "m2_additive_metrics",
    f"WITH {CANDIDATES}, {WIDE_CAND}, {DERIVED} SELECT company_id, fy, metric_key, value, pins AS contributing_pin_ids FROM derived WHERE metric_key = 'rev_ar'",
)
def _m2(spark: SparkSession, d: str) -> DataFrame:
    rules = m.MetricRules(additive=RULES.additive)
    return plain(m.derive(b.candidates(spark, d), rules).drop("sector", "pin_id"))


@query(
    "m3_ratio_metrics",
    f"WITH {CANDIDATES}, {WIDE_CAND}, {DERIVED} SELECT company_id, fy, metric_key, value FROM derived WHERE metric_key <> 'rev_ar'",
)
def _m3(spark: SparkSession, d: str) -> DataFrame:
    rows = m.derive(b.candidates(spark, d), RULES).where(F.col("metric_key") != "rev_ar")
    return plain(rows.select("company_id", "fy", "metric_key", "value"))


@query("m4_identity_screen", f"WITH {BROKEN}, {WIDE_CAND}, {FAILED} SELECT * FROM failed WHERE screen = 'identity'")
def _m4(spark: SparkSession, d: str) -> DataFrame:
    return plain(m.identity_failures(b.candidates(spark, d, broken=True), RULES))


@query("m5_non_negative_screen", f"WITH {BROKEN}, {WIDE_CAND}, {FAILED} SELECT * FROM failed WHERE screen = 'non_negative'")
def _m5(spark: SparkSession, d: str) -> DataFrame:
    return plain(m.negative_failures(b.candidates(spark, d, broken=True), RULES))


KEPT = f"{BROKEN}, {WIDE_CAND}, {DERIVED}, {FAILED}, {CLOSURE}, {EVERYTHING}"


@query("m6_dependent_withholding", f"WITH {KEPT} SELECT company_id, fy, sector, metric_key, value FROM kept")
def _m6(spark: SparkSession, d: str) -> DataFrame:
    rows = m.withhold_implausible(m.with_derived(b.candidates(spark, d, broken=True), RULES), RULES)
    return plain(rows.drop("pin_id", "contributing_pin_ids"))


PARTS = """cand AS (SELECT l_suppkey AS company_id, CAST(year(l_shipdate) AS INTEGER) AS fy, l_partkey AS metric_key,
  sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value FROM lineitem GROUP BY 1, 2, 3),
dep AS (SELECT p_partkey AS metric_key, p_partkey + 1 AS dependent_key FROM part WHERE p_partkey % 8 <> 7
  UNION ALL SELECT p_partkey, p_partkey - 7 FROM part WHERE p_partkey % 16 = 7
  UNION ALL SELECT p_partkey, p_partkey * 2 FROM part WHERE p_partkey % 8 = 0),
failed AS (SELECT company_id, fy, metric_key AS failed FROM cand WHERE metric_key % 11 = 3 AND value > 60000),
closure AS (SELECT DISTINCT failed, failed AS metric_key FROM failed
  UNION SELECT c.failed, d.dependent_key FROM closure c JOIN dep d USING (metric_key)),
blocked AS (SELECT DISTINCT company_id, fy, metric_key FROM failed JOIN closure USING (failed))"""


@query(
    "m6_dependency_table",
    f"WITH RECURSIVE {PARTS} SELECT company_id, fy, metric_key, CAST(value AS DOUBLE) AS value FROM cand ANTI JOIN blocked USING (company_id, fy, metric_key)",
)
def _m6_table(spark: SparkSession, d: str) -> DataFrame:
    """Parts as metrics, with a table of dependencies: rings of 16 and chains of 8 parts, linked by doubling."""
    amount = F.sum(money("l_extendedprice")).alias("value")
    keys = (F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("fy"), F.col("l_partkey").alias("metric_key"))
    rows = b.table(spark, d, "lineitem").groupBy(*keys).agg(amount)
    part = F.col("p_partkey")
    following = F.array(F.when(part % 8 != 7, part + 1), F.when(part % 16 == 7, part - 7), F.when(part % 8 == 0, part * 2))
    edges = b.table(spark, d, "part").select(part.alias("metric_key"), F.explode(following).alias("dependent_key"))
    failures = rows.where((F.col("metric_key") % 11 == 3) & (F.col("value") > 60000))
    return plain(m.withhold_dependents(rows, failures, edges))


@query(
    "m7_midrank_percentile",
    f"WITH {CANDIDATES} SELECT company_id, fy, metric_key, {midrank_sql('fy, metric_key')} AS percentile_all FROM cand",
)
def _m7(spark: SparkSession, d: str) -> DataFrame:
    rows = m.midrank_percentile(b.candidates(spark, d), ["fy", "metric_key"], "value", "percentile_all")
    return plain(rows.select("company_id", "fy", "metric_key", "percentile_all"))


@query(
    "m8_sector_percentile",
    f"WITH {CANDIDATES} SELECT company_id, fy, metric_key, {midrank_sql('fy, metric_key, sector', 5)} AS percentile_sector FROM cand",
)
def _m8(spark: SparkSession, d: str) -> DataFrame:
    keys = ["fy", "metric_key", "sector"]
    rows = m.midrank_percentile(b.candidates(spark, d), keys, "value", "percentile_sector", 5)
    return plain(rows.select("company_id", "fy", "metric_key", "percentile_sector"))


@query(
    "m9_year_on_year",
    f"""WITH {CANDIDATES}, gaps AS (SELECT * FROM cand WHERE NOT (company_id % 5 = 2 AND fy = 1998))
    SELECT a.company_id, a.fy, a.metric_key, CAST(a.value - p.value AS DOUBLE) AS yoy_delta FROM gaps a
    LEFT JOIN gaps p ON p.company_id = a.company_id AND p.metric_key = a.metric_key AND p.fy = a.fy - 1""",
)
def _m9(spark: SparkSession, d: str) -> DataFrame:
    gaps = b.candidates(spark, d).where(~((F.col("company_id") % 5 == 2) & (F.col("fy") == 1998)))
    return plain(m.yoy_delta(gaps).select("company_id", "fy", "metric_key", "yoy_delta"))


REBUILD = f"""WITH {KEPT} SELECT k.company_id, k.fy, k.metric_key, k.value, k.pin_id, k.pins AS contributing_pin_ids,
  {midrank_sql('k.fy, k.metric_key').replace('value', 'k.value')} AS percentile_all,
  {midrank_sql('k.fy, k.metric_key, k.sector', 5).replace('value', 'k.value')} AS percentile_sector,
  round(k.value - p.value, 6) AS yoy_delta
  FROM kept k LEFT JOIN kept p ON p.company_id = k.company_id AND p.metric_key = k.metric_key AND p.fy = k.fy - 1"""


@query("m10_rebuild_metrics", REBUILD)
def _m10(spark: SparkSession, d: str) -> DataFrame:
    """A stale table, partitioned by year, that the rebuild replaces."""
    path = shared_dir(spark, "metrics")
    candidates = staged(b.candidates(spark, d, broken=True), "reported")  # worked out once for both writes
    rows = m.materialise(candidates, RULES).drop("sector")
    stale = m.build_candidates(candidates).withColumn("value", F.lit(0).cast(m.VALUE))
    m.replace_partitions(stale.select("company_id", "fy", "metric_key", "value"), path, "fy")
    m.replace_partitions(rows, path, "fy")
    return plain(spark.read.schema(rows.schema).parquet(path)).withColumn("yoy_delta", F.round("yoy_delta", 6))


@query(
    "m11_lineage_arrays",
    f"WITH {CANDIDATES}, {WIDE_CAND}, {DERIVED} SELECT company_id, fy, metric_key, pin_id, pins AS contributing_pin_ids FROM derived "
    "UNION ALL SELECT company_id, fy, metric_key, pin_id, pin_id FROM cand",
)
def _m11(spark: SparkSession, d: str) -> DataFrame:
    return plain(m.with_derived(b.candidates(spark, d), RULES).drop("sector", "value"))
