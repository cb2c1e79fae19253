"""Rule validation: V1-V12, V14."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog import query
from tidemark.functions.exprs import rule_table
from tidemark.operators import rules as r

FORM = [
    r.FieldDef("a.basics.total", "A", "integer", core=True),
    r.FieldDef("a.basics.permanent", "A", "integer"),
    r.FieldDef("a.basics.other", "A", "integer"),
    r.FieldDef("p1.training.pct", "P1", "number", unit="percent", core=True),
    r.FieldDef("p1.policy.exists", "P1", "boolean", core=True),
    r.FieldDef("p1.policy.reason", "P1", "text", condition=("p1.policy.exists", "No")),
    r.FieldDef("p2.audit.date", "P2", "date"),
    r.FieldDef("p2.audit.products", "P2", "text", repeating=True),
    r.FieldDef("p3.leader.programme", "P3", "text", leadership=True),
]
RELATIONS = [r.Relation("a.basics.total", ["a.basics.permanent", "a.basics.other"])]

# One filing per order with up to ten answers worked out from its columns; a null value is no answer,
# and every 33rd order has none at all.
VALUES = {
    "a.basics.total": "CASE WHEN k % 9 = 1 THEN NULL WHEN k % 13 = 2 THEN '12.5' WHEN k % 31 = 3 THEN '12.0000001' WHEN k % 31 = 4 THEN '1.2e3' WHEN k % 31 = 5 THEN CAST(c % 700 + k % 90 AS {s}) || '.0000001' ELSE CAST(c % 700 + k % 90 + CASE WHEN k % 8 = 3 THEN 5 ELSE 0 END AS {s}) END",
    "a.basics.permanent": "CASE WHEN k % 21 = 4 THEN 'many' ELSE CAST(c % 700 AS {s}) END",
    "a.basics.other": "CASE WHEN k % 14 = 5 THEN NULL ELSE CAST(k % 90 AS {s}) END",
    "p1.training.pct": "CASE WHEN k % 17 = 0 THEN '1,000' WHEN k % 23 = 5 THEN '100.0000001' WHEN k % 23 = 7 THEN '1e1' WHEN k % 23 = 9 THEN '12345678901234567890123456789012345' ELSE CAST(k % 120 AS {s}) END",
    "p1.policy.exists": "CASE k % 5 WHEN 0 THEN 'No' WHEN 1 THEN 'yes' WHEN 2 THEN 'maybe' WHEN 3 THEN 'TRUE' ELSE 'false' END",
    "p1.policy.reason": "CASE WHEN k % 10 = 0 THEN 'Not yet' WHEN k % 10 = 7 THEN '  ' END",
    "p2.audit.date": "CASE k % 6 WHEN 0 THEN '1998-02-30' WHEN 1 THEN '1998-02-03' WHEN 2 THEN '3 Feb' WHEN 3 THEN NULL ELSE '2001-12-31' END",
    "p2.audit.products": """CASE k % 4 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '{{"a": 1}}' WHEN 2 THEN 'plain' ELSE '[{{"x": "y"}}]' END""",
    "p3.leader.programme": "CASE WHEN k % 30 = 9 THEN 'Mentoring' END",
    "x.unknown.field": "CASE WHEN k % 40 = 11 THEN 'what' END",
}

ANSWERS = (
    "ans AS MATERIALIZED (SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT k AS filing_id, '{key}' AS field_key, {text.format(s='VARCHAR')} AS value, "
        f"CASE WHEN '{key}' = 'p1.training.pct' AND k % 7 <> 0 THEN 'percent' WHEN '{key}' = 'p1.training.pct' THEN 'count' END AS unit, "
        f"CASE WHEN (k + length('{key}')) % 3 = 0 THEN 'ai' ELSE 'user' END AS author, "
        f"CASE WHEN (k + length('{key}')) % 6 = 0 THEN 'unreviewed' ELSE 'accepted' END AS review_status, "
        f"CASE WHEN (k + length('{key}')) % 4 = 0 THEN 'doc' ELSE '' END AS evidence FROM o"
        for key, text in VALUES.items()
    )
    + ") u WHERE value IS NOT NULL AND filing_id % 33 <> 0), o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)"
)
# DuckDB wants the order table first.
_o = "o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)"
ANSWERS = _o + ", " + ANSWERS.replace(", " + _o, "")

PRIOR = """pri AS MATERIALIZED (SELECT filing_id, field_key, CASE WHEN field_key LIKE 'a.%' AND filing_id % 6 = 0 THEN CAST(TRY_CAST(value AS DECIMAL(38,6)) * 3 AS VARCHAR)
  WHEN filing_id % 50 = 1 THEN 'bad' WHEN filing_id % 50 = 2 THEN '0' ELSE value END AS value FROM ans WHERE filing_id % 4 <> 1
  UNION ALL SELECT k, 'a.basics.other', '44' FROM o WHERE k % 14 = 5 AND k % 33 <> 0 UNION ALL SELECT k, 'z.unknown', '1' FROM o WHERE k % 14 = 6 AND k % 33 <> 0)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    orders = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    pairs = ", ".join(f"'{key}', {text.format(s='STRING')}" for key, text in VALUES.items())
    long = b.spread(orders).select("k", F.expr(f"stack({len(VALUES)}, {pairs}) AS (field_key, value)"))
    code = F.col("k") + F.length("field_key")
    training = F.col("field_key") == "p1.training.pct"
    return long.where(F.col("value").isNotNull() & (F.col("k") % 33 != 0)).select(
        F.col("k").alias("filing_id"),
        "field_key",
        "value",
        F.when(training & (F.col("k") % 7 != 0), "percent").when(training, "count").alias("unit"),
        F.when(code % 3 == 0, "ai").otherwise("user").alias("author"),
        F.when(code % 6 == 0, "unreviewed").otherwise("accepted").alias("review_status"),
        F.when(code % 4 == 0, "doc").otherwise("").alias("evidence"),
    )


def filings(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("filing_id"))


def prior_answers(spark: SparkSession, d: str) -> DataFrame:
    now, key = answers(spark, d), F.col("filing_id")
    tripled = (F.col("value").try_cast("decimal(38,6)") * 3).cast("decimal(38,6)").cast("string")
    value = (
        F.when(F.col("field_key").startswith("a.") & (key % 6 == 0), tripled)
        .when(key % 50 == 1, "bad")
        .when(key % 50 == 2, "0")
        .otherwise(F.col("value"))
    )
    kept = now.where(key % 4 != 1).select("filing_id", "field_key", value.alias("value"))
    answered = now.select("filing_id").distinct()
    # As generated rows: a literal key would turn the later key lookup into a nested loop.
    more = F.inline(
        F.array(
            F.struct(F.lit("a.basics.other").alias("field_key"), F.lit("44").alias("value"), F.lit(5).alias("slot")),
            F.struct(F.lit("z.unknown").alias("field_key"), F.lit("1").alias("value"), F.lit(6).alias("slot")),
        )
    )
    extra = answered.select("filing_id", more).where(key % 14 == F.col("slot")).drop("slot")
    return kept.unionByName(extra)


FORM_ROWS = ", ".join(
    f"('{f.field_key}', '{f.principle}', '{f.dtype}', {repr(f.unit) if f.unit else 'NULL'}, {str(f.repeating).lower()}, {str(f.core).lower()}, "
    f"{str(f.required and not f.leadership).lower()})"
    for f in FORM
)
FORM_SQL = f"form(field_key, principle, dtype, expected_unit, repeating, core, needed) AS (VALUES {FORM_ROWS})"

CHECKED = f"""{ANSWERS}, {FORM_SQL}, n AS (SELECT ans.*, form.dtype, form.expected_unit, form.repeating, trim(value) AS t, replace(trim(value), ',', '') AS p,
  CASE WHEN regexp_full_match(replace(trim(value), ',', ''), '-?[0-9]+([.][0-9]+)?(e[0-9]+)?') THEN CAST(replace(trim(value), ',', '') AS DOUBLE) END AS num FROM ans JOIN form USING (field_key)),
chk AS (SELECT *, CASE WHEN t = '' THEN 'Value cannot be empty'
  WHEN dtype = 'integer' AND NOT coalesce(num IS NOT NULL AND CASE WHEN contains(p, 'e') THEN num = floor(num) ELSE rtrim(split_part(p, '.', 2), '0') = '' END, false) THEN 'Expected a whole number'
  WHEN dtype = 'number' AND num IS NULL THEN 'Expected a number'
  WHEN dtype = 'boolean' AND lower(t) NOT IN ('true', 'false', 'yes', 'no') THEN 'Expected true/false or yes/no'
  WHEN dtype = 'date' AND (NOT regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR TRY_CAST(t AS DATE) IS NULL) THEN 'Expected an ISO date'
  WHEN repeating AND NOT (json_valid(t) AND coalesce(CASE WHEN json_valid(t) THEN json_type(t) END = 'ARRAY', false)) THEN 'Repeating groups must be a JSON array'
  WHEN expected_unit IS NOT NULL AND unit IS DISTINCT FROM expected_unit THEN 'Expected unit ' || expected_unit
  WHEN expected_unit = 'percent' AND NOT coalesce(num BETWEEN 0 AND 100, false) THEN 'Percentage must be between 0 and 100' END AS error FROM n)"""


@query(
    "v1_typed_values",
    f"""WITH {CHECKED} SELECT filing_id, field_key, error, CASE WHEN error IS NULL THEN CASE dtype WHEN 'integer' THEN CASE WHEN contains(p, 'e') THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE split_part(p, '.', 1) END WHEN 'number' THEN CASE WHEN contains(p, 'e') THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE p END
      WHEN 'boolean' THEN CASE WHEN lower(t) IN ('true', 'yes') THEN 'true' ELSE 'false' END ELSE t END END AS normalised FROM chk""",
)
def _v1(spark: SparkSession, d: str) -> DataFrame:
    return r.check_values(answers(spark, d), FORM).select("filing_id", "field_key", "error", "normalised")


V2 = "SELECT filing_id, 'error' AS severity, field_key, 'Unknown field' AS message, 'L1' AS tier FROM ans WHERE field_key NOT IN (SELECT field_key FROM form)"


@query("v2_unknown_fields", f"WITH {ANSWERS}, {FORM_SQL} {V2}")
def _v2(spark: SparkSession, d: str) -> DataFrame:
    return r.unknown_fields(answers(spark, d), FORM)


TOTALS = """tot AS (SELECT filing_id, max(trim(value)) FILTER (WHERE field_key = 'a.basics.total') AS t, max(TRY_CAST(trim(value) AS HUGEINT)) FILTER (WHERE field_key = 'a.basics.permanent')
  + max(TRY_CAST(trim(value) AS HUGEINT)) FILTER (WHERE field_key = 'a.basics.other') AS e FROM ans GROUP BY 1)"""
# The parts are whole numbers here; a total equals them only if nothing but zeros follows its point.
V3 = """SELECT filing_id, 'error' AS severity, 'a.basics.total' AS field_key, 'Total ' || CASE WHEN contains(t, 'e') THEN CAST(CAST(CAST(t AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE t END || ' does not equal component sum ' || e AS message, 'L2' AS tier
  FROM tot WHERE t IS NOT NULL AND e IS NOT NULL AND CASE WHEN contains(t, 'e') THEN CAST(t AS DOUBLE) <> CAST(e AS DOUBLE) ELSE split_part(t, '.', 1) <> CAST(e AS VARCHAR) OR rtrim(split_part(t, '.', 2), '0') <> '' END"""


@query("v3_sum_relations", f"WITH {ANSWERS}, {TOTALS} {V3}")
def _v3(spark: SparkSession, d: str) -> DataFrame:
    return r.relation_findings(answers(spark, d), RELATIONS)


V4 = """SELECT filing_id, 'warning' AS severity, field_key, 'Year-on-year movement exceeds 50%' AS message, 'L2' AS tier FROM (
  SELECT a.filing_id, a.field_key, TRY_CAST(trim(a.value) AS DOUBLE) AS n, TRY_CAST(trim(p.value) AS DOUBLE) AS o
  FROM ans a JOIN pri p ON p.filing_id = a.filing_id AND p.field_key = a.field_key JOIN form f ON f.field_key = a.field_key AND f.dtype IN ('number', 'integer')) m
  WHERE o <> 0 AND abs((n - o) / o * 100) > 50"""


@query("v4_prior_year_movement", f"WITH {ANSWERS}, {FORM_SQL}, {PRIOR} {V4}")
def _v4(spark: SparkSession, d: str) -> DataFrame:
    return r.movement_findings(answers(spark, d), prior_answers(spark, d), FORM)


NEEDED = """no AS (SELECT filing_id AS k FROM ans WHERE field_key = 'p1.policy.exists' AND value = 'No'),
need AS MATERIALIZED (SELECT o.k AS filing_id, form.field_key, form.principle FROM o CROSS JOIN form LEFT JOIN no ON no.k = o.k WHERE needed AND (form.field_key <> 'p1.policy.reason' OR no.k IS NOT NULL))"""
V5 = """SELECT need.filing_id, 'error' AS severity, need.field_key, 'Required answer is missing' AS message, 'L3' AS tier FROM need
  ANTI JOIN ans ON ans.filing_id = need.filing_id AND ans.field_key = need.field_key"""


@query("v5_required_with_condition", f"WITH {ANSWERS}, {FORM_SQL}, {NEEDED} {V5}")
def _v5(spark: SparkSession, d: str) -> DataFrame:
    return r.missing_required(filings(spark, d), answers(spark, d), FORM)


V6 = """SELECT filing_id, 'error' AS severity, field_key, 'AI-proposed answer has not been reviewed' AS message, 'L3' AS tier FROM ans WHERE author = 'ai' AND review_status = 'unreviewed'"""


@query("v6_unreviewed_machine_answers", f"WITH {ANSWERS} {V6}")
def _v6(spark: SparkSession, d: str) -> DataFrame:
    return r.unreviewed_machine_answers(answers(spark, d))


PROGRESS = f"""{NEEDED}, elig AS (SELECT filing_id, field_key FROM ans WHERE NOT (author = 'ai' AND review_status = 'unreviewed')),
sec0 AS (SELECT n.filing_id, n.principle, CAST(round_even(count(e.field_key) * 100.0::DOUBLE / count(*), 0) AS INTEGER) AS pct FROM need n LEFT JOIN elig e USING (filing_id, field_key) GROUP BY 1, 2),
sec AS (SELECT k AS filing_id, p.principle, coalesce(pct, 100) AS pct FROM o CROSS JOIN (SELECT DISTINCT principle FROM form) p LEFT JOIN sec0 ON sec0.filing_id = k AND sec0.principle = p.principle),
core AS (SELECT k AS filing_id, CAST(round_even(count(e.field_key) * 100.0::DOUBLE / count(*), 0) AS INTEGER) AS core_pct FROM o JOIN form ON core LEFT JOIN elig e ON e.filing_id = k AND e.field_key = form.field_key GROUP BY 1),
ev AS (SELECT filing_id, count(*) FILTER (WHERE evidence <> '') AS evidenced FROM ans GROUP BY 1),
prog AS (SELECT filing_id, CAST(round_even(sum(pct) / count(*), 0) AS INTEGER) AS overall_pct, any_value(core_pct) AS core_pct, bool_and(pct = 100) AS complete, coalesce(any_value(evidenced), 0) AS evidenced
  FROM sec JOIN core USING (filing_id) LEFT JOIN ev USING (filing_id) GROUP BY 1)"""


@query("v7_progress_by_principle", f"WITH {ANSWERS}, {FORM_SQL}, {PROGRESS} SELECT * FROM sec")
def _v7(spark: SparkSession, d: str) -> DataFrame:
    return r.progress(filings(spark, d), answers(spark, d), FORM)[0]


@query("v7_progress_summary", f"WITH {ANSWERS}, {FORM_SQL}, {PROGRESS} SELECT * FROM prog")
def _v7b(spark: SparkSession, d: str) -> DataFrame:
    return r.progress(filings(spark, d), answers(spark, d), FORM)[1]


@query(
    "v8_prefill_candidates",
    f"""WITH {ANSWERS}, {FORM_SQL}, {PRIOR} SELECT p.filing_id, p.field_key, p.value, 'candidate' AS status FROM pri p SEMI JOIN form USING (field_key)
      ANTI JOIN ans a ON a.filing_id = p.filing_id AND a.field_key = p.field_key""",
)
def _v8(spark: SparkSession, d: str) -> DataFrame:
    return r.prefill_candidates(answers(spark, d), prior_answers(spark, d), FORM)


ALL = f"""{CHECKED}, {PRIOR}, {TOTALS}, {PROGRESS}, fnd AS ({V2} UNION ALL SELECT filing_id, 'error', field_key, error, 'L1' FROM chk WHERE error IS NOT NULL
  UNION ALL {V3} UNION ALL {V4} UNION ALL {V5} UNION ALL {V6})"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    return r.validate_filings(filings(spark, d), answers(spark, d), FORM, RELATIONS, prior_answers(spark, d))


@query("v9_export_gate", f"WITH {ALL} SELECT k AS filing_id, bad.filing_id IS NULL AS allowed FROM o LEFT JOIN (SELECT DISTINCT filing_id FROM fnd WHERE severity = 'error') bad ON bad.filing_id = k")
def _v9(spark: SparkSession, d: str) -> DataFrame:
    return r.export_gate(filings(spark, d), findings(spark, d))


@query(
    "v10_gap_score",
    f"""WITH {ALL}, c AS (SELECT filing_id, count(*) AS findings FROM fnd GROUP BY 1)
    SELECT filing_id, greatest(0, CAST(round_even(round(core_pct * 0.6::DOUBLE + least(100, evidenced * 2) * 0.4::DOUBLE - coalesce(findings, 0) * 2, 6), 0) AS INTEGER)) AS score,
      core_pct, evidenced, coalesce(findings, 0) AS findings FROM prog LEFT JOIN c USING (filing_id)""",
)
def _v10(spark: SparkSession, d: str) -> DataFrame:
    return r.gap_scores(r.progress(filings(spark, d), answers(spark, d), FORM)[1], findings(spark, d))


@query(
    "v10_priority_findings",
    f"WITH {ALL} SELECT * FROM fnd QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY tier, field_key, message) <= 12",
)
def _v10b(spark: SparkSession, d: str) -> DataFrame:
    return r.priorities(findings(spark, d))


ITEMS = ("policy_exists", "policy_url", "review_frequency", "commitments_targets")


@query(
    "v11_template_expansion",
    f"""SELECT r_name AS principle, item, 'b.n' || n_nationkey || '.' || item AS field_key FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES {', '.join(f"('{i}')" for i in ITEMS)}) v(item)""",
)
def _v11(spark: SparkSession, d: str) -> DataFrame:
    nation, region = b.table(spark, d, "nation"), b.table(spark, d, "region")
    dims = nation.join(region, nation.n_regionkey == region.r_regionkey)
    rows = r.expand_templates(dims, [F.col("n_nationkey")], ITEMS, F.col("r_name"))
    key = F.concat(F.lit("b.n"), "n_nationkey", F.lit("."), "item").alias("field_key")
    return rows.select("principle", "item", key)


LINT = f"""f AS (SELECT 'p' || (p_partkey % 11) || '.' || lower(p_type) || '.' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_' || p_partkey END AS field_key,
  CASE p_size % 7 WHEN 0 THEN 'blob' WHEN 1 THEN NULL WHEN 2 THEN 'number' ELSE 'text' END AS dtype, CASE WHEN p_partkey % 19 <> 0 THEN 'C' || (p_partkey % 1900) END AS concept,
  CASE WHEN p_size % 2 = 0 THEN 'GJ' END AS unit, CASE WHEN p_size % 4 = 0 THEN 'energy' END AS family FROM part),
rel AS (SELECT 'r' || (p_partkey % 50) AS relation, 'p1.' || lower(p_type) || '.' || replace(p_name, ' ', '_') || '_' || p_partkey AS reference FROM part WHERE p_size = 7)"""


@query(
    "v12_schema_lint",
    f"""WITH {LINT} SELECT 'duplicate field_key' AS rule, field_key AS subject FROM f GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'duplicate concept', concept FROM f WHERE concept IS NOT NULL GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'invalid field_key', field_key FROM f WHERE NOT regexp_matches(field_key, '{r.FIELD_KEY_PATTERN}')
    UNION ALL SELECT 'invalid dtype', field_key FROM f WHERE coalesce(dtype, '') NOT IN ('text', 'number', 'integer', 'boolean', 'date')
    UNION ALL SELECT 'missing concept', field_key FROM f WHERE concept IS NULL UNION ALL SELECT 'unit without family', field_key FROM f WHERE unit IS NOT NULL AND family IS NULL
    UNION ALL SELECT 'unknown relation reference', relation || ' ' || reference FROM rel WHERE reference NOT IN (SELECT field_key FROM f)
    UNION ALL SELECT 'too few fields', CAST(count(*) AS VARCHAR) FROM f HAVING count(*) < 250""",
)
def _v12(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    slug = F.replace("p_name", F.lit(" "), F.lit("_"))
    tail = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("_"), key))
    parts = b.table(spark, d, "part")
    fields = parts.select(
        F.concat(F.lit("p"), key % 11, F.lit("."), F.lower("p_type"), F.lit("."), slug, tail).alias("field_key"),
        F.when(size % 7 == 0, "blob").when(size % 7 == 1, None).when(size % 7 == 2, "number").otherwise("text").alias("dtype"),
        F.when(key % 19 != 0, F.concat(F.lit("C"), key % 1900)).alias("concept"),
        F.when(size % 2 == 0, "GJ").alias("unit"),
        F.when(size % 4 == 0, "energy").alias("unit_family"),
    )
    relations = parts.where("p_size = 7").select(
        F.concat(F.lit("r"), key % 50).alias("relation"),
        F.concat(F.lit("p1."), F.lower("p_type"), F.lit("."), slug, F.lit("_"), key).alias("reference"),
    )
    return r.lint_fields(fields, relations)


@query(
    "v14_status_steps",
    """WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus AS status, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders)
    SELECT o_custkey, o_orderkey, status, previous FROM l WHERE previous <> status AND NOT (previous = 'O' AND status = 'P') AND NOT (previous = 'P' AND status = 'F')""",
)
def _v14(spark: SparkSession, d: str) -> DataFrame:
    log = b.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("status"))
    rows = r.status_step_violations(log, ["o_custkey"], "o_orderdate", "o_orderkey", "status", {"O": "P", "P": "F"})
    return rows.select("o_custkey", "o_orderkey", "status", "previous")
