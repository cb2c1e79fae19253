"""Units, mapping, publication, quality: U1-U6, P1-P5, G1-G9, V13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog import query
from tidemark.catalog.fragments import NARRATIVES, VERSIONS, WIDE
from tidemark.catalog.metrics import plain
from tidemark.functions import text as t
from tidemark.functions.exprs import money, rule_table
from tidemark.operators import mapping as m
from tidemark.operators import publication as p

UNIT_NAMES = (" kWh ", "MWh", "M L", "KL", "kgCO2e", "Mt", "furlong", "%")
UNIT_CASE = "CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(UNIT_NAMES)) + " END"


@query(
    "u1_unit_conversion",
    f"""WITH units(k, family, canonical, f) AS (VALUES ('kwh', 'energy', 'GJ', 0.0036), ('mwh', 'energy', 'GJ', 3.6), ('gj', 'energy', 'GJ', 1), ('ml', 'water', 'KL', 1000),
      ('kl', 'water', 'KL', 1), ('kgco2e', 'emissions', 'tCO2e', 0.001), ('mt', 'mass', 'MT', 1), ('%', 'percentage', 'percent', 1)),
    v AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS v, {UNIT_CASE} AS unit, CASE p_size % 3 WHEN 1 THEN 'GJ' WHEN 2 THEN 'kl' END AS target FROM part),
    j AS (SELECT v.*, s.family AS sf, s.canonical AS sc, s.f AS sx, g.k AS tk, g.family AS tf, g.canonical AS tc, g.f AS tx FROM v
      LEFT JOIN units s ON s.k = replace(lower(trim(unit)), ' ', '') LEFT JOIN units g ON g.k = replace(lower(trim(target)), ' ', '')),
    e AS (SELECT *, CASE WHEN sf IS NULL THEN 'unknown_unit' WHEN target IS NOT NULL AND tk IS NULL THEN 'unknown_target' WHEN target IS NOT NULL AND sf <> tf THEN 'incompatible_units' END AS unit_error FROM j)
    SELECT p_partkey, unit_error, round(CASE WHEN unit_error IS NULL THEN CAST(v AS DOUBLE) * CAST(sx AS DOUBLE) / coalesce(CAST(tx AS DOUBLE), 1) END, 6) AS converted,
      CASE WHEN unit_error IS NULL THEN coalesce(tc, sc) END AS converted_unit FROM e""",
)
def _u1(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in UNIT_NAMES]), F.col("p_size") % 8 + 1)
    target = F.when(F.col("p_size") % 3 == 1, "GJ").when(F.col("p_size") % 3 == 2, "kl")
    parts = b.table(spark, d, "part").select(
        "p_partkey", money("p_retailprice").alias("v"), unit.alias("unit"), target.alias("target")
    )
    rows = m.convert_units(parts, "v", "unit", "target")
    return rows.select(
        "p_partkey", "unit_error", F.round(F.col("converted").cast("double"), 6).alias("converted"), "converted_unit"
    )


RAW_CASE = """CASE p_partkey % 9 WHEN 0 THEN '₹ ' || n || ' lakh' WHEN 1 THEN 'INR 1,23,' || (100 + p_size) || '.50' WHEN 2 THEN p_size || ' to ' || (p_size + 20) || ' crore'
  WHEN 3 THEN ' Nil ' WHEN 4 THEN '12.' || p_size || ' %' WHEN 5 THEN 'about ' || (p_size + 5) || ' – ' || p_size WHEN 6 THEN 'n/a' WHEN 7 THEN n || ' percent of lakhs' ELSE n || ' through 9,000.25' END"""


def number_sql(source: str) -> str:
    return f"""x AS (SELECT id, replace(replace(lower(trim(raw)), '₹', ''), 'inr', '') AS s FROM {source}),
    y AS (SELECT id, s, s IN ('nil', 'none', 'zero', '-', '—') AS is_nil, regexp_extract_all(s, '[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?') AS f,
      CASE WHEN regexp_matches(s, '\\blakhs?\\b') THEN 100000 WHEN regexp_matches(s, '\\blacs?\\b') THEN 100000 WHEN regexp_matches(s, '\\bcrores?\\b') THEN 10000000 ELSE 1 END AS k FROM x),
    z AS (SELECT *, TRY_CAST(replace(f[1], ',', '') AS DECIMAL(28,6)) * k AS a, TRY_CAST(replace(f[2], ',', '') AS DECIMAL(28,6)) * k AS c,
      NOT is_nil AND len(f) >= 2 AND regexp_matches(s, '\\b(?:to|through)\\b|[–—]') AS is_range FROM y)
    SELECT id, CAST(CAST(CASE WHEN is_nil THEN 0 WHEN is_range THEN (a + c) * 0.5 ELSE a END AS DECIMAL(38,6)) AS VARCHAR) AS value,
      CAST(CAST(CASE WHEN is_range THEN least(a, c) END AS DECIMAL(38,6)) AS VARCHAR) AS lower, CAST(CAST(CASE WHEN is_range THEN greatest(a, c) END AS DECIMAL(38,6)) AS VARCHAR) AS upper,
      NOT is_nil AND a IS NOT NULL AND (contains(s, '%') OR contains(s, 'percent')) AS is_percent, is_nil FROM z"""


def numbers(df: DataFrame) -> DataFrame:
    parsed = t.parse_numbers(df, "raw", "n").select("id", "n.*")
    # As text: card-sized numbers do not fit a double to the last digit.
    return parsed.withColumns({c: F.col(c).cast("string") for c in ("value", "lower", "upper")})


@query(
    "u2_locale_numbers",
    f"WITH src AS (SELECT p_partkey AS id, {RAW_CASE} AS raw FROM (SELECT *, CAST(p_retailprice AS DECIMAL(18,2)) AS n FROM part)), {number_sql('src')}",
)
def _u2(spark: SparkSession, d: str) -> DataFrame:
    n, size = money("p_retailprice").cast("string"), F.col("p_size")
    forms = F.array(
        F.concat(F.lit("₹ "), n, F.lit(" lakh")),
        F.concat(F.lit("INR 1,23,"), size + 100, F.lit(".50")),
        F.concat(size, F.lit(" to "), size + 20, F.lit(" crore")),
        F.lit(" Nil "),
        F.concat(F.lit("12."), size, F.lit(" %")),
        F.concat(F.lit("about "), size + 5, F.lit(" – "), size),
        F.lit("n/a"),
        F.concat(n, F.lit(" percent of lakhs")),
        F.concat(n, F.lit(" through 9,000.25")),
    )
    raw = F.element_at(forms, (F.col("p_partkey") % 9 + 1).cast("int"))
    return numbers(b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw")))


@query(
    "u2_document_numbers",
    f"WITH {NARRATIVES}, src AS (SELECT doc_id AS id, text AS raw FROM narr), {number_sql('src')}",
)
def _u2b(spark: SparkSession, d: str) -> DataFrame:
    return numbers(b.narratives(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("raw")))


@query(
    "u3_total_relation",
    f"""WITH {WIDE}, r AS (SELECT company_id, fy, CAST(revenue * CASE WHEN company_id % 6 = 1 THEN 2 ELSE 1 END AS DOUBLE) AS total, CAST(rev_a + rev_n + rev_r AS DOUBLE) AS parts FROM wide)
    SELECT company_id, fy, round(abs(total - parts) / greatest(abs(total), 1), 9) AS relative_error, abs(total - parts) / greatest(abs(total), 1) <= 0.02 AS passed,
      CASE WHEN abs(total - parts) / greatest(abs(total), 1) > 0.02 THEN 'declared_total_mismatch' END AS flag FROM r""",
)
def _u3(spark: SparkSession, d: str) -> DataFrame:
    declared = F.col("revenue") * F.when(F.col("company_id") % 6 == 1, 2).otherwise(1)
    check = m.check_total(declared, [F.col("rev_a"), F.col("rev_n"), F.col("rev_r")])
    rows = b.wide_facts(spark, d).select("company_id", "fy", check.alias("c")).select("company_id", "fy", "c.*")
    return rows.withColumn("relative_error", F.round("relative_error", 9))


FY = 1998
MAPPINGS = [
    m.ConceptMapping("C1", "a.basics.turnover", "INR", registered_scale=True),
    m.ConceptMapping("C2", "p6.e1.energy", "GJ", {"GJ": "1", "MJ": "0.001", "TJ": "1000"}),
    m.ConceptMapping("C3", "p6.e2.water", "KL", {"GJ": "1"}),
    m.ConceptMapping("C4", "p6.e3.rejected", "KL", {"GJ": "1"}, review_status="rejected"),
]

MAPPED = f"""fil AS (SELECT o_orderkey AS filing_id, 'ISSUER' || (o_custkey % 50) AS issuer FROM orders WHERE year(o_orderdate) = {FY}),
raw AS (SELECT l_orderkey AS filing_id, 'C' || l_linenumber AS concept, l_partkey AS ordinal, l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS fact_id,
  CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_partkey % 5 = 0 THEN 100000 ELSE 1 END END AS value_num,
  CASE l_returnflag WHEN 'A' THEN 'MJ' WHEN 'N' THEN 'GJ' ELSE 'TJ' END AS unit, CASE l_linestatus WHEN 'F' THEN 'main' ELSE 'other' END AS context_id, year(l_shipdate) AS fy FROM lineitem),
pick AS (SELECT * FROM raw WHERE concept IN ('C1', 'C2', 'C3') AND fy = {FY} AND context_id = 'main'
  QUALIFY row_number() OVER (PARTITION BY filing_id, concept ORDER BY ordinal DESC, fact_id DESC) = 1),
maps(concept, field_key, target_unit, reg) AS (VALUES ('C1', 'a.basics.turnover', 'INR', true), ('C2', 'p6.e1.energy', 'GJ', false), ('C3', 'p6.e2.water', 'KL', false)),
fac(field_key, unit, factor) AS (VALUES ('p6.e1.energy', 'GJ', 1.0), ('p6.e1.energy', 'MJ', 0.001), ('p6.e1.energy', 'TJ', 1000.0), ('p6.e2.water', 'GJ', 1.0)),
regi AS (SELECT DISTINCT 'ISSUER' || (c_custkey % 50) AS issuer, CASE c_custkey % 50 % 4 WHEN 0 THEN 'inr' WHEN 1 THEN 'lakh' ELSE 'crore' END AS scale,
  CASE c_custkey % 50 % 4 WHEN 0 THEN 1 WHEN 1 THEN 100000 ELSE 10000000 END AS sf FROM customer WHERE c_custkey % 50 % 4 < 3),
pub0 AS (SELECT fil.filing_id, maps.field_key, fact_id, target_unit, p.value_num AS v, p.unit,
  CASE WHEN reg THEN CASE WHEN p.value_num >= 1000000000 THEN CAST(p.value_num AS DOUBLE) ELSE CAST(p.value_num AS DOUBLE) * sf END ELSE CAST(p.value_num AS DOUBLE) * CAST(factor AS DOUBLE) END AS c,
  CASE WHEN reg THEN CASE WHEN p.value_num >= 1000000000 THEN 'absolute' ELSE scale END ELSE p.unit END AS token
  FROM fil CROSS JOIN maps LEFT JOIN pick p ON p.filing_id = fil.filing_id AND p.concept = maps.concept
  LEFT JOIN fac ON fac.field_key = maps.field_key AND fac.unit = p.unit LEFT JOIN regi ON regi.issuer = fil.issuer),
pub AS (SELECT filing_id, field_key, fact_id, target_unit, CASE WHEN v IS NULL THEN 'missing' WHEN c IS NULL THEN 'withheld' ELSE 'published' END AS status,
  CASE WHEN v IS NOT NULL THEN round(c, 4) END AS value_num, CASE WHEN v IS NOT NULL AND c IS NOT NULL THEN token END AS resolved_scale FROM pub0)"""


def mapping_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = b.table(spark, d, "orders").where(F.year("o_orderdate") == FY)
    issuer = F.concat(F.lit("ISSUER"), F.col("o_custkey") % 50)
    filings = orders.select(F.col("o_orderkey").alias("filing_id"), issuer.alias("issuer"))
    part = F.col("l_partkey")
    amount = money("l_extendedprice") * F.when(part % 5 == 0, 100000).otherwise(1)
    unit = F.when(F.col("l_returnflag") == "A", "MJ").when(F.col("l_returnflag") == "N", "GJ").otherwise("TJ")
    facts = b.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("filing_id"),
        F.concat(F.lit("C"), "l_linenumber").alias("concept"),
        part.alias("ordinal"),
        (part * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("fact_id"),
        F.when(part % 11 != 0, amount).alias("value_num"),
        unit.alias("unit"),
        F.when(F.col("l_linestatus") == "F", "main").otherwise("other").alias("context_id"),
        F.make_date(F.year("l_shipdate"), F.lit(3), F.lit(31)).alias("period_end"),
    )
    slot = F.col("c_custkey") % 50
    registry = b.table(spark, d, "customer").where(slot % 4 < 3).select(
        F.concat(F.lit("ISSUER"), slot).alias("issuer"),
        F.when(slot % 4 == 0, "inr").when(slot % 4 == 1, "lakh").otherwise("crore").alias("scale"),
    )
    return filings, facts, registry.distinct()


def published(spark: SparkSession, d: str) -> DataFrame:
    filings, facts, registry = mapping_inputs(spark, d)
    return m.publish_mappings(filings, facts, MAPPINGS, registry, FY)


@query("u4_publish_mappings", f"WITH {MAPPED} SELECT * FROM pub")
def _u4(spark: SparkSession, d: str) -> DataFrame:
    return published(spark, d).withColumn("value_num", F.round(F.col("value_num").cast("double"), 4)).drop("lineage")


@query(
    "u4_published_lineage",
    f"""WITH {MAPPED} SELECT filing_id, field_key, maps.concept AS source_concept, 'main' AS context_id, '{FY}-03-31' AS period_end, pub0.unit AS reported_unit, 'provisional' AS review_status,
      CASE maps.concept WHEN 'C1' THEN '' WHEN 'C2' THEN 'GJ=1 MJ=0.001 TJ=1000' ELSE 'GJ=1' END AS conversion_rules FROM pub JOIN pub0 USING (filing_id, field_key) JOIN maps USING (field_key) WHERE status = 'published'""",
)
def _u4c(spark: SparkSession, d: str) -> DataFrame:
    rows = published(spark, d).where(F.col("status") == "published").select("filing_id", "field_key", "lineage.*")
    return rows.withColumn("period_end", F.col("period_end").cast("string"))


@query(
    "u4_pins_after_publish",
    f"""WITH {MAPPED}, pins AS (SELECT filing_id, field_key FROM pub UNION ALL SELECT filing_id, 'p6.e3.rejected' FROM fil)
    SELECT filing_id, field_key, filing_id % 7 AS version FROM pins WHERE filing_id % 2 = 0 AND field_key <> 'p6.e3.rejected'
      AND (filing_id, field_key) NOT IN (SELECT (filing_id, field_key) FROM pub WHERE status = 'withheld')""",
)
def _u4d(spark: SparkSession, d: str) -> DataFrame:
    rows = published(spark, d)
    rejected = [mapping.field_key for mapping in MAPPINGS if mapping.review_status == "rejected"]
    filings = mapping_inputs(spark, d)[0].select("filing_id", F.explode(F.array(*map(F.lit, rejected))).alias("field_key"))
    pins = rows.select("filing_id", "field_key").unionByName(filings).where("filing_id % 2 = 0")
    return m.pins_after_publish(pins.withColumn("version", F.col("filing_id") % 7), rows, rejected)


LATEST = """latest AS (SELECT filing_id, field_key, fact_id - CASE WHEN filing_id % 3 = 0 THEN 0 ELSE 1 END AS fact_id, filing_id % 4 + 1 AS version,
  CASE WHEN filing_id % 5 = 0 THEN 'old' ELSE 'new' END AS mapping_version FROM pub WHERE status = 'published' AND filing_id % 2 = 0),
reuse AS (SELECT p.*, l.fact_id = p.fact_id AND l.mapping_version = 'new' AS same, l.version AS v FROM pub p LEFT JOIN latest l USING (filing_id, field_key) WHERE status = 'published')"""


def reused(spark: SparkSession, d: str) -> DataFrame:
    rows = published(spark, d)
    key = F.col("filing_id")
    latest = rows.where((F.col("status") == "published") & (key % 2 == 0)).select(
        "filing_id",
        "field_key",
        (F.col("fact_id") - F.when(key % 3 == 0, 0).otherwise(1)).alias("fact_id"),
        (key % 4 + 1).alias("version"),
        F.when(key % 5 == 0, "old").otherwise("new").alias("mapping_version"),
    )
    return m.reuse_versions(rows, latest, "new")


@query(
    "u4_publish_counts",
    f"""WITH {MAPPED}, {LATEST} SELECT (SELECT count(*) FROM reuse WHERE NOT coalesce(same, false)) AS created, count(*) FILTER (WHERE status = 'published') AS pinned,
      count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'withheld') AS withheld FROM pub""",
)
def _u4b(spark: SparkSession, d: str) -> DataFrame:
    return m.publish_counts(published(spark, d), reused(spark, d))


@query(
    "u5_issuer_scale",
    """WITH reg(issuer, scale, f) AS (VALUES ('AUTOMOBILE', 'inr', 1), ('BUILDING', 'lakh', 100000), ('FURNITURE', 'million', 1000000), ('MACHINERY', 'crore', 10000000)),
    v AS (SELECT o_orderkey, c_mktsegment AS issuer, CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 6 = 0 THEN 10000 ELSE 1 END AS v FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, CAST(CASE WHEN v >= 1000000000 THEN v ELSE v * f END AS DOUBLE) AS absolute, CASE WHEN v >= 1000000000 THEN 'absolute' ELSE scale END AS scale FROM v LEFT JOIN reg USING (issuer)""",
)
def _u5(spark: SparkSession, d: str) -> DataFrame:
    names = [("automobile", "inr"), ("building", "lakh"), ("furniture", "million"), ("machinery", "crore")]
    registry = rule_table(spark, ["issuer", "scale"], names)
    customers = b.issuers(spark, d).select(F.col("company_id").alias("o_custkey"), F.col("sector").alias("issuer"))
    value = money("o_totalprice") * F.when(F.col("o_orderkey") % 6 == 0, 10000).otherwise(1)
    rows = b.table(spark, d, "orders").select("o_orderkey", "o_custkey", value.alias("v")).join(customers, "o_custkey")
    out = m.resolve_scale(rows, registry, "v", "issuer")
    return out.select("o_orderkey", F.col("absolute").cast("double").alias("absolute"), "scale")


@query(
    "u6_version_reuse",
    f"WITH {MAPPED}, {LATEST} SELECT filing_id, field_key, coalesce(same, false) AS reused, CASE WHEN same THEN v ELSE coalesce(v, 0) + 1 END AS version FROM reuse",
)
def _u6(spark: SparkSession, d: str) -> DataFrame:
    return reused(spark, d).select("filing_id", "field_key", "reused", "version")


@query(
    "p1_latest_publishable",
    f"""WITH {VERSIONS} SELECT filing_id, field_key, version, qa_status FROM versions WHERE qa_status IN ('sampled_ok', 'corrected')
    QUALIFY row_number() OVER (PARTITION BY filing_id, field_key ORDER BY version DESC) = 1""",
)
def _p1(spark: SparkSession, d: str) -> DataFrame:
    return p.latest_publishable(b.versions(spark, d)).select("filing_id", "field_key", "version", "qa_status")


REVIEWS = """reviews AS (SELECT doc_id AS field_id, quality = 1 AS correct FROM labels),
fam AS (SELECT string_split(field_key, '.')[1] || '.' || string_split(field_key, '.')[2] AS family, count(*) AS reviewed, count(*) FILTER (WHERE correct) AS correct
  FROM reviews JOIN versions USING (field_id) GROUP BY 1)"""
TARGET = "0.85"


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    reviews = b.table(spark, d, "labels").select(
        F.col("doc_id").alias("field_id"), (F.col("quality") == 1).alias("correct")
    )
    fields = b.versions(spark, d).select("field_id", p.field_family(F.col("field_key")).alias("family"))
    return p.family_accuracy(reviews.join(fields, "field_id"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return p.publish_decision(b.versions(spark, d), accuracy(spark, d), target=TARGET)


DECIDED = f"""{VERSIONS}, {REVIEWS}, dec AS (SELECT v.*, concat_ws(',', CASE WHEN qa_status NOT IN ('sampled_ok', 'corrected') THEN 'qa_not_passed' END,
  CASE WHEN confidence < 0.90 THEN 'confidence_below_threshold' END, CASE WHEN coalesce(correct / reviewed < {TARGET}, true) THEN 'family_accuracy_below_target' END) AS reasons
  FROM versions v LEFT JOIN fam ON fam.family = string_split(field_key, '.')[1] || '.' || string_split(field_key, '.')[2])"""


@query("p2_publish_decision", f"WITH {DECIDED} SELECT field_id, reasons, reasons = '' AS allowed FROM dec")
def _p2(spark: SparkSession, d: str) -> DataFrame:
    return plain(decisions(spark, d).select("field_id", "reasons", "allowed"))


@query(
    "p3_field_family",
    f"WITH {VERSIONS} SELECT string_split(field_key, '.')[1] || '.' || string_split(field_key, '.')[2] AS family, count(*) AS fields FROM versions GROUP BY 1",
)
def _p3(spark: SparkSession, d: str) -> DataFrame:
    family = p.field_family(F.col("field_key")).alias("family")
    return b.versions(spark, d).groupBy(family).agg(F.count(F.lit(1)).alias("fields"))


@query(
    "p4_pin_upsert",
    f"""WITH {DECIDED}, pins AS (SELECT filing_id, field_key, min(field_id) AS field_id FROM versions GROUP BY 1, 2),
    ok AS (SELECT filing_id, field_key, field_id FROM dec WHERE reasons = '' QUALIFY row_number() OVER (PARTITION BY filing_id, field_key ORDER BY version DESC) = 1)
    SELECT filing_id, field_key, coalesce(ok.field_id, pins.field_id) AS field_id FROM pins LEFT JOIN ok USING (filing_id, field_key)""",
)
def _p4(spark: SparkSession, d: str) -> DataFrame:
    first = b.versions(spark, d).groupBy("filing_id", "field_key").agg(F.min("field_id").alias("field_id"))
    return p.update_pins(first, decisions(spark, d))


@query(
    "p5_pin_violations",
    f"""WITH {VERSIONS}, pins AS (SELECT filing_id, field_key, min(field_id) AS field_id FROM versions GROUP BY 1, 2)
    SELECT pins.*, qa_status FROM pins LEFT JOIN versions USING (field_id) WHERE coalesce(qa_status, '') NOT IN ('sampled_ok', 'corrected', 'provisional')""",
)
def _p5(spark: SparkSession, d: str) -> DataFrame:
    versions = b.versions(spark, d)
    first = versions.groupBy("filing_id", "field_key").agg(F.min("field_id").alias("field_id"))
    return p.pin_violations(first, versions)


BAND = "CASE WHEN confidence >= 0.90 THEN 'high' WHEN confidence >= 0.70 THEN 'medium' ELSE 'low' END"


@query("g1_confidence_band", f"WITH {VERSIONS} SELECT field_id, {BAND} AS confidence_band FROM versions")
def _g1(spark: SparkSession, d: str) -> DataFrame:
    return b.versions(spark, d).select("field_id", p.confidence_band(F.col("confidence")).alias("confidence_band"))


SAMPLE = f"""open AS (SELECT *, string_split(field_key, '.')[1] || '.' || string_split(field_key, '.')[2] AS family, {BAND} AS confidence_band FROM versions
  WHERE method = 'llm' AND qa_status = 'unreviewed' AND field_id NOT IN (SELECT doc_id FROM labels)),
sample AS (SELECT * FROM open QUALIFY row_number() OVER (PARTITION BY family, confidence_band ORDER BY CAST(field_id AS VARCHAR)) <= 5)"""


def sample(spark: SparkSession, d: str) -> DataFrame:
    queued = b.table(spark, d, "labels").select(F.col("doc_id").alias("field_id"))
    return p.review_sample(b.versions(spark, d), queued, 5)


@query("g2_stratified_sample", f"WITH {VERSIONS}, {SAMPLE} SELECT field_id, family, confidence_band FROM sample")
def _g2(spark: SparkSession, d: str) -> DataFrame:
    return sample(spark, d).select("field_id", "family", "confidence_band")


@query("g3_review_accuracy", f"WITH {VERSIONS}, {REVIEWS} SELECT family, reviewed, correct, round(correct / reviewed, 6) AS accuracy FROM fam")
def _g3(spark: SparkSession, d: str) -> DataFrame:
    return plain(accuracy(spark, d))


@query(
    "g3_corrections",
    f"""WITH {VERSIONS}, nxt AS (SELECT filing_id, field_key, max(version) + 1 AS v FROM versions GROUP BY 1, 2)
    SELECT filing_id, field_key, CAST(l.doc_id AS DOUBLE) AS value_num, 'human' AS method, 'corrected' AS qa_status, 1.0::DOUBLE AS confidence, nxt.v AS version
    FROM versions JOIN labels l ON l.doc_id = field_id AND l.quality = 0 JOIN nxt USING (filing_id, field_key)""",
)
def _g3b(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.when(F.col("quality") == 0, F.col("doc_id").cast("double"))
    reviews = b.table(spark, d, "labels").select(F.col("doc_id").alias("field_id"), wrong.alias("corrected_value"))
    return plain(p.corrections(b.versions(spark, d), reviews))


@query(
    "g4_review_queue",
    f"""WITH {VERSIONS}, {SAMPLE} SELECT field_id, s.family, s.confidence_band, s.source_page, n_chars FROM sample s
    LEFT JOIN (SELECT doc_id AS filing_id, CAST(doc_id % 50 + 1 AS INTEGER) AS source_page, n_chars FROM documents) g ON g.filing_id = s.filing_id AND g.source_page = s.source_page
    ORDER BY created_at, field_id""",
)
def _g4(spark: SparkSession, d: str) -> DataFrame:
    queue = sample(spark, d).select(
        "field_id", "family", "confidence_band", F.lit("queued").alias("status"), F.col("created_at").alias("queued_at")
    )
    pages = b.table(spark, d, "documents").select(
        F.col("doc_id").alias("filing_id"), (F.col("doc_id") % 50 + 1).cast("int").alias("source_page"), "n_chars"
    )
    fields = b.versions(spark, d).select("field_id", "filing_id", "source_page")
    return p.review_queue(queue, fields, pages).select("field_id", "family", "confidence_band", "source_page", "n_chars")


@query(
    "g5_extraction_benchmark",
    """WITH e AS (SELECT doc_id, 'p1.' || lang AS family, n_chars AS value FROM documents), a AS (SELECT doc_id, n_chars + 1 - quality AS got FROM labels JOIN documents USING (doc_id))
    SELECT family, count(*) AS expected, count(*) FILTER (WHERE got = value) AS correct, round(count(*) FILTER (WHERE got = value) / count(*), 9) AS accuracy,
      count(*) FILTER (WHERE got = value) / count(*) >= 0.98 AS passes FROM e LEFT JOIN a USING (doc_id) GROUP BY 1""",
)
def _g5(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("p1."), F.col("lang"), F.lit(".size")).alias("field_key")
    documents = b.table(spark, d, "documents")
    expected = documents.select("doc_id", key, F.col("n_chars").alias("value"))
    found = b.table(spark, d, "labels").join(documents, "doc_id")
    actual = found.select("doc_id", key, (F.col("n_chars") + 1 - F.col("quality")).alias("value"))
    rows = p.benchmark_accuracy(expected, actual, ["doc_id", "field_key"])
    return rows.withColumn("accuracy", F.round("accuracy", 9))


ITEMS = """items AS (SELECT doc_id, 'p1.' || lang AS field_key, CASE WHEN doc_id % 4 = 1 THEN 'not ' ELSE '' END || CASE WHEN doc_id % 9 = 0 THEN '' ELSE substr(text, 11, 40) END AS quote,
  doc_id % 17 = 0 AS not_found, 0.5 + (doc_id % 50) / 100.0 AS confidence FROM documents)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    quote = F.concat(
        F.when(key % 4 == 1, "not ").otherwise(""), F.when(key % 9 == 0, "").otherwise(F.substring("text", 11, 40))
    )
    return b.table(spark, d, "documents").select(
        key.alias("filing_id"),
        F.lit(1).alias("source_page"),
        F.concat(F.lit("p1."), "lang").alias("field_key"),
        quote.alias("quote"),
        (key % 17 == 0).alias("not_found"),
        ((key % 50) / 100 + 0.5).alias("confidence"),
    )


def cited_pages(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("filing_id"), F.lit(1).alias("page_no"), "text")


@query(
    "g6_citation_check",
    f"""WITH {ITEMS}, f AS (SELECT doc_id, CAST(confidence AS DOUBLE) AS confidence, concat_ws(',', CASE WHEN field_key = 'p1.es' THEN 'unexpected_field' END, CASE WHEN not_found THEN 'not_found' END,
      CASE WHEN NOT not_found AND NOT (quote <> '' AND contains(text, quote)) THEN 'source_quote_not_verbatim' END) AS flags FROM items JOIN documents USING (doc_id))
    SELECT doc_id AS filing_id, flags, round(CASE WHEN flags = '' THEN confidence ELSE 0 END, 6) AS confidence FROM f""",
)
def _g6(spark: SparkSession, d: str) -> DataFrame:
    defs = rule_table(spark, ["field_key", "dtype"], [(f"p1.{lang}", "text") for lang in ("en", "fr", "de")])
    rows = p.check_citations(items(spark, d), cited_pages(spark, d), defs)
    return plain(rows.select("filing_id", "flags", F.round("confidence", 6).alias("confidence")))


@query(
    "g7_span_and_penalty",
    f"""WITH {ITEMS}, s AS (SELECT doc_id, CAST(confidence AS DOUBLE) AS confidence, quote, CASE WHEN quote <> '' AND instr(text, quote) > 0 THEN instr(text, quote) - 1 END AS s,
      len(regexp_extract_all(quote, '[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?')) > 0 AS has_number FROM items JOIN documents USING (doc_id))
    SELECT doc_id AS filing_id, s AS start, s + length(quote) AS "end", round(CASE WHEN doc_id % 2 = 0 AND NOT has_number AND lower(trim(quote)) NOT IN ('nil', 'none', 'zero', '-', '—') THEN confidence * 0.5 ELSE confidence END, 6) AS confidence FROM s""",
)
def _g7(spark: SparkSession, d: str) -> DataFrame:
    cited = cited_pages(spark, d).select("filing_id", "text")
    rows = t.parse_numbers(items(spark, d).join(cited, "filing_id"), "quote", "parsed")
    parsed = F.col("parsed")["value"]
    numeric = F.col("filing_id") % 2 == 0
    return rows.select(
        "filing_id",
        p.locate_span(F.col("text"), F.col("quote")).alias("span"),
        F.round(p.parse_penalty(F.col("confidence"), numeric, parsed), 6).alias("confidence"),
    ).select("filing_id", "span.start", "span.end", "confidence")


@query(
    "g8_section_routing",
    """WITH s AS (SELECT DISTINCT conv_id, section FROM conversations, (VALUES ('user'), ('system')) v(section)), own AS (SELECT DISTINCT conv_id, role FROM conversations)
    SELECT s.conv_id AS filing_id, s.section, c.turn AS page_no FROM s JOIN conversations c ON c.conv_id = s.conv_id
    WHERE c.role = s.section OR NOT EXISTS (SELECT 1 FROM own WHERE own.conv_id = s.conv_id AND own.role = s.section)""",
)
def _g8(spark: SparkSession, d: str) -> DataFrame:
    pages = b.table(spark, d, "conversations").select(
        F.col("conv_id").alias("filing_id"), F.col("turn").alias("page_no"), F.col("role").alias("section_key")
    )
    wanted = F.explode(F.array(F.lit("user"), F.lit("system"))).alias("section")
    sections = pages.select("filing_id").distinct().select("filing_id", wanted)
    return p.route_sections(sections, pages)


@query(
    "g9_usage_ledger",
    """WITH c AS (SELECT conv_id, greatest(1, length(text) // 4) AS i, greatest(1, turn * 10 // 4) AS o FROM conversations)
    SELECT conv_id, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
      round(CAST(sum(i) AS DOUBLE) * 0.0000004 + CAST(sum(o) AS DOUBLE) * 0.0000016, 7) AS cost_usd FROM c GROUP BY 1""",
)
def _g9(spark: SparkSession, d: str) -> DataFrame:
    calls = b.table(spark, d, "conversations")
    rows = p.usage_ledger(calls, "conv_id", F.length("text"), F.col("turn") * 10)
    return rows.withColumn("cost_usd", F.round("cost_usd", 7))


@query(
    "v13_bulk_accept",
    f"WITH {VERSIONS} SELECT field_id, CAST(confidence AS DOUBLE) AS confidence FROM versions WHERE method = 'llm' AND confidence >= 0.90 AND qa_status = 'unreviewed'",
)
def _v13(spark: SparkSession, d: str) -> DataFrame:
    proposals = b.versions(spark, d).where("method = 'llm'").withColumnRenamed("qa_status", "review_status")
    return plain(p.bulk_accept(proposals).select("field_id", "confidence"))
