"""Disclosure scores: C1-C5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog import query
from tidemark.catalog.fragments import NARRATIVES
from tidemark.functions import text as t
from tidemark.operators import scores as s

DEFS = ", ".join(f"('{key}', '{dtype}', {str(core).lower()})" for key, dtype, core in b.FORM_FIELDS)
KEYS = ", ".join(f"'{key}'" for key, _, _ in b.FORM_FIELDS[:12])

PINNED = f"""{NARRATIVES}, defs(field_key, dtype, core) AS (VALUES {DEFS}),
keyed AS (SELECT *, ([{KEYS}])[CAST((doc_id // 20) % 12 + 1 AS INTEGER)] AS field_key FROM narr),
pinned AS (SELECT company || '/' || lang AS filing_id, company AS company_id, CASE lang WHEN 'en' THEN 2025 WHEN 'fr' THEN 2024 WHEN 'es' THEN 2023 ELSE 2022 END AS fy, field_key,
  CASE WHEN field_key IN ('p6.e1.energy', 'p6.e2.water') THEN CAST(n_chars AS VARCHAR) WHEN field_key = 'p5.assured.flag' THEN CASE WHEN doc_id % 4 = 0 THEN 'true' ELSE 'false' END
    WHEN field_key = 'p6.assurance.status' THEN CASE n_chars % 3 WHEN 0 THEN 'nil' WHEN 1 THEN 'No' ELSE 'Reasonable assurance' END ELSE text END AS value_raw,
  CASE WHEN doc_id % 3 = 0 THEN 'xbrl' ELSE 'llm' END AS method, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 50 END AS source_page, doc_id % 5 <> 0 AS has_span,
  sha256('pin/' || doc_id) AS pin_id FROM keyed)"""

COMPLETE = """pres AS (SELECT DISTINCT filing_id, company_id, fy, field_key FROM pinned),
comp AS (SELECT filing_id, company_id, fy, count(*) FILTER (WHERE core) AS core_present, (SELECT count(*) FROM defs WHERE core) AS core_total,
  count(*) FILTER (WHERE NOT core) AS essential_present, (SELECT count(*) FROM defs WHERE NOT core) AS essential_total FROM pres JOIN defs USING (field_key) GROUP BY 1, 2, 3),
compl AS (SELECT *, core_present * 2 + essential_present AS weighted_points, core_total * 2 + essential_total AS weighted_possible,
  round_even((core_present * 2 + essential_present) * 100.0::DOUBLE / (core_total * 2 + essential_total), 4) AS value FROM comp)"""


@query("c1_completeness", f"WITH {PINNED}, {COMPLETE} SELECT * FROM compl")
def _c1(spark: SparkSession, d: str) -> DataFrame:
    return s.completeness(b.pinned_fields(spark, d), b.form_fields(spark))


# DuckDB's word boundaries are ASCII; the ones meant here count accented letters as letters.
L, R = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"
SIGNAL_SQL = {
    "quantified_target": f"regexp_matches(lower({{0}}), '{L}\\d+(?:\\.\\d+)?\\s*(?:%|percent{R}|mt{R}|gj{R}|kl{R}|tco2e{R})') AND regexp_matches(lower({{0}}), '{L}(?:target|commit|reduce|achieve)')",
    "dated_commitment": f"regexp_matches(lower({{0}}), '{L}(?:by|before|until)\\s+(?:fy\\s*)?20\\d{{{{2}}}}{R}')",
    "methodology": f"regexp_matches(lower({{0}}), '{L}(?:ghg protocol|iso\\s*\\d+|gri|sasb|science based targets|methodology){R}')",
}


def _signal(name: str, column: str) -> str:
    return SIGNAL_SQL[name].replace("{0}", column).replace("{{", "{").replace("}}", "}")


@query(
    "c2_narrative_signals",
    f"WITH {NARRATIVES} SELECT doc_id, " + ", ".join(f"{_signal(n, 'text')} AS {n}" for n in t.SIGNALS) + " FROM narr",
)
def _c2(spark: SparkSession, d: str) -> DataFrame:
    signals = t.narrative_signals(F.col("text"))
    return b.narratives(spark, d).select("doc_id", *[hit.alias(name) for name, hit in signals.items()])


SUBSTANCE = f"""txt AS (SELECT * FROM pinned WHERE field_key IN (SELECT field_key FROM defs WHERE dtype = 'text') AND value_raw <> ''),
sig AS (SELECT filing_id, {', '.join(f"bool_or({_signal(n, 'value_raw')}) AS {n}" for n in t.SIGNALS)} FROM txt GROUP BY 1),
wd AS (SELECT filing_id, company_id, regexp_extract_all(lower(value_raw), '[a-z0-9]+') AS w FROM txt),
ph AS (SELECT DISTINCT filing_id, company_id, array_to_string(w[i:i+7], ' ') AS phrase FROM wd, unnest(range(1, len(w) - 6)) AS r(i)),
shr AS (SELECT phrase FROM ph GROUP BY 1 HAVING count(DISTINCT company_id) >= 3),
subst AS (SELECT f.filing_id, f.company_id, f.fy, coalesce(any_value(quantified_target), false) AS quantified_target, coalesce(any_value(dated_commitment), false) AS dated_commitment,
  coalesce(any_value(methodology), false) AS methodology, count(ph.phrase) AS phrase_count, count(shr.phrase) AS boilerplate_phrases,
  1 - count(shr.phrase) / greatest(1, count(ph.phrase)) AS originality
  FROM (SELECT DISTINCT filing_id, company_id, fy FROM pinned) f LEFT JOIN sig ON sig.filing_id = f.filing_id LEFT JOIN ph ON ph.filing_id = f.filing_id LEFT JOIN shr ON shr.phrase = ph.phrase GROUP BY 1, 2, 3),
substv AS (SELECT *, round_even((quantified_target::INT * 0.35::DOUBLE + dated_commitment::INT * 0.25::DOUBLE + methodology::INT * 0.20::DOUBLE + originality * 0.20::DOUBLE) * 100, 4) AS value FROM subst)"""


@query(
    "c3_substance",
    f"WITH {PINNED}, {SUBSTANCE} SELECT * REPLACE (round(originality, 6) AS originality, round(value, 3) AS value) FROM substv",
)
def _c3(spark: SparkSession, d: str) -> DataFrame:
    rows = s.substance(b.pinned_fields(spark, d), b.form_fields(spark))
    return rows.withColumns({"originality": F.round("originality", 6), "value": F.round("value", 3)})


READY = """ready AS (SELECT filing_id, company_id, fy, bool_or((contains(field_key, 'assurance') OR contains(field_key, 'assured')) AND lower(trim(value_raw)) NOT IN ('', 'false', 'no', 'nil')) AS assurance,
  avg((has_span AND (source_page IS NOT NULL OR method = 'xbrl'))::INT) AS lineage_quality FROM pinned GROUP BY 1, 2, 3),
readyv AS (SELECT ready.*, coalesce(core_present, 0) / greatest(1, (SELECT count(*) FROM defs WHERE core)) AS core_coverage,
  round_even((assurance::INT * 0.40::DOUBLE + coalesce(core_present, 0) / greatest(1, (SELECT count(*) FROM defs WHERE core)) * 0.35::DOUBLE + lineage_quality * 0.25::DOUBLE) * 100, 4) AS value
  FROM ready LEFT JOIN comp USING (filing_id))"""


@query(
    "c4_assurance_readiness",
    f"WITH {PINNED}, {COMPLETE}, {READY} SELECT filing_id, company_id, fy, assurance, round(core_coverage, 6) AS core_coverage, round(lineage_quality, 6) AS lineage_quality, round(value, 3) AS value FROM readyv",
)
def _c4(spark: SparkSession, d: str) -> DataFrame:
    rows = s.assurance_readiness(b.pinned_fields(spark, d), b.form_fields(spark))
    digits = {"core_coverage": 6, "lineage_quality": 6, "value": 3}
    return rows.withColumns({name: F.round(name, n) for name, n in digits.items()})


@query(
    "c5_score_output",
    f"""WITH {PINNED}, {COMPLETE}, {SUBSTANCE}, {READY}, anc AS (SELECT filing_id, min(pin_id) AS pin_id FROM pinned GROUP BY 1),
    u AS (SELECT filing_id, company_id, fy, 'completeness' AS score_key, value, CAST(core_present AS VARCHAR) AS first_part FROM compl
      UNION ALL SELECT filing_id, company_id, fy, 'substance', value, CAST(quantified_target AS VARCHAR) FROM substv
      UNION ALL SELECT filing_id, company_id, fy, 'assurance_readiness', value, CAST(assurance AS VARCHAR) FROM readyv)
    SELECT sha256(concat_ws('/', 'score', company_id, fy, score_key, '1.1.0')) AS score_id, filing_id, score_key, round(value, 3) AS value, first_part, '{s.config_hash()}' AS config_sha256, '1.1.0' AS method_version, pin_id
    FROM u JOIN anc USING (filing_id)""",
)
def _c5(spark: SparkSession, d: str) -> DataFrame:
    rows = s.score_rows(b.pinned_fields(spark, d), b.form_fields(spark))
    part = F.coalesce(*[F.try_element_at("components", F.lit(k)) for k in ("core_present", "quantified_target", "assurance")])
    return rows.select(
        "score_id",
        "filing_id",
        "score_key",
        F.round(F.col("value").cast("double"), 3).alias("value"),
        part.alias("first_part"),
        F.col("components")["config_sha256"].alias("config_sha256"),
        "method_version",
        "pin_id",
    )
