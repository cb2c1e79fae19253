"""Disclosure scores per filing: completeness, substance, assurance readiness.

``pinned``: filing_id, company_id, fy, field_key, value_raw, method, source_page, has_span, pin_id -
one row per published field. ``field_defs``: field_key, dtype, core.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import text as t
from tidemark.functions.exprs import stable_key
from tidemark.operators import text as x

FILING = ("filing_id", "company_id", "fy")
NIL_ASSURANCE = ("", "false", "no", "nil")  # fixed values: answers that mean no assurance


def _marked(pinned: DataFrame, field_defs: DataFrame) -> DataFrame:
    """Distinct present fields of each filing with their core flag; unknown keys do not count."""
    present = pinned.select(*FILING, "field_key").distinct()
    return present.join(field_defs.select("field_key", "core"), "field_key")


def _totals(field_defs: DataFrame) -> tuple[Column, Column]:
    core = field_defs.agg(F.count_if("core")).scalar()
    essential = field_defs.agg(F.count_if(~F.col("core"))).scalar()
    return core, essential


def completeness(pinned: DataFrame, field_defs: DataFrame, weights: dict[str, Any] | None = None) -> DataFrame:
    """Weighted share of the form's fields that are present, with its parts."""
    weights = weights or config.SCORING["completeness"]
    core_total, essential_total = _totals(field_defs)
    filings = pinned.select(*FILING).distinct()
    counts = _marked(pinned, field_defs).groupBy(*FILING).agg(
        F.count_if("core").alias("core_present"), F.count_if(~F.col("core")).alias("essential_present")
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    rows = filings.join(counts, list(FILING), "left").select(
        *FILING,
        zero("core_present"),
        core_total.alias("core_total"),
        zero("essential_present"),
        essential_total.alias("essential_total"),
    )
    points = F.col("core_present") * weights["core_weight"] + F.col("essential_present") * weights["essential_weight"]
    possible = F.col("core_total") * weights["core_weight"] + F.col("essential_total") * weights["essential_weight"]
    value = F.when(possible > 0, F.bround(points * 100.0 / possible, 4)).otherwise(F.lit(0.0))
    return rows.withColumns({"weighted_points": points, "weighted_possible": possible, "value": value})


def substance(pinned: DataFrame, field_defs: DataFrame, weights: dict[str, Any] | None = None) -> DataFrame:
    """Signals found in any text of the filing, and the share of its phrases that are its own.

    Phrases used by several companies are boilerplate. The texts are cut into shingles once; both
    the company counts and the filings' own phrases come from that table of keys.
    """
    weights = weights or config.SCORING["substance"]
    texts = pinned.join(field_defs.where("dtype = 'text'").select("field_key"), "field_key", "left_semi").where(
        F.col("value_raw") != ""
    )
    signals = t.narrative_signals(F.col("value_raw"))
    any_signal = texts.select("filing_id", *[hit.alias(name) for name, hit in signals.items()]).groupBy("filing_id")
    any_signal = any_signal.agg(*[F.bool_or(name).alias(name) for name in t.SIGNALS])
    phrases = x.distinct_phrases(texts, ["filing_id", "company_id"], "value_raw", weights["phrase_words"], several=True)
    shared = x.boilerplate(phrases, "company_id", weights["company_threshold"])
    filings = pinned.select(*FILING).distinct()
    own = x.originality(phrases, filings, "filing_id", shared)
    rows = filings.join(any_signal, "filing_id", "left").join(own, "filing_id")
    rows = rows.withColumns({name: F.coalesce(name, F.lit(False)) for name in t.SIGNALS})
    raw = F.col("originality") * float(weights["originality"])
    for name in t.SIGNALS:
        raw = raw + F.col(name).cast("int") * float(weights[name])
    return rows.withColumn("value", F.bround(raw * 100, 4))


def assurance_readiness(pinned: DataFrame, field_defs: DataFrame, weights: dict[str, Any] | None = None) -> DataFrame:
    """External assurance, core coverage and traceable lineage."""
    weights = weights or config.SCORING["assurance_readiness"]
    core_total, _ = _totals(field_defs)
    key = F.col("field_key")
    answered = ~F.lower(F.trim("value_raw")).isin(list(NIL_ASSURANCE))
    assured = (key.contains("assurance") | key.contains("assured")) & answered
    span = F.coalesce(F.col("has_span"), F.lit(False))
    traced = span & (F.col("source_page").isNotNull() | (F.col("method") == "xbrl"))
    shares = pinned.groupBy(*FILING).agg(
        F.bool_or(F.coalesce(assured, F.lit(False))).alias("assurance"),
        F.avg(traced.cast("int")).alias("lineage_quality"),
    )
    core = _marked(pinned, field_defs).groupBy(*FILING).agg(F.count_if("core").alias("core_present"))
    rows = shares.join(core, list(FILING), "left").select(
        *FILING,
        "assurance",
        (F.coalesce("core_present", F.lit(0)) / F.greatest(F.lit(1), core_total)).alias("core_coverage"),
        "lineage_quality",
    )
    raw = (
        F.col("assurance").cast("int") * float(weights["assurance"])
        + F.col("core_coverage") * float(weights["core_coverage"])
        + F.col("lineage_quality") * float(weights["lineage"])
    )
    return rows.withColumn("value", F.bround(raw * 100, 4))


def config_hash(scoring: dict[str, Any] | None = None) -> str:
    text = json.dumps(scoring or config.SCORING, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()




def score_rows(pinned: DataFrame, field_defs: DataFrame, scoring: dict[str, Any] | None = None) -> DataFrame:
    """The scores table: one row per filing and score with components, version and anchor pin."""
    scoring = scoring or config.SCORING
    digest = config_hash(scoring)
    parts = {
        "completeness": (
            completeness(pinned, field_defs, scoring["completeness"]),
            ("core_present", "core_total", "essential_present", "essential_total", "weighted_points", "weighted_possible"),
        ),
        "substance": (
            substance(pinned, field_defs, scoring["substance"]),
            (*t.SIGNALS, "originality", "boilerplate_phrases", "phrase_count"),
        ),
        "assurance_readiness": (
            assurance_readiness(pinned, field_defs, scoring["assurance_readiness"]),
            ("assurance", "core_coverage", "lineage_quality"),
        ),
    }
    anchors = pinned.groupBy("filing_id").agg(F.min("pin_id").alias("pin_id"))
    out = None
    for key, (rows, names) in parts.items():
        kinds = dict(rows.dtypes)
        entries: list[Column] = []
        for name in names:
            value = F.col(name).cast("decimal(10,4)") if kinds[name] == "double" else F.col(name)
            entries += [F.lit(name), value.cast("string")]
        entries += [F.lit("config_sha256"), F.lit(digest)]
        one = rows.select(
            *FILING,
            F.lit(key).alias("score_key"),
            F.col("value").cast("decimal(10,4)").alias("value"),
            F.create_map(*entries).alias("components"),
        )
        out = one if out is None else out.unionByName(one)
    assert out is not None
    version = F.lit(scoring["method_version"])
    return out.join(anchors, "filing_id").select(
        stable_key("score", "company_id", "fy", "score_key", version).alias("score_id"),
        *FILING,
        "score_key",
        "value",
        "components",
        version.alias("method_version"),
        "pin_id",
    )
