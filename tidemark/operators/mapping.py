"""Units, totals, and publishing of mapped concepts from raw facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.exprs import rule_table
from tidemark.operators.ranking import first_per_key

NUMERIC = "decimal(30,8)"


def unit_key(unit: Column) -> Column:
    return F.replace(F.lower(F.trim(unit)), F.lit(" "), F.lit(""))


def unit_table(spark: SparkSession) -> DataFrame:
    rows = [(key, family, canonical, Decimal(factor)) for key, (family, canonical, factor) in config.UNITS.items()]
    table = rule_table(spark, ["unit_key", "family", "canonical", "factor"], rows)
    return table.withColumn("factor", F.col("factor").cast("decimal(14,4)"))


def convert_units(df: DataFrame, value: str, unit: str, target: str | None = None) -> DataFrame:
    """Add ``converted``, ``converted_unit`` and ``unit_error`` (null when the conversion is fine).

    Without a target, or where it is null, the family's canonical unit is used. Unknown units and
    targets of another family give an error text instead of a value.
    """
    units = F.broadcast(unit_table(df.sparkSession))  # configuration
    source = units.select(
        F.col("unit_key").alias("__s"),
        F.col("family").alias("__sf"),
        F.col("canonical").alias("__sc"),
        F.col("factor").alias("__sx"),
    )
    goal = units.select(
        F.col("unit_key").alias("__t"),
        F.col("family").alias("__tf"),
        F.col("canonical").alias("__tc"),
        F.col("factor").alias("__tx"),
    )
    wanted = F.col(target) if target else F.lit(None).cast("string")
    rows = (
        df.withColumn("__wanted", wanted)
        .join(source, unit_key(F.col(unit)) == F.col("__s"), "left")
        .join(goal, unit_key(F.col("__wanted")) == F.col("__t"), "left")
    )
    error = (
        F.when(F.col("__s").isNull(), "unknown_unit")
        .when(F.col("__wanted").isNotNull() & F.col("__t").isNull(), "unknown_target")
        .when(F.col("__wanted").isNotNull() & (F.col("__sf") != F.col("__tf")), "incompatible_units")
    )
    canonical = (F.col(value).cast("decimal(24,6)") * F.col("__sx")).cast(NUMERIC)
    result = F.when(F.col("__wanted").isNull(), canonical).otherwise((canonical / F.col("__tx")).cast(NUMERIC))
    return (
        rows.withColumn("unit_error", error)
        .withColumn("converted", F.when(F.col("unit_error").isNull(), result))
        .withColumn("converted_unit", F.when(F.col("unit_error").isNull(), F.coalesce("__tc", "__sc")))
        .drop("__wanted", "__s", "__sf", "__sc", "__sx", "__t", "__tf", "__tc", "__tx")
    )


def check_total(total: Column, parts: Sequence[Column], tolerance: str = "0.02") -> Column:
    """Struct (passed, relative_error, flag): does the declared total match its parts?"""
    summed = parts[0]
    for part in parts[1:]:
        summed = summed + part
    error = F.abs(total - summed).cast("double") / F.greatest(F.abs(total).cast("double"), F.lit(1.0))
    passed = error <= float(tolerance)
    return F.struct(
        passed.alias("passed"),
        error.alias("relative_error"),
        F.when(~passed, "declared_total_mismatch").alias("flag"),
    )


@dataclass(frozen=True)
class ConceptMapping:
    concept: str
    field_key: str
    target_unit: str
    unit_factors: dict[str, str] = field(default_factory=dict)
    registered_scale: bool = False
    review_status: str = "provisional"


def resolve_scale(facts: DataFrame, registry: DataFrame, value: str, issuer: str) -> DataFrame:
    """Add ``absolute`` and ``scale``: amounts too large for a scaled reading are absolute already,
    others need the issuer's reviewed scale (``registry``: issuer, scale) and are null without it."""
    scales = rule_table(facts.sparkSession, ["scale", "__factor"], config.SCALE_FACTORS.items())
    known = registry.join(F.broadcast(scales), "scale").select(  # configuration
        F.upper("issuer").alias("__issuer"), F.col("scale").alias("__scale"), "__factor"
    )
    large = F.col(value) >= config.ABSOLUTE_THRESHOLD
    factor = F.when(large, F.lit(1)).otherwise(F.col("__factor"))
    return (
        facts.join(known, F.upper(F.col(issuer)) == F.col("__issuer"), "left")
        .withColumn("absolute", (F.col(value).cast("decimal(28,8)") * factor).cast(NUMERIC))
        .withColumn("scale", F.when(large, "absolute").otherwise(F.col("__scale")))
        .drop("__issuer", "__scale", "__factor")
    )


def select_facts(facts: DataFrame, concepts: Sequence[str], fy: int, context: str) -> DataFrame:
    """Facts of the wanted concepts for the fiscal year's end in the main context; last one wins."""
    wanted = facts.where(
        F.col("concept").isin(list(concepts))
        & (F.col("period_end") == F.make_date(F.lit(fy), F.lit(3), F.lit(31)))
        & (F.col("context_id") == context)
    )
    return first_per_key(wanted, ["filing_id", "concept"], F.desc("ordinal"), F.desc("fact_id"))


def publish_mappings(
    filings: DataFrame,
    facts: DataFrame,
    mappings: Sequence[ConceptMapping],
    registry: DataFrame,
    fy: int,
    context: str = "main",
    passthrough_text: bool = False,
) -> DataFrame:
    """One row per filing and active mapping with status published, withheld or missing.

    Every unit and scale that cannot be resolved withholds its own value only. Facts without a
    number count as missing, unless ``passthrough_text`` publishes their reported text
    (``facts.value_raw``). ``lineage`` says where a published value comes from and by which rules.
    ``filings``: filing_id, issuer (of the fiscal year).
    """
    spark = filings.sparkSession
    active = [m for m in mappings if m.review_status != "rejected"]
    wanted = F.array(
        *[
            F.struct(
                F.lit(m.concept).alias("concept"),
                F.lit(m.field_key).alias("field_key"),
                F.lit(m.target_unit).alias("target_unit"),
                F.lit(m.registered_scale).alias("registered_scale"),
                F.lit(m.review_status).alias("review_status"),
                F.lit(" ".join(f"{unit}={factor}" for unit, factor in sorted(m.unit_factors.items()))).alias("conversion_rules"),
            )
            for m in active
        ]
    )
    # Every filing needs every mapping: the list is configuration and rides along as a constant.
    expected = filings.select("filing_id", "issuer", F.inline(wanted))
    chosen = select_facts(facts, [m.concept for m in active], fy, context).select(
        "filing_id",
        "concept",
        "fact_id",
        "value_num",
        "unit",
        "context_id",
        "period_end",
        (F.col("value_raw") if passthrough_text else F.lit(None).cast("string")).alias("value_text"),
    )
    factors = [(m.field_key, unit, Decimal(f)) for m in active for unit, f in m.unit_factors.items()]
    rules = rule_table(spark, ["field_key", "unit", "factor"], factors)
    rules = rules.withColumn("factor", F.col("factor").cast("decimal(14,4)"))
    joined = expected.join(chosen, ["filing_id", "concept"], "left").join(
        F.broadcast(rules), ["field_key", "unit"], "left"  # configuration
    )
    scaled = resolve_scale(joined, registry, "value_num", "issuer")
    by_unit = (F.col("value_num").cast("decimal(24,6)") * F.col("factor")).cast(NUMERIC)
    value = F.when(F.col("registered_scale"), F.col("absolute")).otherwise(by_unit)
    token = F.when(F.col("registered_scale"), F.col("scale")).otherwise(F.col("unit"))
    text = F.when(F.col("value_num").isNull(), F.nullif(F.trim("value_text"), F.lit("")))
    status = (
        F.when(text.isNotNull(), "published")
        .when(F.col("value_num").isNull(), "missing")
        .when(value.isNull(), "withheld")
        .otherwise("published")
    )
    lineage = F.struct(
        F.col("concept").alias("source_concept"),
        "context_id",
        "period_end",
        F.col("unit").alias("reported_unit"),
        "review_status",
        "conversion_rules",
    )
    return scaled.select(
        "filing_id",
        "field_key",
        "fact_id",
        F.when(status == "published", lineage).alias("lineage"),
        "target_unit",
        status.alias("status"),
        F.when(status == "published", value).alias("value_num"),
        F.when(status == "published", token).alias("resolved_scale"),
        *([text.alias("value_text")] if passthrough_text else []),
    )


def reuse_versions(published: DataFrame, latest: DataFrame, mapping_version: str) -> DataFrame:
    """Version per published value: kept when fact and mapping version are the same, else the next.

    ``latest``: filing_id, field_key, version, fact_id, mapping_version of the newest versions.
    """
    old = latest.select(
        "filing_id",
        "field_key",
        "version",
        F.col("fact_id").alias("old_fact"),
        F.col("mapping_version").alias("old_mapping"),
    )
    same = F.coalesce(
        (F.col("old_fact") == F.col("fact_id")) & (F.col("old_mapping") == mapping_version), F.lit(False)
    )
    return (
        published.where(F.col("status") == "published")
        .join(old, ["filing_id", "field_key"], "left")
        .withColumn("reused", same)
        .withColumn("version", F.when(same, F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1))
        .drop("old_fact", "old_mapping")
    )


def publish_counts(published: DataFrame, reused: DataFrame) -> DataFrame:
    """created, pinned, missing and withheld of a publishing run, in one row."""
    totals = published.agg(
        F.count_if(F.col("status") == "published").alias("pinned"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "withheld").alias("withheld"),
    )
    created = reused.agg(F.count_if(~F.col("reused"))).scalar()
    return totals.select(created.alias("created"), "pinned", "missing", "withheld")


def pins_after_publish(pins: DataFrame, published: DataFrame, rejected_keys: Sequence[str]) -> DataFrame:
    """Pins left standing: not of rejected mappings and not of values withheld now."""
    withheld = published.where(F.col("status") == "withheld").select("filing_id", "field_key")
    kept = pins.where(~F.col("field_key").isin(list(rejected_keys))) if rejected_keys else pins
    return kept.join(withheld, ["filing_id", "field_key"], "left_anti")
