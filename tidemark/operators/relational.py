"""Relational jobs over filings, versions and results: joins, counts, rewrites by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import rule_table


def aggregate_dataset(
    scores: DataFrame,
    companies: DataFrame,
    measures: Sequence[str],
    minimum: int = 5,
    latest_only: bool = True,
) -> DataFrame:
    """Public aggregate: sector x year x measure with count and average, small cohorts left out.

    Only the newest method version counts, so that a cohort never mixes two scales;
    ``latest_only=False`` keeps all versions.
    """
    rows = scores.where(F.col("score_key").isin(list(measures)))
    if latest_only:
        rows = rows.where(F.col("method_version") == scores.agg(F.max("method_version")).scalar())
    return (
        rows.join(companies.select("company_id", "sector"), "company_id")
        .groupBy("sector", "fy", F.col("score_key").alias("measure"))
        .agg(F.count(F.lit(1)).alias("company_count"), F.round(F.avg("value"), 4).alias("average_value"))
        .where(F.col("company_count") >= minimum)
    )


def coverage(
    companies: DataFrame, filings: DataFrame, fy: int, statuses: Sequence[str] = ("fetched",)
) -> DataFrame:
    """Companies and fetched filings per sector and band, with one total row (nulls as labels)."""
    year = filings.where(F.col("fy") == fy).select("company_id", "status")
    return (
        companies.join(year, "company_id", "left")
        .groupingSets([["sector", "mcap_band"], []], "sector", "mcap_band")
        .agg(
            F.count(F.lit(1)).alias("companies"),
            F.count_if(F.col("status").isin(list(statuses))).alias("fetched"),
        )
        .withColumn("coverage_percent", F.bround(F.col("fetched") * 100.0 / F.col("companies"), 2))
    )


def count_by(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Rows per value, most common first; ties by value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key)


def usage_since(ledger: DataFrame, key: str, amount: Column, at: Column, since: str) -> DataFrame:
    """Sum since a moment per key; keys without usage since then show 0."""
    recent = F.sum(F.when(at >= F.lit(since).cast("timestamp"), amount))
    return ledger.groupBy(key).agg(F.coalesce(recent, F.lit(0)).alias("used"))


def next_versions(existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The version number that a new row of each key gets."""
    return existing.groupBy(*keys).agg((F.max("version") + 1).alias("next_version"))


def append_versions(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows (one per key) stamped with the next version of their key; 1 for a new key."""
    stamped = new.join(next_versions(existing, keys), list(keys), "left")
    return stamped.withColumn("version", F.coalesce("next_version", F.lit(1))).drop("next_version")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after insert-or-replace: untouched old rows and all changed rows."""
    untouched = current.join(changes.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(changes)


def delete_keys(current: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def update_where(current: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Rows that meet the condition get the new values; all others stay."""
    matches = F.coalesce(condition, F.lit(False))
    changed = {name: F.when(matches, value).otherwise(F.col(name)) for name, value in values.items()}
    return current.withColumns(changed)


def key_sets(present: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with whether it is present, in the reference, or both (one shuffle for all three)."""
    tagged = present.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(
        reference.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("r"))
    )
    sides = tagged.groupBy(*keys).agg(F.max("p").alias("p"), F.max("r").alias("r"))
    side = (
        F.when((F.col("p") == 1) & (F.col("r") == 1), "both")
        .when(F.col("p") == 1, "present_only")
        .otherwise("reference_only")
    )
    return sides.select(*keys, side.alias("side"))


def score_drift(scores: DataFrame, old: str, new: str) -> DataFrame:
    """How far scores moved between two method versions, per score key.

    One conditional aggregation over the score table replaces its join with itself.
    """
    at = lambda version: F.max(F.when(F.col("method_version") == version, F.col("value")))
    both = (
        scores.where(F.col("method_version").isin(old, new))
        .groupBy("company_id", "fy", "score_key")
        .agg(at(old).alias("old"), at(new).alias("new"))
        .where(F.col("old").isNotNull() & F.col("new").isNotNull())
    )
    moved = F.abs(F.col("new") - F.col("old"))
    return both.groupBy("score_key").agg(
        F.count(F.lit(1)).alias("compared"),
        F.avg(moved).cast("double").alias("mean_absolute_drift"),
        F.max(moved).cast("double").alias("maximum_absolute_drift"),
    )


def filing_inventory(
    companies: DataFrame, filings: DataFrame, facts: DataFrame, pins: DataFrame
) -> DataFrame:
    """All companies with their filings and the number of raw facts and pins of each.

    Both sides are counted by filing before the joins, so nothing fans out.
    """
    raw = facts.groupBy("filing_id").agg(F.count(F.lit(1)).alias("raw_fact_count"))
    mapped = pins.groupBy("filing_id").agg(F.count(F.lit(1)).alias("mapped_field_count"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return (
        companies.join(filings, "company_id", "left")
        .join(raw, "filing_id", "left")
        .join(mapped, "filing_id", "left")
        .select(
            "company_id",
            "company",
            "filing_id",
            "fy",
            F.coalesce("status", F.lit("registered")).alias("status"),
            zero("raw_fact_count"),
            zero("mapped_field_count"),
        )
    )


def lineage_rows(
    pins: DataFrame, fields: DataFrame, field_defs: DataFrame, pages: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Source of every pin: field, definition, evidence page if any, and published annotations.

    Annotations come as rows, not as a list, so a heavily annotated pin stays splittable.
    """
    published = annotations.where(F.col("status") == "published").select("pin_id", "annotation_id")
    return (
        pins.join(fields, "field_id")
        .join(field_defs, "field_key")
        .join(pages, ["filing_id", "source_page"], "left")
        .join(published, "pin_id", "left")
    )


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no parent: violations of a reference."""
    return rows.join(parents.select(key), key, "left_anti")


def measure_registry(spark, measures: dict) -> DataFrame:  # noqa: ANN001 - session and catalogue
    """Measure metadata as a small table."""
    rows = [(key, m.additive, m.polarity, m.unit) for key, m in measures.items()]
    return rule_table(spark, ["metric_key", "additive", "polarity", "unit"], rows)
