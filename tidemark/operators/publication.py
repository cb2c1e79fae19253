"""Publication, review and quality of extracted-field versions."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.ranking import first_per_key
from tidemark.operators.relational import append_versions, upsert

FIELD = ("filing_id", "field_key")


def field_family(field_key: Column) -> Column:
    """First two dotted parts of a field key."""
    return F.substring_index(field_key, ".", 2)


def confidence_band(confidence: Column) -> Column:
    value = F.coalesce(confidence, F.lit(0))
    return F.when(value >= Decimal("0.90"), "high").when(value >= Decimal("0.70"), "medium").otherwise("low")


def qa_passed(status: Column) -> Column:
    return F.coalesce(status.isin(list(config.QA_PASSED)), F.lit(False))


def latest_publishable(versions: DataFrame) -> DataFrame:
    """Newest version of each field whose review passed; others never reach publication."""
    return first_per_key(versions.where(qa_passed(F.col("qa_status"))), FIELD, F.desc("version"))


def publish_decision(
    versions: DataFrame,
    accuracy: DataFrame,
    confidence: str = config.PUBLISH_CONFIDENCE,
    target: str = config.FAMILY_ACCURACY_TARGET,
) -> DataFrame:
    """Every version with the gates it fails; ``allowed`` where none does.

    ``accuracy`` has one row per field family.
    """
    rows = versions.withColumn("family", field_family(F.col("field_key"))).join(
        accuracy.select("family", "accuracy"), "family", "left"
    )
    gates = {
        "qa_not_passed": ~qa_passed(F.col("qa_status")),
        "confidence_below_threshold": F.coalesce(F.col("confidence") < Decimal(confidence), F.lit(True)),
        "family_accuracy_below_target": F.coalesce(F.col("accuracy") < Decimal(target), F.lit(True)),
    }
    reasons = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in gates.items()]))
    return rows.withColumn("reasons", reasons).withColumn("allowed", F.size("reasons") == 0)


def update_pins(pins: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pins after publishing: the newest allowed version per field replaces its pin."""
    allowed = first_per_key(decisions.where("allowed"), FIELD, F.desc("version"))
    return upsert(pins, allowed.select(*FIELD, "field_id"), FIELD)


def pin_violations(pins: DataFrame, versions: DataFrame, provisional_ok: bool = True) -> DataFrame:
    """Pins that point to a version which neither passed review nor is marked provisional."""
    allowed = qa_passed(F.col("qa_status"))
    if provisional_ok:
        allowed = allowed | (F.col("qa_status") == "provisional")
    target = versions.select("field_id", "qa_status")
    return pins.join(target, "field_id", "left").where(~F.coalesce(allowed, F.lit(False)))


def review_sample(fields: DataFrame, queued: DataFrame, per_stratum: int = 5) -> DataFrame:
    """First ids per (family, confidence band) of unreviewed machine fields not yet queued."""
    open_fields = fields.where((F.col("method") == "llm") & (F.col("qa_status") == "unreviewed")).join(
        queued.select("field_id"), "field_id", "left_anti"
    )
    strata = open_fields.withColumn("family", field_family(F.col("field_key"))).withColumn(
        "confidence_band", confidence_band(F.col("confidence"))
    )
    return first_per_key(strata, ["family", "confidence_band"], F.col("field_id").cast("string").asc(), n=per_stratum)


def family_accuracy(reviews: DataFrame) -> DataFrame:
    """Reviewed and correct counts per family, with their ratio."""
    return (
        reviews.groupBy("family")
        .agg(F.count(F.lit(1)).alias("reviewed"), F.count_if("correct").alias("correct"))
        .withColumn("accuracy", (F.col("correct") / F.col("reviewed")).cast("decimal(7,6)"))
    )


def corrections(versions: DataFrame, reviews: DataFrame) -> DataFrame:
    """New versions for corrected fields: human value, full confidence, status 'corrected'.

    ``reviews`` has ``field_id, corrected_value`` with at most one correction per field.
    """
    base = versions.join(reviews.where(F.col("corrected_value").isNotNull()), "field_id").select(
        *FIELD,
        F.col("corrected_value").alias("value_num"),
        F.lit("human").alias("method"),
        F.lit("corrected").alias("qa_status"),
        F.lit(Decimal("1.0000")).alias("confidence"),
    )
    return append_versions(versions, base, FIELD)


def review_queue(reviews: DataFrame, fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Queued reviews with their evidence page, oldest first."""
    return (
        reviews.where(F.col("status") == "queued")
        .join(fields, "field_id")
        .join(pages, ["filing_id", "source_page"], "left")
        .orderBy("queued_at", "field_id")
    )


def benchmark_accuracy(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], target: str = config.FAMILY_ACCURACY_TARGET
) -> DataFrame:
    """Exact-match share per family against a golden set; missing answers count as wrong."""
    found = actual.select(*keys, F.col("value").alias("got"))
    hit = F.coalesce(F.col("got") == F.col("value"), F.lit(False))
    return (
        expected.join(found, list(keys), "left")
        .groupBy(field_family(F.col("field_key")).alias("family"))
        .agg(F.count(F.lit(1)).alias("expected"), F.count_if(hit).alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("expected"))
        .withColumn("passes", F.col("accuracy") >= float(target))
    )


def check_citations(items: DataFrame, pages: DataFrame, field_defs: DataFrame) -> DataFrame:
    """Extraction items with flags; any flag sets the confidence to 0.

    ``items``: filing_id, field_key, source_page, quote, confidence, not_found. The quote must
    occur on the cited page word for word. A not-found item carries no citation to check.
    """
    known = field_defs.select("field_key", F.lit(True).alias("known"))
    cited = pages.select("filing_id", F.col("page_no").alias("source_page"), "text")
    joined = items.join(known, "field_key", "left").join(cited, ["filing_id", "source_page"], "left")
    verbatim = F.coalesce((F.length("quote") > 0) & F.col("text").contains(F.col("quote")), F.lit(False))
    flags = F.array_compact(
        F.array(
            F.when(F.col("known").isNull(), F.lit("unexpected_field")),
            F.when(F.col("not_found"), F.lit("not_found")),
            F.when(~F.col("not_found") & ~verbatim, F.lit("source_quote_not_verbatim")),
        )
    )
    return (
        joined.withColumn("flags", flags)
        .withColumn("confidence", F.when(F.size("flags") == 0, F.col("confidence")).otherwise(F.lit(0.0)))
        .drop("known")
    )


def locate_span(text: Column, quote: Column) -> Column:
    """Zero-based start and end of the quote in the text, both null when it does not occur."""
    at = F.when(F.length(quote) > 0, F.instr(text, quote) - 1)
    found = at >= 0
    return F.struct(
        F.when(found, at).alias("start"), F.when(found, at + F.length(quote)).alias("end")
    )


def parse_penalty(confidence: Column, numeric_field: Column, parsed: Column) -> Column:
    """Half the confidence where a numeric field's text gave no number."""
    return F.when(numeric_field & parsed.isNull(), confidence * 0.5).otherwise(confidence)


def route_sections(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages to read per (filing, section): its own pages, or all pages where it has none.

    ``sections``: filing_id, section. Own pages come from an equi join; only sections without any
    fall back to the filing's pages.
    """
    own = sections.join(pages.withColumnRenamed("section_key", "section"), ["filing_id", "section"])
    with_pages = pages.select("filing_id", F.col("section_key").alias("section")).distinct()
    without = sections.join(with_pages, ["filing_id", "section"], "left_anti")
    fallback = without.join(pages.drop("section_key"), "filing_id")
    return own.unionByName(fallback)


def usage_ledger(calls: DataFrame, key: str, input_chars: Column, output_chars: Column) -> DataFrame:
    """Tokens (four characters each, at least one per call) and cost per key."""
    tokens = lambda chars: F.greatest(F.lit(1), F.floor(chars / 4))
    # fixed values: cost per input and output token
    cost = F.col("input_tokens") * Decimal("0.0000004") + F.col("output_tokens") * Decimal("0.0000016")
    counted = calls.select(key, tokens(input_chars).alias("input_tokens"), tokens(output_chars).alias("output_tokens"))
    return counted.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(cost.cast("decimal(18,7)")).cast("double").alias("cost_usd"),
    )


def bulk_accept(proposals: DataFrame, threshold: str = config.BULK_ACCEPT_CONFIDENCE) -> DataFrame:
    """Unreviewed proposals confident enough to be accepted together."""
    return proposals.where(
        (F.col("confidence") >= Decimal(threshold)) & (F.col("review_status") == "unreviewed")
    )
