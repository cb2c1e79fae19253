"""Cohort statistics over a (group, value) result set. Null and non-finite values are dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import is_finite, safe_ratio
from tidemark.operators.skew import salted_join
from tidemark.operators.ranking import attach_ranks, first_per_key, ordered_counts, quantiles_of_counts

MAX_BINS = 20


def _clean(df: DataFrame, value: str) -> DataFrame:
    return df.where(is_finite(F.col(value)))


def five_number_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, min, q1, median, q3, max, mean, iqr and total per group."""
    ranks = ordered_counts(_clean(df, value), keys, value)
    x = F.col(value)
    return (
        quantiles_of_counts(
            ranks,
            keys,
            value,
            {"q1": 0.25, "median": 0.5, "q3": 0.75},
            F.sum("n").alias("n"),
            F.min(x).cast("double").alias("min"),
            F.max(x).cast("double").alias("max"),
            F.sum(x * F.col("n")).cast("double").alias("total"),
        )
        .where(F.col("n") > 0)
        .withColumn("mean", F.col("total") / F.col("n"))
        .withColumn("iqr", F.col("q3") - F.col("q1"))
    )


def at_or_below_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "percentile") -> DataFrame:
    """Share of the group's rows at or below the row's value, in percent."""
    ranked = attach_ranks(_clean(df, value), keys, value)
    share = (F.col("below") + F.col("n")) / F.col("total") * 100
    return ranked.withColumn(out, share).drop("n", "below", "total")


def _top_share_sums(value: str, k: int) -> list[Column]:
    """Aggregates over ordered counts: non-negative rows, their sum, and the sum of the k largest.

    Equal values are collapsed there, so "the k largest" is how many copies fall into the top k
    places; negative values come last and never get a place that a non-negative one wants.
    """
    counted = F.when(F.col(value) >= 0, F.col("n"))
    above = F.col("total") - F.col("below") - F.col("n")
    taken = F.greatest(F.lit(0), F.least(counted, F.lit(k) - above))
    return [
        F.coalesce(F.sum(counted), F.lit(0)).alias("positive_n"),
        F.sum(F.col(value) * counted).cast("double").alias("positive_total"),
        F.sum(F.when(F.col(value) >= 0, F.col(value) * taken)).cast("double").alias("positive_top"),
    ]


def _top_share(k: int) -> Column:
    enough = (F.col("positive_n") > k) & (F.col("positive_total") > 0)
    return F.when(enough, F.col("positive_top") / F.col("positive_total") * 100)


def top_share(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Combined share of the k largest non-negative values; null unless more than k rows, total > 0."""
    ranks = ordered_counts(_clean(df, value).where(F.col(value) >= 0), keys, value)
    sums = ranks.groupBy(*keys).agg(*_top_share_sums(value, k))
    return sums.select(*keys, F.col("positive_n").alias("n"), _top_share(k).alias("share"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 8) -> DataFrame:
    """Equal-width bins per group; the maximum falls into the last bin, empty bins are kept."""
    bins = max(1, min(MAX_BINS, bins))
    clean = _clean(df, value).select(*keys, F.col(value).cast("double").alias("x"))
    edges = clean.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    edges = edges.select(
        *keys, "lo", "hi", F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins).alias("bins")
    ).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    # Counting equal values first keeps the join with the edges small and even.
    counted = clean.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
    placed = salted_join(counted, edges, keys, "x").select(
        *keys,
        F.when(F.col("bins") == 1, 0)
        .otherwise(F.least(F.col("bins") - 1, F.floor((F.col("x") - F.col("lo")) / F.col("width"))))
        .cast("int")
        .alias("bin"),
        "n",
    )
    filled = placed.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    frame = edges.select(
        *keys, "lo", "hi", "bins", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")
    )
    return frame.join(filled, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("from"),
        F.when(F.col("bins") == 1, F.col("hi"))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("width"))
        .alias("to"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def first_to_last(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Signed change from the first to the last point; groups with one point give no row."""
    ends = (
        _clean(df, value)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.min_by(value, order).cast("double").alias("first"),
            F.max_by(value, order).cast("double").alias("last"),
        )
        .where(F.col("points") >= 2)
    )
    absolute = F.col("last") - F.col("first")
    return ends.select(
        *keys,
        "points",
        absolute.alias("absolute"),
        (safe_ratio(absolute, F.abs(F.col("first"))) * 100).alias("percent"),
    )


def row_context(df: DataFrame, keys: Sequence[str], value: str, additive: Column | bool) -> DataFrame:
    """Per row: distance to the group median, at-or-below percentile, share of the total."""
    clean = _clean(df, value)
    ranks = ordered_counts(clean, keys, value)
    total = F.sum(F.col(value) * F.col("n")).cast("double").alias("total_value")
    group = quantiles_of_counts(ranks, keys, value, {"median": 0.5}, total)
    flag = additive if isinstance(additive, Column) else F.lit(additive)
    # The per-value table is the small side of the row join: one row per distinct value.
    per_value = salted_join(ranks, group, keys, value).select(
        *keys,
        value,
        (F.col(value).cast("double") - F.col("median")).alias("delta_to_median"),
        ((F.col("below") + F.col("n")) / F.col("total") * 100).alias("percentile"),
        "total_value",
    )
    share = F.col(value).cast("double") / F.col("total_value") * 100
    return (
        clean.join(per_value, [*keys, value])
        .withColumn("share_of_total", F.when(flag & (F.col("total_value") > 0), share))
        .drop("total_value")
    )


def deviation_from_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with their signed distance from the group median."""
    return row_context(df, keys, value, False).drop("percentile", "share_of_total")


def leading_row(df: DataFrame, keys: Sequence[str], value: str, label: str, ascending: bool) -> DataFrame:
    """Row at the favourable end; ties go to the first label."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    return first_per_key(_clean(df, value), keys, order, F.col(label).asc())


def insight_flags(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    order: str,
    thin: str,
    additive: bool,
    polarity: str,
    timeseries: bool,
) -> DataFrame:
    """One row per group with the readings its numbers support; groups of one row give none.

    One table of ordered counts gives the summary and the concentration, one aggregation of the
    rows gives trend and thin rows.
    """
    clean = _clean(df, value)
    x = F.col(value)
    summary = quantiles_of_counts(
        ordered_counts(clean, keys, value),
        keys,
        value,
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
        F.sum("n").alias("n"),
        F.min(x).cast("double").alias("min"),
        F.max(x).cast("double").alias("max"),
        *_top_share_sums(value, 3),
    ).where(F.col("n") >= 2)
    rows = clean.groupBy(*keys).agg(
        F.count_if(F.col(thin)).alias("thin_rows"),
        F.min_by(value, order).cast("double").alias("first"),
        F.max_by(value, order).cast("double").alias("last"),
    )
    no_number = F.lit(None).cast("double")
    span = safe_ratio(F.col("max"), F.col("min"))
    trend = safe_ratio(F.col("last") - F.col("first"), F.abs(F.col("first"))) * 100
    out = summary.join(rows, list(keys)).withColumns(
        {
            "span": F.when((F.col("min") > 0) & (span >= 1.5), span),
            "top3_share": _top_share(3) if additive else no_number,
            "trend_percent": trend if timeseries else no_number,
        }
    )
    return out.select(
        *keys,
        "n",
        "median",
        "q1",
        "q3",
        F.col("span").isNotNull().alias("has_range"),
        "span",
        F.col("top3_share").isNotNull().alias("has_concentration"),
        "top3_share",
        F.col("trend_percent").isNotNull().alias("has_trend"),
        "trend_percent",
        "thin_rows",
        (F.col("thin_rows") > 0).alias("has_thin"),
        F.lit(polarity == "neutral").alias("has_scale_caution"),
    )


def compare_measures(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Points that both measures report, with the median of each; nothing below two points."""
    points = left.select(key, F.col("value").alias("x")).join(
        right.select(key, F.col("value").alias("y")), key
    )
    medians = {}
    for column in ("x", "y"):
        ranks = ordered_counts(points, [], column)
        medians[column] = quantiles_of_counts(ranks, [], column, {"median": 0.5}).select("median")
    enough = points.agg(F.count(F.lit(1)) >= 2)
    return points.where(enough.scalar()).select(
        key,
        "x",
        "y",
        medians["x"].scalar().alias("x_median"),
        medians["y"].scalar().alias("y_median"),
    )
