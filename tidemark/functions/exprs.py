"""Small column expressions: literals tables, keys, rounding, safe arithmetic."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rule_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence[Any]]) -> DataFrame:
    """A literal table for driver-side rules; its size is that of the configuration."""
    structs = [
        F.struct(*[F.lit(value).alias(name) for name, value in zip(columns, row, strict=True)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def stable_key(kind: str, *parts: Column | str) -> Column:
    """Same key on every rebuild: hash of kind and parts."""
    columns = [F.col(part) if isinstance(part, str) else part for part in parts]
    return F.sha2(F.concat_ws("/", F.lit(kind), *[c.cast("string") for c in columns]), 256)


def money(column: Column | str) -> Column:
    """Exact two-decimal amount, so that sums do not depend on the order of rows."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, or null when the reference is zero, null or not finite."""
    result = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.when(is_finite(result), result)


def is_finite(column: Column) -> Column:
    value = column.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether the lower-cased text contains any of the terms."""
    lowered = F.lower(text)
    hit = F.lit(False)
    for term in terms:
        hit = hit | lowered.contains(term.lower())
    return F.coalesce(hit, F.lit(False))
