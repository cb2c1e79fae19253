"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread: Column | str,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` with a table that has one row per key, spreading each key over ``salts`` tasks.

    AQE splits hot join partitions on its own, but not where the next operator groups by the same
    key (the split would break its partitioning), so those joins use this one. ``spread`` is any
    column that differs between rows of one key.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError("rows must be the preserved side")
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    copies = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", salt).join(copies, [*keys, "__salt"], how).drop("__salt")

