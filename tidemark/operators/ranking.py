"""Order statistics that never put a whole group into one task.

``Window.partitionBy(group).orderBy(value)`` and ``percentile`` both hold a full group in one
task, which fails when one cohort has a third of all rows. Here equal values are collapsed first
(with map-side combine), the remaining distinct values are cut into blocks, and these into fine
blocks, by a fixed monotone function of the value. Each fine block is ranked on its own; totals of
the fine blocks of a block, and of the few blocks of a group, give the offsets. The result is exact.
Values as close as one millionth of a percent still fall into different fine blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Blocks per factor e of magnitude (neighbours differ by about 0.1 %), and fine blocks in a block.
BLOCKS_PER_E = 1024
FINE = 65_536


def value_block(value: Column) -> Column:
    """Monotone number of the fine block; depends on the value alone, so retried tasks agree on it."""
    x = value.cast("double")
    return (F.signum(x) * F.floor(F.log1p(F.abs(x)) * (BLOCKS_PER_E * FINE))).cast("long")


def _with_offsets(parts: DataFrame, within: Sequence[str], order: str, size: str, before: str, total: str) -> DataFrame:
    """Sum of ``size`` over the parts before each one, and over all parts, inside ``within``."""
    whole = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    so_far = F.sum(size).over(whole.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return parts.withColumns({before: so_far - F.col(size), total: F.sum(size).over(whole)})


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, distinct value): ``n`` equal rows, ``below`` smaller ones, ``total``."""
    keys = list(keys)
    distinct = (
        df.where(F.col(value).isNotNull())
        .withColumn("fine", value_block(F.col(value)))
        .groupBy(*keys, "fine", value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    local = _with_offsets(distinct, [*keys, "fine"], value, "n", "below_in_fine", "fine_n")
    fines = local.groupBy(*keys, "fine").agg(F.max("fine_n").alias("fine_n"))
    fines = fines.withColumn("block", F.floor(F.col("fine") / FINE))
    # At most FINE rows per block here, and about 84,000 blocks per group for values up to 1e18, whatever the data.
    fines = _with_offsets(fines, [*keys, "block"], "fine", "fine_n", "before_in_block", "block_n")
    blocks = fines.groupBy(*keys, "block").agg(F.max("block_n").alias("block_n"))
    blocks = _with_offsets(blocks, keys, "block", "block_n", "before", "total").drop("block_n")
    offsets = fines.join(blocks, [*keys, "block"]).select(*keys, "fine", (F.col("before") + F.col("before_in_block")).alias("before"), "total")
    return local.join(offsets, [*keys, "fine"]).select(
        *keys, value, "n", (F.col("before") + F.col("below_in_fine")).alias("below"), "total"
    )


def attach_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``n``, ``below`` and ``total`` of the row's value within its group.

    The join key includes the value, so only one repeated value can make it hot; the other side
    has one row per key, which is the shape AQE splits.
    """
    ranks = ordered_counts(df, keys, value)
    return df.join(ranks, [*keys, value], "left")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles (R-7) per group, as doubles, from the ordered counts."""
    ranks = ordered_counts(df, keys, value)
    return quantiles_of_counts(ranks, keys, value, fractions)


def quantiles_of_counts(
    ranks: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], *extra: Column
) -> DataFrame:
    """The same from an :func:`ordered_counts` table; ``extra`` aggregates share its one shuffle."""
    number = F.col(value).cast("double")
    aggregates: list[Column] = []
    for name, fraction in fractions.items():
        position = (F.col("total") - 1) * F.lit(float(fraction))
        ends = {"low": F.floor(position), "high": F.ceil(position)}
        for end, at in ends.items():
            covers = (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
            aggregates.append(F.max(F.when(covers, number)).alias(f"{name}__{end}"))
        aggregates.append(F.max(position - ends["low"]).alias(f"{name}__part"))
    wide = ranks.groupBy(*keys).agg(*aggregates, *extra)
    helper = {column for column in wide.columns if column.endswith(("__low", "__high", "__part"))}
    kept = [column for column in wide.columns if column not in helper]
    between = lambda name: F.col(f"{name}__low") + (
        F.col(f"{name}__high") - F.col(f"{name}__low")
    ) * F.col(f"{name}__part")
    return wide.select(*kept, *[between(name).alias(name) for name in fractions])


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1) -> DataFrame:
    """First ``n`` rows per key in a total order.

    Written as ``row_number() <= n`` so that Spark keeps only ``n`` rows per key and map task
    before the shuffle (WindowGroupLimit); a hot key does not travel whole.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") <= n).drop("__rn")
