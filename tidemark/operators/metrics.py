"""Metric materialisation: candidates, derived metrics, plausibility screens, percentiles, deltas.

Candidates have ``company_id, fy, sector, metric_key, value decimal(24,6), pin_id`` and
optionally ``contributing_pin_ids``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import rule_table
from tidemark.operators.ranking import attach_ranks
from tidemark.session import shared_dir, staged

FILING = ("company_id", "fy")
VALUE = "decimal(24,6)"


@dataclass(frozen=True)
class Additive:
    metric_key: str
    addends: Sequence[str]


@dataclass(frozen=True)
class Ratio:
    metric_key: str
    numerators: Sequence[str]
    denominator: str
    scale: int = 1


@dataclass(frozen=True)
class Identity:
    total: str
    parts: Sequence[str]


@dataclass(frozen=True)
class MetricRules:
    additive: Sequence[Additive] = ()
    ratios: Sequence[Ratio] = ()
    identities: Sequence[Identity] = ()
    non_negative: Sequence[str] = ()
    tolerance: str = "0.01"
    minimum_sector_size: int = 5


def build_candidates(pinned: DataFrame) -> DataFrame:
    """Every pinned numeric field is a candidate of its own."""
    return pinned.where(F.col("value").isNotNull()).select(
        *FILING, "sector", "metric_key", F.col("value").cast(VALUE).alias("value"), "pin_id"
    )


def _by_filing(candidates: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """One row per filing with a (value, pin) struct per wanted key; absent keys are null.

    Conditional aggregation: one shuffle, combined on the map side, instead of a join per key.
    """
    names = {key: f"k{i}" for i, key in enumerate(dict.fromkeys(keys))}
    item = F.struct("value", "pin_id")
    wide = (
        candidates.where(F.col("metric_key").isin(list(names)))
        .groupBy(*FILING, *extra)
        .agg(*[F.max(F.when(F.col("metric_key") == key, item)).alias(name) for key, name in names.items()])
    )
    return wide, names


def _total(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column  # null as soon as one addend is missing
    return total


def derive(candidates: DataFrame, rules: MetricRules) -> DataFrame:
    """Additive metrics (all addends present) and ratios, with the pins they were built from.

    Ratios may use additive outputs. A missing or zero denominator gives no row.
    """
    if not rules.additive and not rules.ratios:
        return candidates.withColumn("contributing_pin_ids", F.array("pin_id")).limit(0)
    inputs = [k for a in rules.additive for k in a.addends]
    inputs += [k for r in rules.ratios for k in (*r.numerators, r.denominator)]
    wide, names = _by_filing(candidates, inputs, ("sector",))
    cell: dict[str, tuple[Column, Column, Column]] = {}
    for key, name in names.items():
        c = F.col(name)
        cell[key] = (c["value"], c["pin_id"], F.array(c["pin_id"]))

    made: list[Column] = []

    def emit(key: str, value: Column, pin: Column, pins: Column) -> None:
        made.append(
            F.struct(
                F.lit(key).alias("metric_key"),
                value.cast(VALUE).alias("value"),
                pin.alias("pin_id"),
                pins.alias("contributing_pin_ids"),
            )
        )

    for rule in rules.additive:
        parts = [cell[key] for key in rule.addends]
        value = _total([part[0] for part in parts]).cast(VALUE)
        pins = F.array(*[part[1] for part in parts])
        emit(rule.metric_key, value, parts[0][1], pins)
        # Within one filing an additive result replaces a reported field of the same key.
        reported = cell.get(rule.metric_key)
        pin = parts[0][1]
        if reported:
            cell[rule.metric_key] = (
                F.coalesce(value, reported[0]),
                F.when(value.isNotNull(), pin).otherwise(reported[1]),
                pins,
            )
        else:
            cell[rule.metric_key] = (value, pin, pins)
    for rule in rules.ratios:
        tops, bottom = [cell[key] for key in rule.numerators], cell[rule.denominator]
        # Scale before dividing: the quotient then keeps six exact decimals.
        top = (_total([t[0] for t in tops]) * F.lit(Decimal(rule.scale))).cast("decimal(38,6)")
        value = F.try_divide(top, bottom[0])
        emit(rule.metric_key, value, tops[0][1], F.array(*[t[1] for t in tops], bottom[1]))
    return (
        wide.select(*FILING, "sector", F.inline(F.array(*made)))
        .where(F.col("value").isNotNull())
        .select(*FILING, "sector", "metric_key", "value", "pin_id", "contributing_pin_ids")
    )


def with_derived(candidates: DataFrame, rules: MetricRules) -> DataFrame:
    """Reported and derived candidates; a reported value has its own pin as lineage."""
    base = candidates.withColumn("contributing_pin_ids", F.array("pin_id"))
    if not rules.additive and not rules.ratios:
        return base
    return base.unionByName(derive(candidates, rules))


def identity_failures(candidates: DataFrame, rules: MetricRules) -> DataFrame:
    """Totals that differ from the sum of their parts by more than the tolerance."""
    keys = [k for i in rules.identities for k in (i.total, *i.parts)]
    wide, names = _by_filing(candidates, keys)
    checks = []
    for identity in rules.identities:
        total = F.col(names[identity.total])["value"]
        parts = _total([F.col(names[key])["value"] for key in identity.parts])
        limit = F.greatest(F.abs(total), F.lit(1).cast(VALUE)) * F.lit(Decimal(rules.tolerance))
        broken = F.abs(total - parts) > limit  # null when any is missing: not a failure
        checks.append(
            F.when(
                broken,
                F.struct(
                    F.lit("identity").alias("screen"),
                    F.lit(identity.total).alias("metric_key"),
                    total.cast(VALUE).alias("value"),
                    parts.cast(VALUE).alias("expected"),
                ),
            )
        )
    found = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return wide.select(*FILING, F.inline(found))


def negative_failures(candidates: DataFrame, rules: MetricRules) -> DataFrame:
    """Listed keys reported below zero."""
    return candidates.where(F.col("metric_key").isin(list(rules.non_negative)) & (F.col("value") < 0)).select(
        *FILING,
        F.lit("non_negative").alias("screen"),
        "metric_key",
        "value",
        F.lit(None).cast(VALUE).alias("expected"),
    )


def screen_failures(candidates: DataFrame, rules: MetricRules) -> DataFrame:
    negative = negative_failures(candidates, rules)
    return identity_failures(candidates, rules).unionByName(negative) if rules.identities else negative


def blocked_keys(rules: MetricRules) -> list[tuple[str, str]]:
    """(failing key, key to withhold) for every key reachable through the derivation rules."""
    uses: dict[str, set[str]] = {}
    for rule in rules.additive:
        for key in rule.addends:
            uses.setdefault(key, set()).add(rule.metric_key)
    for rule in rules.ratios:
        for key in (*rule.numerators, rule.denominator):
            uses.setdefault(key, set()).add(rule.metric_key)
    pairs = []
    for start in {*rules.non_negative, *(i.total for i in rules.identities)}:
        reached, frontier = {start}, {start}
        while frontier:
            frontier = set().union(*(uses.get(key, set()) for key in frontier)) - reached
            reached |= frontier
        pairs += [(start, key) for key in reached]
    return sorted(pairs)


def dependent_keys(starts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(failed, metric_key): every key that can be reached from each start, the start itself included.

    ``starts`` has the column ``failed`` and ``dependencies`` the columns ``metric_key, dependent_key``, a table of any size
    in which chains may be of any length and may close to cycles. Each round follows the dependencies of the pairs that
    the round before found and leaves out pairs known from any round, so every pair is followed once and a cycle ends by
    itself; a recursive query would follow a key once for every path that leads to it. Rounds are tables in the shared
    folder: a lost executor costs one. No round is broadcast: what goes through the driver would grow with their number. Nulls depend on nothing; repeated rows count once.
    """
    spark, path = starts.sparkSession, shared_dir(starts.sparkSession, "dependents")
    edges = staged(dependencies.select("metric_key", "dependent_key").dropna().distinct(), "dependencies")
    found = starts.select("failed").dropna().distinct().withColumn("metric_key", F.col("failed"))
    found.write.parquet(f"{path}/round=0")
    schema = found.schema
    pairs = lambda folder: spark.read.schema(schema).parquet(folder).select("failed", "metric_key")
    number, last = 0, pairs(f"{path}/round=0")
    while not last.isEmpty():
        number += 1
        following = last.join(edges.hint("merge"), "metric_key").select("failed", F.col("dependent_key").alias("metric_key")).distinct()
        following.join(pairs(path).hint("merge"), ["failed", "metric_key"], "left_anti").write.parquet(f"{path}/round={number}")
        last = pairs(f"{path}/round={number}")
    return pairs(path)


def withhold_dependents(candidates: DataFrame, failures: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Drop failing keys and all keys that depend on them, for the failing filing only.

    ``failures`` has company_id, fy and metric_key; the keys and what depends on them are data, as in
    :func:`dependent_keys`. Keys are followed once, whatever number of filings they fail in. Candidates without a
    company, year or key stay.
    """
    failed = failures.select(*FILING, F.col("metric_key").alias("failed")).dropna().distinct()
    reached = dependent_keys(failed, dependencies)
    blocked = failed.join(reached.hint("merge"), "failed").select(*FILING, "metric_key")
    return candidates.join(blocked.hint("merge"), [*FILING, "metric_key"], "left_anti")


def withhold_implausible(candidates: DataFrame, rules: MetricRules) -> DataFrame:
    """Drop failing keys and all keys derived from them, for the failing filing only."""
    pairs = blocked_keys(rules)
    if not pairs:
        return candidates
    closure = rule_table(candidates.sparkSession, ["failed", "metric_key"], pairs)
    failed = screen_failures(candidates, rules).select(*FILING, F.col("metric_key").alias("failed"))
    blocked = failed.join(F.broadcast(closure), "failed").select(*FILING, "metric_key")  # config-sized
    return candidates.join(blocked, [*FILING, "metric_key"], "left_anti")


def midrank_percentile(
    df: DataFrame, keys: Sequence[str], value: str, out: str, minimum: int = 0
) -> DataFrame:
    """Tie-aware percentile in the cohort: half the equal rows count as below; 100 for a lone row.

    ``(below + (equal - 1) / 2) / (rows - 1) * 100`` to four places, half to even; null where the
    cohort has fewer than ``minimum`` rows.
    """
    ranked = attach_ranks(df, keys, value)
    place = (F.col("below") * 2 + F.col("n") - 1) * F.lit(50.0) / (F.col("total") - 1)
    rank = F.when(F.col("total") <= 1, F.lit(100.0)).otherwise(place)
    enough = F.col("total") >= minimum
    return ranked.withColumn(out, F.when(enough, F.bround(rank, 4).cast("decimal(7,4)"))).drop(
        "n", "below", "total"
    )


def yoy_delta(df: DataFrame, out: str = "yoy_delta") -> DataFrame:
    """Difference to the value of exactly the year before; null on a gap.

    The window group is one company's years of one metric, so it stays small at any data size.
    """
    years = W.partitionBy("company_id", "metric_key").orderBy("fy").rangeBetween(-1, -1)
    return df.withColumn(out, (F.col("value") - F.max("value").over(years)).cast(VALUE))


def materialise(candidates: DataFrame, rules: MetricRules) -> DataFrame:
    """The metrics table: plausible candidates with both percentiles, yearly delta and lineage.

    Candidates feed the screens, both percentiles and the result, so they are written once before
    and once after the screens instead of being worked out for every use.
    """
    rows = staged(with_derived(candidates, rules), "candidates")
    if blocked_keys(rules):
        rows = staged(withhold_implausible(rows, rules), "plausible")
    rows = midrank_percentile(rows, ["fy", "metric_key"], "value", "percentile_all")
    rows = midrank_percentile(
        rows, ["fy", "metric_key", "sector"], "value", "percentile_sector", rules.minimum_sector_size
    )
    return yoy_delta(rows)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Deterministic rebuild: only the partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def rules_from_dict(document: dict[str, Any]) -> MetricRules:
    """Rules from a parsed configuration document."""
    screens = document.get("plausibility_screens") or {}
    return MetricRules(
        additive=[Additive(r["metric_key"], r["addends"]) for r in document.get("additive_metrics", [])],
        ratios=[
            Ratio(r["metric_key"], r.get("numerators") or [r["numerator"]], r["denominator"], r["denominator_scale"])
            for r in document.get("derived_metrics", [])
        ],
        identities=[Identity(r["total"], r["parts"]) for r in screens.get("identities", [])],
        non_negative=screens.get("non_negative", []),
        tolerance=str(screens.get("tolerance", "0.01")),
        minimum_sector_size=int(document.get("minimum_sector_size", 5)),
    )
