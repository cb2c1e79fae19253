"""Product-event jobs: intake, identity, funnels, lead scores, quotas, retention.

Events have ``event_id, ts, name, user_id, anon_id, props`` (``props`` is JSON text). All "now"
values are parameters. Time ties are broken by ``event_id``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config
from tidemark.functions.exprs import rule_table, stable_key
from tidemark.operators.limits import anchored_window, rate_limit  # noqa: F401  (part of this module's interface)
from tidemark.operators.ranking import first_per_key
from tidemark.operators.relational import upsert
from tidemark.operators.skew import salted_join
from tidemark.operators.text import themes


def order_key() -> Column:
    return F.struct("ts", "event_id")


# ---- intake and identity -------------------------------------------------------------------


def split_registered(
    events: DataFrame, registered: Sequence[str], strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) events by whether their name is registered.

    ``strict`` raises on the first unknown name instead of setting its rows aside.
    """
    known = F.coalesce(F.col("name").isin(list(registered)), F.lit(False))
    accepted, quarantined = events.where(known), events.where(~known)
    if strict:
        first = quarantined.agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).first()
        if first["n"]:
            raise ValueError(f"unregistered event: {first['name']}")
    return accepted, quarantined


def without_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events without those of the listed users; rows without a user stay.

    Those rows take no part in the join: as null keys they would all meet in one task.
    """
    gone = users.select("user_id").distinct()
    if events.isStreaming:  # a stream is read once
        return events.join(gone, "user_id", "left_anti")
    named = events.where(F.col("user_id").isNotNull()).join(gone, "user_id", "left_anti")
    return named.select(*events.columns).unionByName(events.where(F.col("user_id").isNull()))


def drop_opted_out(events: DataFrame, opted_out: DataFrame) -> DataFrame:
    """Events without those of users who opted out; anonymous events stay."""
    return without_users(events, opted_out)


def merge_identity(events: DataFrame, links: DataFrame) -> DataFrame:
    """Anonymous history gets the user it was linked to; rows with a user keep it.

    ``links`` has one row per ``anon_id``. Only rows without a user take part in the join.
    """
    mapped = links.select("anon_id", F.col("user_id").alias("linked_user"))
    known = events.where(F.col("user_id").isNotNull() | F.col("anon_id").isNull())
    anonymous = events.where(F.col("user_id").isNull() & F.col("anon_id").isNotNull())
    merged = salted_join(anonymous, mapped, ["anon_id"], "event_id", "left")
    merged = merged.withColumn("user_id", F.col("linked_user")).drop("linked_user")
    return known.unionByName(merged.select(*events.columns))


def identity() -> Column:
    """User, else anonymous id, else 'unknown'."""
    return F.coalesce(F.col("user_id").cast("string"), F.col("anon_id").cast("string"), F.lit("unknown"))


def moment(events: DataFrame, value: str) -> Column:
    """A time literal of the column's own type, so that comparisons reach the scan as filters."""
    return F.lit(value).cast(events.schema["ts"].dataType)


def look_back(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Events of the last days before ``as_of``; the range reaches the scan as a pushed filter."""
    start = moment(events, as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return events.where(F.col("ts") >= start)


# ---- funnels -------------------------------------------------------------------------------


def funnel_reached(events: DataFrame, steps: Sequence[tuple[str, Sequence[str]]]) -> list[DataFrame]:
    """Per stage, the identities that reached it and when.

    A stage counts only after the stage before it, and one event advances one stage. Each stage is
    a minimum with map-side combine; the lookup of the earlier moment is salted, since anonymous
    traffic ends up under the single identity 'unknown'.
    """
    named = events.withColumn("identity", identity()).select("identity", "name", "event_id", order_key().alias("at"))
    stages: list[DataFrame] = []
    for _, names in steps:
        rows = named.where(F.col("name").isin(list(names)))
        if stages:
            earlier = stages[-1].withColumnRenamed("at", "earlier")
            rows = salted_join(rows, earlier, ["identity"], "event_id").where(F.col("at") > F.col("earlier"))
        stages.append(rows.groupBy("identity").agg(F.min("at").alias("at")))
    return stages


def funnel(events: DataFrame, steps: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Distinct identities per stage and the conversion from the stage before (four places).

    The first stage has no conversion; after an empty stage it is 0.
    """
    counts = None
    for number, ((label, _), stage) in enumerate(zip(steps, funnel_reached(events, steps), strict=True)):
        row = stage.agg(F.count(F.lit(1)).alias("users")).select(
            F.lit(number).alias("stage"), F.lit(label).alias("name"), "users"
        )
        counts = row if counts is None else counts.unionByName(row)
    assert counts is not None
    previous = F.lag("users").over(W.partitionBy(F.lit(0)).orderBy("stage"))  # one row per stage
    rate = F.when(previous > 0, F.round(F.col("users") / previous, 4)).when(previous == 0, F.lit(0.0))
    return counts.withColumn("conversion_from_previous", rate)


# ---- usage counts --------------------------------------------------------------------------


def feature_usage(events: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Counts per feature label; events without a label do not count."""
    table = rule_table(events.sparkSession, ["name", "label"], labels.items())
    return (
        events.join(F.broadcast(table), "name")  # configuration
        .groupBy(F.col("label").alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def property_counts(events: DataFrame, prop: str) -> DataFrame:
    """Counts per value of one property; missing and empty values do not count."""
    value = F.get_json_object("props", f"$.{prop}")
    return (
        events.select(value.alias("name"))
        .where(F.col("name") != "")
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def question_themes(events: DataFrame, prop: str = "question", name: str | None = None) -> DataFrame:
    """Counts per theme of the questions that events carry in a property; empty ones do not count."""
    asked = events if name is None else events.where(F.col("name") == name)
    texts = asked.select("event_id", F.get_json_object("props", f"$.{prop}").alias("text")).where(F.col("text") != "")
    return themes(texts, "event_id", "text").groupBy(F.col("theme").alias("name")).agg(F.count(F.lit(1)).alias("count"))


def digest_top(counts: DataFrame, n: int = 5) -> DataFrame:
    """The report's first rows: most common first, then by name."""
    return counts.orderBy(F.desc("count"), "name").limit(n)


# ---- lead scores ---------------------------------------------------------------------------


@dataclass(frozen=True)
class SignalRule:
    key: str
    weight: int
    label: str
    event: str | None = None  # defaults to the key
    max_occurrences: int = 1
    instant: bool = False
    contains: dict[str, Sequence[str]] = field(default_factory=dict)  # property -> terms


def match_signals(events: DataFrame, rules: Sequence[SignalRule]) -> DataFrame:
    """Events joined with every rule they match: name equal, each listed property has a term."""
    spark = events.sparkSession
    rows = [(r.key, r.event or r.key, r.weight, r.label, r.max_occurrences, r.instant) for r in rules]
    columns = ["signal", "name", "points", "label", "cap", "instant"]
    joined = events.join(F.broadcast(rule_table(spark, columns, rows)), "name")  # configuration
    condition = F.lit(True)
    for rule in rules:
        terms_ok = F.lit(True)
        for prop, terms in rule.contains.items():
            text = F.lower(F.coalesce(F.get_json_object("props", f"$.{prop}"), F.lit("")))
            one = F.lit(False)
            for term in terms:
                one = one | text.contains(str(term).lower())
            terms_ok = terms_ok & one
        if rule.contains:
            condition = condition & ((F.col("signal") != rule.key) | terms_ok)
    return joined.where(condition)


def scored_signals(events: DataFrame, rules: Sequence[SignalRule], as_of: str, days: int) -> DataFrame:
    """Per user and rule the newest matching events up to the rule's cap."""
    recent = look_back(events.where(F.col("user_id").isNotNull()), as_of, days)
    matched = match_signals(recent, rules)
    newest = W.partitionBy("user_id", "signal").orderBy(F.desc("ts"), F.desc("event_id"))
    highest = max(rule.max_occurrences for rule in rules)
    ranked = matched.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= highest)
    return ranked.where(F.col("place") <= F.col("cap"))


def lead_scores(events: DataFrame, rules: Sequence[SignalRule], as_of: str, days: int) -> DataFrame:
    """Score, instant flag and timeline per user with at least one signal.

    The timeline holds at most the sum of the caps, so collecting it is bounded by the rules.
    """
    step = F.struct("ts", "event_id", F.col("signal").alias("key"), "label", "points", "props")
    return (
        scored_signals(events, rules, as_of, days)
        .groupBy("user_id")
        .agg(
            F.sum("points").alias("score"),
            F.bool_or("instant").alias("instant"),
            F.sort_array(F.collect_list(step)).alias("timeline"),
        )
    )


def upsert_leads(leads: DataFrame, scored: DataFrame, memberships: DataFrame) -> DataFrame:
    """Leads after a scoring run: a user's open lead is rescored, others get a new one.

    A new lead belongs to the organisation the user joined first.
    """
    first_org = memberships.groupBy("user_id").agg(F.min_by("org_id", F.struct("created_at", "org_id")).alias("org_id"))
    open_leads = first_per_key(leads.where(F.col("status").isin("new", "routed")), ["user_id"], F.asc("lead_id"))
    kept = open_leads.select("user_id", "lead_id", F.col("org_id").alias("lead_org"), "status")
    changed = (
        scored.select("user_id", "score")
        .join(kept, "user_id", "left")
        .join(first_org, "user_id", "left")
        .select(
            F.coalesce("lead_id", stable_key("lead", "user_id")).alias("lead_id"),
            "user_id",
            F.when(F.col("lead_id").isNull(), F.col("org_id")).otherwise(F.col("lead_org")).alias("org_id"),
            F.coalesce("status", F.lit("new")).alias("status"),
            F.col("score").cast("long").alias("score"),
        )
    )
    return upsert(leads.select(*changed.columns), changed, ["lead_id"])


def routable_leads(leads: DataFrame, recently_routed_orgs: DataFrame, threshold: int = 50) -> DataFrame:
    """Leads to hand over now, one per organisation: highest score, then lowest user id.

    ``leads``: user_id, org_id, score, instant, opted_out, routed. Out: opted out, already routed,
    or of an organisation that was routed lately. Users without an organisation stand alone.
    """
    free = ~F.col("opted_out") & ~F.col("routed") & (F.col("instant") | (F.col("score") >= threshold))
    open_leads = leads.where(free).join(recently_routed_orgs.select("org_id").distinct(), "org_id", "left_anti")
    grouped = first_per_key(
        open_leads.where(F.col("org_id").isNotNull()), ["org_id"], F.desc("score"), F.asc("user_id")
    )
    return grouped.unionByName(open_leads.where(F.col("org_id").isNull()).select(*grouped.columns))


def opening_context(scored: DataFrame, company_prop: str) -> DataFrame:
    """Per user the label of the newest signal and the newest company property among signals."""
    company = F.nullif(F.get_json_object("props", f"$.{company_prop}"), F.lit(""))
    rows = scored.select("user_id", "label", company.alias("company"), order_key().alias("at"))
    return rows.groupBy("user_id").agg(
        F.max_by("label", "at").alias("focus"),
        F.max_by("company", F.when(F.col("company").isNotNull(), F.col("at"))).alias("company"),
    )


def signal_quality(leads: DataFrame, positive: Sequence[str] = config.POSITIVE_OUTCOMES) -> DataFrame:
    """Per distinct signal of leads with an outcome: leads, positive ones and their rate."""
    keys = F.array_distinct(F.transform("timeline", lambda step: step["key"]))
    hit = F.col("outcome").isin(list(positive))
    return (
        leads.where(F.col("outcome").isNotNull())
        .select(F.explode(keys).alias("signal"), hit.alias("hit"))
        .groupBy("signal")
        .agg(F.count(F.lit(1)).alias("leads"), F.count_if("hit").alias("positive_outcomes"))
        .withColumn("conversion_rate", F.bround(F.col("positive_outcomes") / F.col("leads"), 4))
    )


# ---- retention and subject requests --------------------------------------------------------


def retention_cutoff(events: DataFrame, as_of: str, months: int) -> Column:
    """Start of the day ``months`` times 31 days before ``as_of``."""
    day = F.date_sub(moment(events, as_of).cast("date"), months * 31)
    return day.cast(events.schema["ts"].dataType)


def retention_rollup(events: DataFrame, daily: DataFrame, as_of: str, months: int) -> DataFrame:
    """Daily counts per name after folding in the events that fall out of retention.

    Counts are added to existing ones: their raw rows may be gone, so replacing would lose them.
    """
    old = (
        events.where(F.col("ts") < retention_cutoff(events, as_of, months))
        .groupBy(F.col("ts").cast("date").alias("day"), "name")
        .agg(F.count(F.lit(1)).alias("event_count"))
    )
    both = daily.select("day", "name", "event_count").unionByName(old)
    return both.groupBy("day", "name").agg(F.sum("event_count").alias("event_count"))


def retained(events: DataFrame, as_of: str, months: int) -> DataFrame:
    return events.where(F.col("ts") >= retention_cutoff(events, as_of, months))


def export_subjects(events: DataFrame, requests: DataFrame) -> DataFrame:
    """All events of the requesting users; sort within users when writing."""
    return events.join(requests.select("user_id").distinct(), "user_id", "left_semi")


def erase_subjects(events: DataFrame, requests: DataFrame) -> DataFrame:
    """The events table after erasing the requesting users."""
    return without_users(events, requests)


# ---- quotas and limits ---------------------------------------------------------------------


def quota_limits(spark, quotas: dict[str, dict[str, int]] | None = None) -> DataFrame:  # noqa: ANN001
    """(tier, quota, limit) rows; a quota that a tier lacks counts as 0 after the left join."""
    table = quotas or config.QUOTAS
    rows = [(tier, name, int(limit)) for tier, limits in table.items() for name, limit in limits.items()]
    return rule_table(spark, ["tier", "quota", "limit"], rows)


def quota_period() -> Column:
    """Minute, day or month label, by the quota's name."""
    return (
        F.when(F.col("quota").endswith("per_minute"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
        .when(F.col("quota").endswith("per_day"), F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "yyyy-MM"))
    )


USAGE = ("quota", "tier", "identity", "period")


def quota_usage(uses: DataFrame, limits: DataFrame) -> DataFrame:
    """Used amount per (quota, tier, identity, period) with limit, remaining, warning, exceeded."""
    used = uses.withColumn("period", quota_period()).groupBy(*USAGE).agg(F.sum("amount").alias("used"))
    limit = F.coalesce("limit", F.lit(0))
    return used.join(F.broadcast(limits), ["tier", "quota"], "left").select(  # configuration
        *USAGE,
        "used",
        limit.alias("limit"),
        F.greatest(F.lit(0), limit - F.col("used")).alias("remaining"),
        ((limit > 0) & (F.col("used") / limit >= 0.8)).alias("warning"),
        ((limit <= 0) | (F.col("used") > limit)).alias("exceeded"),
    )


def quota_decisions(uses: DataFrame, limits: DataFrame) -> DataFrame:
    """Every use with the amount used up to it in its period and whether it is rejected.

    Running totals go in two levels, minutes within a period and uses within a minute: a month of
    one busy identity is at most 44,640 minute rows, and its uses are spread by minute.
    """
    rows = uses.withColumn("period", quota_period()).withColumn("minute", F.date_trunc("minute", "ts"))
    minutes = rows.groupBy(*USAGE, "minute").agg(F.sum("amount").alias("in_minute"))
    earlier = W.partitionBy(*USAGE).orderBy("minute").rowsBetween(W.unboundedPreceding, -1)
    minutes = minutes.select(*USAGE, "minute", F.coalesce(F.sum("in_minute").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy(*USAGE, "minute").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    running = rows.withColumn("so_far", F.sum("amount").over(inside)).join(minutes, [*USAGE, "minute"])
    limit = F.coalesce("limit", F.lit(0))
    used = F.col("before") + F.col("so_far")
    return running.join(F.broadcast(limits), ["tier", "quota"], "left").select(  # configuration
        *uses.columns, "period", used.alias("used"), ((limit <= 0) | (used > limit)).alias("rejected")
    )


def licence_state(expires: Column, grace: Column, as_of: str) -> Column:
    """active, grace or read_only at a moment."""
    now = F.lit(as_of).cast("timestamp")
    return (
        F.when(expires.isNull() | (now <= expires), "active").when(now <= grace, "grace").otherwise("read_only")
    )
