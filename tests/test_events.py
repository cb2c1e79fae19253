import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import events as e

EV = "event_id int, ts timestamp, name string, user_id string, anon_id string, props string"
NOW = datetime(2024, 6, 30)
RULES = [
    e.SignalRule("viewed_gap_panel", 10, "Reviewed a gap", max_occurrences=3),
    e.SignalRule("intent", 15, "Asked", event="nlq_asked", max_occurrences=2, contains={"question": ["assurance", "deadline"]}),
    e.SignalRule("pricing_viewed", 10, "Pricing"),
    e.SignalRule("deepdive_requested", 50, "Deep-dive", instant=True),
]


def events(frame, rows):
    return frame([(i, NOW - timedelta(days=days), name, user, anon, props) for i, (days, name, user, anon, props) in enumerate(rows)], EV)


def test_lead_scores_are_capped_and_windowed(frame):
    rows = [(n, "viewed_gap_panel", "u", None, "{}") for n in range(1, 6)]
    rows += [(2, "nlq_asked", "u", None, '{"question": "When is the ASSURANCE deadline?", "company": "Acme"}'), (3, "nlq_asked", "u", None, '{"question": "water"}')]
    rows += [(1, "pricing_viewed", "u", None, "{}"), (5, "deepdive_requested", "v", None, "{}"), (31, "deepdive_requested", "w", None, "{}"), (1, "pricing_viewed", None, "x", "{}")]
    df = events(frame, rows)
    out = {r.user_id: r for r in e.lead_scores(df, RULES, "2024-06-30", 30).collect()}
    assert {k: (r.score, r.instant) for k, r in out.items()} == {"u": (55, False), "v": (50, True)}
    assert sum(s.points for s in out["u"].timeline) == 55
    assert [s.ts for s in out["u"].timeline] == sorted(s.ts for s in out["u"].timeline)
    context = {r.user_id: (r.focus, r.company) for r in e.opening_context(e.scored_signals(df, RULES, "2024-06-30", 30), "company").collect()}
    assert context["u"][1] == "Acme" and context["v"] == ("Deep-dive", None)


def test_routing_truth_table(frame):
    rows = [(1, 1, 50, False, False, False), (2, 2, 49, False, False, False), (3, 3, 0, True, False, False), (4, 4, 90, True, True, False), (5, 5, 90, True, False, True), (6, 6, 90, True, False, False)]
    rows += [(7, 1, 80, False, False, False), (8, None, 60, False, False, False), (9, None, 60, False, False, False)]
    leads = frame(rows, "user_id int, org_id int, score int, instant boolean, opted_out boolean, routed boolean")
    out = e.routable_leads(leads, frame([(6,)], "org_id int"))
    assert sorted(r.user_id for r in out.collect()) == [3, 7, 8, 9]


STEPS = [("Visit", ["page"]), ("Signup", ["signup", "join"]), ("Pro", ["pro"])]


def test_funnel_needs_the_stage_before(frame):
    rows = [(9, "page", None, "a", "{}"), (8, "join", None, "a", "{}"), (7, "pro", None, "a", "{}"), (6, "signup", "b", None, "{}"), (5, "pro", "b", None, "{}"), (4, "page", "c", None, "{}")]
    out = e.funnel(events(frame, rows[:5]), STEPS).orderBy("stage").collect()
    assert [(r.users, r.conversion_from_previous) for r in out] == [(1, None), (1, 1.0), (1, 1.0)]
    empty = e.funnel(events(frame, rows[3:5]), STEPS).orderBy("stage").collect()
    assert [(r.users, r.conversion_from_previous) for r in empty] == [(0, None), (0, 0.0), (0, 0.0)]


def test_funnel_matches_replay_with_a_hot_identity(frame):
    rng = random.Random(5)
    rows = [(rng.random() * 20, rng.choice(["page", "signup", "join", "pro", "x"]), rng.choice([None, None, "u1", "u2", "u3"]), None, "{}") for _ in range(200)]
    stage, reached = {}, [set(), set(), set()]
    df = events(frame, rows)
    for r in sorted(df.collect(), key=lambda r: (r.ts, r.event_id)):
        who = r.user_id or r.anon_id or "unknown"
        at = stage.get(who, 0)
        if at < 3 and r.name in STEPS[at][1]:
            reached[at].add(who)
            stage[who] = at + 1
    assert [r.users for r in e.funnel(df, STEPS).orderBy("stage").collect()] == [len(s) for s in reached]


def test_identity_merge_and_opt_out(frame):
    df = events(frame, [(1, "a", None, "x", "{}"), (1, "a", "u", "x", "{}"), (1, "a", None, "y", "{}"), (1, "a", None, None, "{}")])
    merged = e.merge_identity(df, frame([("x", "v")], "anon_id string, user_id string"))
    assert {r.event_id: r.user_id for r in merged.collect()} == {0: "v", 1: "u", 2: None, 3: None}
    assert [r.event_id for r in e.drop_opted_out(df, frame([("u",)], "user_id string")).orderBy("event_id").collect()] == [0, 2, 3]


def test_unregistered_events_are_set_aside(frame):
    df = events(frame, [(1, "known", "u", None, "{}"), (1, "odd", "u", None, "{}")])
    accepted, quarantined = e.split_registered(df, ["known"])
    assert ([r.name for r in accepted.collect()], [r.name for r in quarantined.collect()]) == (["known"], ["odd"])
    with pytest.raises(ValueError, match="odd"):
        e.split_registered(df, ["known"], strict=True)


def test_retention_adds_to_existing_counts(frame):
    df = events(frame, [(100, "a", "u", None, "{}"), (100, "a", "u", None, "{}"), (1, "a", "u", None, "{}")])
    first = e.retention_rollup(df, frame([], "day date, name string, event_count long"), "2024-06-30", 1)
    second = e.retention_rollup(df, first, "2024-06-30", 1).collect()
    assert [(r.name, r.event_count) for r in second] == [("a", 4)]
    assert e.retained(df, "2024-06-30", 1).count() == 1


def test_quota_warns_and_rejects(frame):
    uses = frame([(i, datetime(2024, 1, 1, 0, i), "nlq_per_day", "explore", "u", 1) for i in range(12)] + [(99, datetime(2024, 1, 1), "exports_per_month", "explore", "u", 1)], "event_id int, ts timestamp, quota string, tier string, identity string, amount int")
    limits = e.quota_limits(uses.sparkSession, config.QUOTAS)
    out = {r.quota: r for r in e.quota_usage(uses, limits).collect()}
    assert (out["nlq_per_day"].used, out["nlq_per_day"].limit, out["nlq_per_day"].warning, out["nlq_per_day"].exceeded) == (12, 10, True, True)
    assert out["exports_per_month"].exceeded and not out["exports_per_month"].warning
    rejected = sorted(r.event_id for r in e.quota_decisions(uses, limits).where("rejected").collect())
    assert rejected == [10, 11, 99]


def replay(hits, limit, width):
    state, out = {}, {}
    for at, key, who in sorted(hits):
        start, count = state.get(who, (None, 0))
        if start is None or at >= start + width:
            start, count = at, 0
        state[who] = (start, count + 1)
        out[key] = (count + 1, count + 1 > limit)
    return out


def test_rate_limit_matches_replay(frame):
    rng = random.Random(3)
    hits = [(rng.randrange(0, 4000) * 250_000, i, rng.choice("aaab")) for i in range(600)]
    base = datetime(2024, 1, 1)
    epoch = int((base - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    df = frame([(who, i, base + timedelta(microseconds=at)) for at, i, who in hits], "identity string, event_id int, ts timestamp")
    got = {r.event_id: (r.place, r.rejected) for r in e.rate_limit(df, 20, 60).collect()}
    assert got == replay([(at + epoch, i, who) for at, i, who in hits], 20, 60_000_000)


@pytest.mark.parametrize("block", [1, 2, 64])
@pytest.mark.parametrize("step", [40_000, 900_000, 7_000_000, 45_000_000])
def test_rate_limit_over_blocks(frame, block, step):
    """Dense and sparse hits, hits of one moment, quiet spells inside and at the edges of blocks."""
    rng = random.Random(step + block)
    hits = []
    for who in "abc":
        at = rng.randrange(100_000_000)
        for _ in range(300):
            at += rng.choice([0, 1, step, rng.randrange(1, 2 * step), 59_999_999 if rng.random() < 0.05 else 1, 60_000_000 if rng.random() < 0.05 else 2])
            hits.append((at, len(hits), who))
    base = datetime(2024, 1, 1)
    epoch = int((base - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    df = frame([(who, i, base + timedelta(microseconds=at)) for at, i, who in hits] + [(None, -1, base)], "identity string, event_id int, ts timestamp")
    got = {r.event_id: (r.place, r.rejected) for r in e.rate_limit(df.repartition(3), 5, 60, block_windows=block).collect()}
    assert got == replay([(at + epoch, i, who) for at, i, who in hits], 5, 60_000_000)


def test_a_busy_identity_is_spread(spark):
    """A million hits of one identity without a quiet spell: many tasks, and the places of a replay."""
    import numpy as np

    n, gap = 1_000_000, 7_300_000
    df = spark.range(n).select(F.lit("bot").alias("identity"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * gap + F.pmod(F.xxhash64("id"), F.lit(900_000))).alias("ts"))
    out = e.rate_limit(df, 3, 60)
    shares = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) >= 4 and max(r["count"] for r in shares) < 0.5 * n
    times = df.select("event_id", F.unix_micros("ts").alias("at")).toPandas().sort_values(["at", "event_id"])
    ranks, *_ = e.anchored_window(60_000_000)(times["at"].to_numpy(), None, 0)
    got = out.toPandas().sort_values("event_id")
    want = np.empty(n, np.int64)
    want[times["event_id"].to_numpy()] = ranks
    assert (got["place"].to_numpy() == want).all() and (got["rejected"].to_numpy() == (want > 3)).all()


def test_licence_states(frame):
    df = frame([(None, None), (datetime(2024, 1, 5), None), (datetime(2024, 1, 1), datetime(2024, 1, 3)), (datetime(2024, 1, 1), None)], "x timestamp, g timestamp")
    from pyspark.sql import functions as F

    out = [r[0] for r in df.select(e.licence_state(F.col("x"), F.col("g"), "2024-01-03")).collect()]
    assert out == ["active", "active", "grace", "read_only"]
