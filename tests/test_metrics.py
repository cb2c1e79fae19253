from decimal import Decimal as D
from random import Random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import metrics as m
from tidemark.operators.ranking import ordered_counts, quantiles

CAND = "company_id string, fy int, sector string, metric_key string, value decimal(24,6), pin_id string"


def cands(frame, rows):
    return frame([(c, fy, s, k, D(str(v)), f"{c}-{fy}-{k}") for c, fy, s, k, v in rows], CAND)


def test_percentiles_and_yearly_delta(frame):
    df = cands(frame, [("a", 2025, "s", "k", 10), ("b", 2025, "s", "k", 20), ("c", 2025, "s", "k", 30), ("a", 2024, "s", "k", 15)])
    out = {(r.company_id, r.fy): r for r in m.materialise(df, m.MetricRules(minimum_sector_size=8)).collect()}
    assert [float(out[c, 2025].percentile_all) for c in "abc"] == [0, 50, 100]
    assert float(out["a", 2024].percentile_all) == 100
    assert out["a", 2025].yoy_delta == D("-5")
    assert out["b", 2025].yoy_delta is None
    assert all(r.percentile_sector is None for r in out.values())


def test_gap_year_gives_no_delta(frame):
    df = cands(frame, [("a", 2023, "s", "k", 1), ("a", 2025, "s", "k", 3)])
    assert [r.yoy_delta for r in m.yoy_delta(df).collect()] == [None, None]


RULES = m.MetricRules(
    additive=[m.Additive("ab", ["a", "b"])],
    ratios=[m.Ratio("ratio", ["total"], "turnover", 10), m.Ratio("abr", ["ab"], "turnover")],
    identities=[m.Identity("total", ["a", "b"])],
    non_negative=["turnover"],
)


def test_additive_needs_all_addends_and_ratio_a_denominator(frame):
    df = cands(frame, [("x", 1, "s", "a", 1), ("x", 1, "s", "turnover", 0), ("y", 1, "s", "a", 1), ("y", 1, "s", "b", 2), ("y", 1, "s", "turnover", 4)])
    out = {(r.company_id, r.metric_key): r for r in m.derive(df, RULES).collect()}
    assert set(out) == {("y", "ab"), ("y", "abr")}
    assert out["y", "ab"].value == 3 and out["y", "ab"].contributing_pin_ids == ["y-1-a", "y-1-b"]
    assert out["y", "abr"].value == D("0.75") and out["y", "abr"].contributing_pin_ids == ["y-1-a", "y-1-turnover"]


def test_screens_withhold_the_failing_company_only(frame):
    rows = [("bad", 1, "s", "total", 100), ("bad", 1, "s", "a", 40000), ("bad", 1, "s", "b", 60), ("bad", 1, "s", "turnover", 5)]
    rows += [("ok", 1, "s", "total", 100), ("ok", 1, "s", "a", 40), ("ok", 1, "s", "b", 60), ("ok", 1, "s", "turnover", 5)]
    rows += [("neg", 1, "s", "total", 100), ("neg", 1, "s", "turnover", -5)]
    kept = m.withhold_implausible(m.with_derived(cands(frame, rows), RULES), RULES)
    keys = {}
    for r in kept.collect():
        keys.setdefault(r.company_id, set()).add(r.metric_key)
    assert keys["ok"] == {"total", "a", "b", "turnover", "ab", "ratio", "abr"}
    assert keys["bad"] == {"a", "b", "turnover", "ab", "abr"}
    assert keys["neg"] == {"total"}


def test_closure_follows_chains():
    rules = m.MetricRules(additive=[m.Additive("b", ["a"])], ratios=[m.Ratio("c", ["b"], "z")], non_negative=["a"])
    assert m.blocked_keys(rules) == [("a", "a"), ("a", "b"), ("a", "c")]


def reachable(starts, edges):
    out = set()
    for start in starts:
        seen, todo = {start}, [start]
        while todo:
            key = todo.pop()
            new = {b for a, b in edges if a == key and None not in (a, b)} - seen
            seen |= new
            todo += new
        out |= {(start, key) for key in seen}
    return out


def test_dependent_keys_match_brute_force(frame):
    """Forty small random graphs side by side: cycles, loops, repeated edges, nulls, keys that nothing leads to."""
    draw = Random(7)
    starts, edges = [None, "nowhere"], [(None, "0a"), ("0a", None)]
    for g in range(40):
        keys = [f"{g}{letter}" for letter in "abcdef"]
        edges += [(draw.choice(keys), draw.choice(keys)) for _ in range(draw.randrange(12))]
        starts += draw.choices(keys, k=draw.randrange(4))
    rows = m.dependent_keys(frame([(s,) for s in starts], "failed string"), frame(edges, "metric_key string, dependent_key string"))
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(set(got)) and set(got) == reachable(set(starts) - {None}, edges)


def test_layers_of_diamonds_are_followed_once_per_key(spark, frame):
    """2^12 paths lead through twelve layers of diamonds; pairs are as many as keys."""
    edges = [(f"{i}x{j}", f"{i + 1}x{k}") for i in range(12) for j in range(2) for k in range(2)] + [("12x0", "0x0")]
    rows = m.dependent_keys(frame([("0x0",)], "failed string"), frame(edges, "metric_key string, dependent_key string"))
    assert rows.count() == rows.distinct().count() == 1 + 12 * 2


def test_dependents_are_withheld_in_the_failing_filing_only(frame):
    rows = [(c, 1, "s", k, 1) for c in ("bad", "ok") for k in ("a", "b", "c", "z")]
    edges = frame([("a", "b"), ("b", "gone"), ("gone", "c"), ("c", "a"), ("z", "z")], "metric_key string, dependent_key string")
    odd = frame([("bad", None, "s", "a", D(1), "n1"), (None, 1, "s", "b", D(1), "n2"), ("bad", 1, "s", None, D(1), "n3")], CAND)
    failures = frame([("bad", 1, "b"), ("bad", 1, "b"), (None, 1, "z"), ("ok", 1, None), ("ok", 2, "z")], "company_id string, fy int, metric_key string")
    kept = m.withhold_dependents(cands(frame, rows).unionByName(odd), failures, edges)
    got = sorted((r.company_id or "", r.fy or 0, r.metric_key or "") for r in kept.collect())
    assert got == [("", 1, "b"), ("bad", 0, "a"), ("bad", 1, ""), ("bad", 1, "z"), ("ok", 1, "a"), ("ok", 1, "b"), ("ok", 1, "c"), ("ok", 1, "z")]
    assert m.withhold_dependents(cands(frame, rows), failures.limit(0), edges).count() == 8


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("gh"), st.one_of(st.just(0.0), st.floats(-1e9, 1e9), st.integers(-3, 3).map(float))), min_size=1, max_size=60))
def test_ordered_counts_match_brute_force(frame, rows):
    got = {(r.g, r.v): (r.n, r.below, r.total) for r in ordered_counts(frame(rows, "g string, v double"), ["g"], "v").collect()}
    values = {g: sorted(v for h, v in rows if h == g) for g in "gh"}
    want = {(g, v): (vs.count(v), sum(x < v for x in vs), len(vs)) for g, vs in values.items() for v in vs}
    assert got == want


def test_one_value_holding_most_rows_and_one_hot_group(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("double").alias("v"),
    )
    hot = {r.v: r for r in ordered_counts(df, ["g"], "v").where("g = 'hot'").collect()}
    assert hot[0.0].n == 1500 and hot[0.0].below == 0 and hot[0.0].total == 3000
    assert hot[8997.0].below == 2999
    median = quantiles(df, ["g"], "v", {"q": 0.5}).where("g = 'hot'").first().q
    assert median == (0.0 + 3.0) / 2


def test_dependents_are_never_broadcast(frame, capsys):
    rows = frame([(1, 2000, k, 1.0) for k in range(6)], "company_id int, fy int, metric_key int, value double")
    edges = frame([(0, 1), (1, 2), (2, 0), (4, 5)], "metric_key int, dependent_key int")
    kept = m.withhold_dependents(rows, rows.where("metric_key = 0"), edges)
    assert {r.metric_key for r in kept.collect()} == {3, 4, 5}
    kept.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_rebuild_reads_its_candidates_once(monkeypatch, spark):
    from tidemark.catalog import metrics as catalog

    kept = []
    monkeypatch.setattr(catalog, "staged", lambda df, purpose: kept.append(purpose) or df.limit(0), raising=False)
    assert catalog._m10(spark, "/root/testdata/sf0.001").count() == 0 and kept == ["reported"]
