import pytest
from pyspark.sql import functions as F

from tidemark.plans import semantic as s

CATALOG = s.Catalog({"energy": s.Measure("metric"), "intensity": s.Measure("metric", tiers=("pro",)), "substance": s.Measure("score")})
BASE = {"measures": ["energy"], "dimensions": ["sector"], "filters": [], "shape": "distribution"}


@pytest.fixture(scope="module")
def star(frame):
    companies = frame([(i, f"C{i}", "S1" if i < 6 else "S2", "I", "large") for i in range(9)], "company_id int, company string, sector string, industry string, mcap_band string")
    metrics = frame([(i, 2025, "energy", float(i), f"p{i}") for i in range(9)], "company_id int, fy int, metric_key string, value double, pin_id string")
    scores = frame([(i, 2025, "substance", v, float(i + n), f"q{i}") for i in range(9) for n, v in enumerate(("1.0", "1.1"))], "company_id int, fy int, score_key string, method_version string, value double, pin_id string")
    return metrics, scores, companies


def test_unknown_keys_and_shape_rules():
    for change in (
        {"measures": ["nope"]}, {"measures": []}, {"measures": ["energy", "energy"]}, {"dimensions": ["planet"]}, {"shape": "pie"},
        {"shape": "timeseries"}, {"shape": "ranking"}, {"limit": 251}, {"filters": [{"dimension": "planet", "operator": "eq", "value": 1}]},
        {"filters": [{"dimension": "fy", "operator": "between", "value": [1]}]}, {"filters": [{"dimension": "fy", "operator": "in", "value": 1}]},
    ):
        with pytest.raises(s.SpecError):
            s.validate({**BASE, **change}, CATALOG)
    s.validate(BASE, CATALOG)


def test_thin_cohorts_are_flagged_and_kept(star):
    data = s.semantic_query(*star, BASE, "pro", CATALOG).data
    rows = {r.sector: (r.value, r.cohort_n, r.thin_cohort) for r in data.collect()}
    assert rows == {"S1": (2.5, 6, False), "S2": (7.0, 3, True)}
    assert tuple(s.thin_notice(data).first()) == (1, 3, 3)


def test_tier_gates(star):
    spec = {**BASE, "measures": ["energy", "intensity"], "dimensions": ["company"], "shape": "ranking"}
    result = s.semantic_query(*star, spec, "explore", CATALOG)
    assert result.data is None
    assert [n["code"] for n in result.notices] == ["tier_gated", "company_detail_gated"]


def test_filter_text_stays_a_value(star):
    spec = {**BASE, "filters": [{"dimension": "sector", "operator": "eq", "value": "S1' OR 1=1 --"}]}
    assert s.semantic_query(*star, spec, "pro", CATALOG).data.count() == 0


def test_newest_method_version_and_bottom_ranking(star):
    spec = {"measures": ["substance"], "dimensions": ["company"], "shape": "ranking", "sort": {"direction": "asc"}, "limit": 2}
    rows = s.semantic_query(*star, spec, "pro", CATALOG).data.collect()
    assert [r.value for r in rows] == [1.0, 2.0]
    assert "company" not in rows[0].asDict() and rows[0].cohort.startswith("anonymised")


def test_follow_up_context():
    base = {**BASE, "filters": [{"dimension": "fy", "operator": "eq", "value": 2024}, {"dimension": "sector", "operator": "eq", "value": "S1"}]}
    follow = {**BASE, "filters": [{"dimension": "fy", "operator": "eq", "value": 2025}]}
    merged, origin = s.merge_context(base, follow)
    assert [(f["dimension"], f["value"]) for f in merged["filters"]] == [("sector", "S1"), ("fy", 2025)]
    assert origin == {"applied": True, "inherited": ["sector"], "overridden": ["fy"]}
    assert s.merge_context(None, follow) == (follow, {"applied": False, "inherited": [], "overridden": []})


def test_drill_and_filters():
    base = {**BASE, "filters": [{"dimension": "sector", "operator": "eq", "value": "old"}, {"dimension": "fy", "operator": "eq", "value": 1}]}
    out = s.drill_down(base, [("sector", "S2")])
    assert out["dimensions"] == ["company"] and out["shape"] == "ranking"
    assert [f["value"] for f in out["filters"]] == [1, "S2"]
    assert s.set_filter(base, "fy", None)["filters"] == base["filters"][:1]
    with pytest.raises(s.SpecError):
        s.require_public_measures(BASE)


def test_normalised_rows(frame):
    df = frame([("A", 2.0), (None, 1.0), ("C", float("nan")), ("D", None)], "sector string, value double")
    out = {r.label: r.value for r in s.normalise(df, "sector", F.desc("value")).collect()}
    assert out == {"A": 2.0, "Cohort 3": 1.0} or out == {"A": 2.0, "Cohort 2": 1.0}
