from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import mapping as m


def test_unit_conversion(frame):
    rows = [("1000", " kWh", None), ("2", "MWh", None), ("1.5", "ML", None), ("1250", "kg CO2e", None), ("1", "GJ", "kWh"), ("1", "GJ", "KL"), ("1", "furlong", None)]
    out = m.convert_units(frame(rows, "v string, u string, t string"), "v", "u", "t").collect()
    got = [(float(r.converted) if r.converted is not None else None, r.converted_unit, r.unit_error) for r in out]
    assert got[:4] == [(3.6, "GJ", None), (7.2, "GJ", None), (1500.0, "KL", None), (1.25, "tCO2e", None)]
    assert abs(got[4][0] - 277.77777778) < 1e-6
    assert got[5] == (None, None, "incompatible_units") and got[6] == (None, None, "unknown_unit")


def test_locale_numbers(frame):
    cases = [("1,23,456", 123456), ("2.5 crore", 25000000), ("₹4 lakh", 400000), ("Nil", 0), ("12.5%", 12.5), ("10 to 20", 15), ("10 – 20", 15), ("INR 7", 7), ("n/a", None)]
    out = t.parse_numbers(frame([(c,) for c, _ in cases], "raw string"), "raw", "n").select("n.*").collect()
    assert [None if r.value is None else float(r.value) for r in out] == [v for _, v in cases]
    assert out[3].is_nil and out[4].is_percent and (float(out[5].lower), float(out[5].upper)) == (10, 20)


def test_total_relation(frame):
    df = frame([(D(100), D(40), D(30)), (D(100), D(70), D(30))], "t decimal(10,2), a decimal(10,2), b decimal(10,2)")
    out = df.select(m.check_total(F.col("t"), [F.col("a"), F.col("b")]).alias("c")).select("c.*").collect()
    assert [(r.passed, r.flag) for r in out] == [(False, "declared_total_mismatch"), (True, None)]


FACT = "filing_id string, concept string, context_id string, period_end date, ordinal int, fact_id string, value_num decimal(30,8), unit string"
MAPPINGS = [
    m.ConceptMapping("Turnover", "a.turnover", "INR", registered_scale=True),
    m.ConceptMapping("Energy", "p6.energy", "GJ", {"GJ": "1", "MJ": "0.001"}),
    m.ConceptMapping("Old", "p6.old", "GJ", {"GJ": "1"}, review_status="rejected"),
]


def test_publish_resolves_scales_and_withholds_only_what_it_must(frame):
    end = date(2025, 3, 31)
    filings = frame([(i, i) for i in ("COAL", "REDDY", "INFY", "NEW", "GAP")], "filing_id string, issuer string")
    rows = [
        ("COAL", "Turnover", "main", end, 1, "f1", D("143368.92"), "INR"),
        ("REDDY", "Turnover", "main", end, 1, "f2", D("231154"), "INR"),
        ("INFY", "Turnover", "main", end, 1, "f3", D("1289330074464.23"), "INR"),
        ("NEW", "Turnover", "main", end, 1, "f4", D("500"), "INR"),
        ("COAL", "Energy", "main", end, 1, "f5", D("5000"), "MJ"),
        ("COAL", "Energy", "main", end, 9, "f6", D("7000"), "MJ"),
        ("COAL", "Energy", "other", end, 10, "f7", D("1"), "GJ"),
        ("REDDY", "Energy", "main", end, 1, "f8", D("1"), "J"),
        ("INFY", "Energy", "main", date(2024, 3, 31), 1, "f9", D("1"), "GJ"),
        ("NEW", "Energy", "main", end, 1, "f0", None, "GJ"),
    ]
    registry = frame([("coal", "crore"), ("REDDY", "million")], "issuer string, scale string")
    out = m.publish_mappings(filings, frame(rows, FACT), MAPPINGS, registry, 2025).collect()
    got = {(r.filing_id, r.field_key): (r.status, None if r.value_num is None else float(r.value_num), r.resolved_scale) for r in out}
    assert got["COAL", "a.turnover"] == ("published", 1433689200000.0, "crore")
    assert got["REDDY", "a.turnover"] == ("published", 231154000000.0, "million")
    assert got["INFY", "a.turnover"][::2] == ("published", "absolute")
    assert got["NEW", "a.turnover"] == ("withheld", None, None)
    assert got["COAL", "p6.energy"] == ("published", 7.0, "MJ")
    assert got["REDDY", "p6.energy"][0] == "withheld"
    assert {got[k, "p6.energy"][0] for k in ("INFY", "NEW", "GAP")} == {"missing"}
    assert len(got) == 10


def test_versions_are_reused_for_the_same_fact(frame):
    published = frame([("f", "k", "x1", "published"), ("g", "k", "x2", "published"), ("h", "k", "x3", "published")], "filing_id string, field_key string, fact_id string, status string")
    latest = frame([("f", "k", 3, "x1", "v2"), ("g", "k", 5, "x2", "v1")], "filing_id string, field_key string, version int, fact_id string, mapping_version string")
    out = {r.filing_id: (r.reused, r.version) for r in m.reuse_versions(published, latest, "v2").collect()}
    assert out == {"f": (True, 3), "g": (False, 6), "h": (False, 1)}


def test_text_facts_publish_only_on_request(frame):
    end = date(2025, 3, 31)
    filings = frame([("f", "i")], "filing_id string, issuer string")
    facts = frame([("f", "Energy", "main", end, 1, "x", None, None, " Yes ")], FACT + ", value_raw string")
    registry = frame([], "issuer string, scale string")
    run = lambda **options: [
        (r.status, r.asDict().get("value_text"))
        for r in m.publish_mappings(filings, facts, MAPPINGS[1:2], registry, 2025, **options).collect()
    ]
    assert run() == [("missing", None)]
    assert run(passthrough_text=True) == [("published", "Yes")]
