from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import scores as s
from tidemark.operators import text as x

PIN = "filing_id string, company_id string, fy int, field_key string, value_raw string, method string, source_page int, has_span boolean, pin_id string"
DEFS = "field_key string, dtype string, core boolean"


def test_completeness_weights_core_twice(frame):
    defs = frame([("c1", "number", True), ("c2", "number", True), ("e1", "number", False), ("e2", "number", False)], DEFS)
    pins = frame([("f", "a", 1, "c1", "1", "llm", 1, True, "p1"), ("f", "a", 1, "e1", "1", "llm", 1, True, "p2")], PIN)
    row = s.completeness(pins, defs).first()
    assert (row.value, row.weighted_points, row.weighted_possible) == (50.0, 3, 6)


def test_two_identical_texts_have_no_own_phrase(frame):
    text = "one two three four five six seven eight nine ten"
    texts = frame([("a", text), ("b", text)], "company string, text string")
    phrases = x.distinct_phrases(texts, ["company"], "text")
    shared = x.boilerplate(phrases, "company", threshold=2)
    assert shared.count() == 3
    assert {r.originality for r in x.originality(phrases, texts, "company", shared).collect()} == {0.0}
    words = {(r.phrase, r.company_count) for r in x.shared_phrases(texts, ["company"], "company", "text", threshold=2).collect()}
    assert words == {(" ".join(text.split()[k : k + 8]), 2) for k in range(3)}


def test_phrases_are_never_shuffled(frame, capsys):
    texts = frame([(1, "a", "x"), (2, "b", "x")], "d int, company string, text string")
    x.shared_phrases(texts, ["d"], "company", "text", threshold=2).explain()
    lines = capsys.readouterr().out.splitlines()
    assert not any("Exchange hashpartitioning(phrase" in line and "phrase_key" not in line for line in lines)


def test_short_text_has_no_shingle(frame):
    assert x.shingle_rows(frame([("a", "too short")], "d string, text string"), ["d"], "text").count() == 0


def test_narrative_signals(frame):
    rows = [("We target a 20% cut by FY 2030 with ISO 14001",), ("We may consider our ambitions",), (None,)]
    out = frame(rows, "text string").select(*[c.alias(n) for n, c in t.narrative_signals(F.col("text")).items()]).collect()
    assert tuple(out[0]) == (True, True, True)
    assert tuple(out[1]) == tuple(out[2]) == (False, False, False)


def test_full_marks_and_readiness(frame):
    defs = frame([("p.text", "text", False), ("p.assurance", "text", True), *[(f"core{i}", "number", True) for i in range(4)]], DEFS)
    text = "We target a 20% cut by 2030 under the GHG Protocol"
    rows = [("f", "a", 1, "p.text", text, "llm", 1, True, "p3"), ("f", "a", 1, "p.assurance", "Reasonable", "xbrl", None, True, "p1")]
    rows += [("f", "a", 1, f"core{i}", "1", "xbrl", None, True, f"q{i}") for i in range(3)]
    pins = frame(rows, PIN)
    assert s.substance(pins, defs).first().value == 100.0
    ready = s.assurance_readiness(pins, defs).first()
    assert (ready.assurance, ready.core_coverage, ready.lineage_quality, ready.value) == (True, 0.8, 1.0, 93.0)
    out = s.score_rows(pins, defs).collect()
    assert {r.score_key for r in out} == {"completeness", "substance", "assurance_readiness"}
    assert {r.pin_id for r in out} == {"p1"}
    assert len({r.score_id for r in out}) == 3
