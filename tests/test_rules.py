from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import rules as r

ANS = "filing_id string, field_key string, value string, unit string, author string, review_status string, evidence string"
FORM = [r.FieldDef(f"p1.x.f{i}", "P1") for i in range(15)] + [
    r.FieldDef("a.b.total", "A", "number", core=True), r.FieldDef("a.b.one", "A", "number"), r.FieldDef("a.b.two", "A", "number"),
    r.FieldDef("a.b.pct", "A", "number", unit="percent", required=False), r.FieldDef("a.b.flag", "A", "boolean", required=False),
    r.FieldDef("a.b.why", "A", condition=("a.b.flag", "false")), r.FieldDef("a.b.lead", "A", leadership=True),
    r.FieldDef("a.b.when", "A", "date", required=False), r.FieldDef("a.b.rows", "A", repeating=True, required=False),
    r.FieldDef("a.b.whole", "A", "integer", required=False),
]
RELATIONS = [r.Relation("a.b.total", ["a.b.one", "a.b.two"], "0.01")]


def answers(frame, *rows):
    return frame([(f, k, v, u, "user", "accepted", "") for f, k, v, u in rows], ANS)


def of(df):
    return df.select("filing_id").distinct()


def full(filing, skip=()):
    rows = [(filing, f"p1.x.f{i}", "text", None) for i in range(15)] + [(filing, "a.b.total", "3", None), (filing, "a.b.one", "1", None), (filing, "a.b.two", "2", None)]
    return [row for row in rows if row[1] not in skip]


def test_removed_required_fields_are_all_found(frame):
    gone = {f"p1.x.f{i}" for i in range(15)}
    df = answers(frame, *full("ok"), *full("bad", gone))
    found = r.validate_filings(of(df), df, FORM, RELATIONS).collect()
    assert {x.filing_id for x in found} == {"bad"} and len(found) == 15
    assert {x.field_key for x in found} == gone


def test_conditions_switch_requirements(frame):
    rows = [*full("a"), ("a", "a.b.flag", "false", None), *full("b"), ("b", "a.b.flag", "true", None)]
    df = answers(frame, *rows)
    found = r.missing_required(of(df), df, FORM).collect()
    assert [(x.filing_id, x.field_key) for x in found] == [("a", "a.b.why")]


def test_typed_values(frame):
    cases = [
        ("a.b.whole", "1,200", None, None, "1200"), ("a.b.whole", "1.5", None, "Expected a whole number", None), ("a.b.one", " 1,234.50 ", None, None, "1234.50"),
        ("a.b.one", "x", None, "Expected a number", None), ("a.b.flag", "YES", None, None, "true"), ("a.b.flag", "maybe", None, "Expected true/false or yes/no", None),
        ("a.b.when", "2024-02-29", None, None, "2024-02-29"), ("a.b.when", "2023-02-29", None, "Expected an ISO date", None), ("a.b.rows", "[1]", None, None, "[1]"),
        ("a.b.rows", "{}", None, "Repeating groups must be a JSON array", None), ("a.b.pct", "5", None, "Expected unit percent", None),
        ("a.b.pct", "101", "percent", "Percentage must be between 0 and 100", None), ("a.b.pct", "99.5", "percent", None, "99.5"), ("p1.x.f1", "  ", None, "Value cannot be empty", None),
        ("a.b.whole", "12.0000001", None, "Expected a whole number", None), ("a.b.whole", "1e3", None, None, "1000"), ("a.b.whole", "1.5e1", None, None, "15"), ("a.b.whole", "-0.0", None, None, "0"),
        ("a.b.pct", "100.0000001", "percent", "Percentage must be between 0 and 100", None), ("a.b.pct", "100.000", "percent", None, "100.000"), ("a.b.pct", "-0.1", "percent", "Percentage must be between 0 and 100", None),
        ("a.b.one", "1" * 35, None, None, "1" * 35), ("a.b.one", "1.50e1", None, None, "15.0"), ("a.b.one", "12e-4", None, None, "0.0012"), ("a.b.one", ".5", None, None, "0.5"), ("a.b.one", "1e", None, "Expected a number", None),
    ]
    rows = [(str(i), key, value, unit) for i, (key, value, unit, _, _) in enumerate(cases)]
    out = {int(x.filing_id): (x.error, x.normalised) for x in r.check_values(answers(frame, *rows), FORM).collect()}
    assert [out[i] for i in range(len(cases))] == [(error, normal) for *_, error, normal in cases]


def test_relations_and_movement(frame):
    rows = [("f", "a.b.total", "10", None), ("f", "a.b.one", "1", None), ("f", "a.b.two", "2", None), ("g", "a.b.total", "10", None)]
    found = r.relation_findings(answers(frame, *rows), RELATIONS).collect()
    assert [(x.filing_id, x.message) for x in found] == [("f", "Total 10 does not equal component sum 3")]
    prior = frame([("f", "a.b.total", "4"), ("f", "a.b.one", "0"), ("f", "a.b.two", "bad")], "filing_id string, field_key string, value string")
    moved = r.movement_findings(answers(frame, *rows), prior, FORM).collect()
    assert [(x.field_key, x.severity) for x in moved] == [("a.b.total", "warning")]
    assert {x.field_key for x in r.prefill_candidates(answers(frame, rows[0]), prior, FORM).collect()} == {"a.b.one", "a.b.two"}


def test_unreviewed_machine_answer_blocks_export_and_progress(frame):
    rows = [(f, k, v, u, "user", "accepted", "d") for f, k, v, u in full("f") + full("g")]
    rows[0] = (*rows[0][:4], "ai", "unreviewed", "")
    df = frame(rows, ANS)
    filings = frame([("f",), ("g",), ("empty",)], "filing_id string")
    found = r.validate_filings(filings, df, FORM, RELATIONS)
    assert {x.filing_id: x.allowed for x in r.export_gate(filings, found).collect()} == {"f": False, "g": True, "empty": False}
    assert found.where("filing_id = 'empty'").count() == 18  # every required field
    sections, summary = r.progress(filings, df, FORM)
    pct = {(x.filing_id, x.principle): x.pct for x in sections.collect()}
    assert pct["f", "P1"] == 93 and pct["g", "P1"] == 100 and pct["g", "A"] == 100
    state = {x.filing_id: x for x in summary.collect()}
    assert (state["f"].overall_pct, state["f"].core_pct, state["f"].complete) == (96, 100, False)
    assert state["g"].complete and not state["empty"].complete and state["empty"].overall_pct == 0
    gaps = {x.filing_id: (x.score, x.findings) for x in r.gap_scores(summary, found).collect()}
    assert gaps == {"f": (72, 1), "g": (74, 0), "empty": (0, 18)}


def test_single_pass_findings_equal_the_separate_ones(frame):
    rows = [*full("a", {"a.b.one"}), ("a", "nope", "x", None), ("a", "a.b.flag", "maybe", None), *full("b"), ("b", "a.b.pct", "7", None)]
    df = answers(frame, *rows)
    once = sorted(tuple(x) for x in r.validate_filings(of(df), df, FORM, RELATIONS).collect())
    parts = [r.unknown_fields(df, FORM), r.value_findings(df, FORM), r.relation_findings(df, RELATIONS), r.missing_required(of(df), df, FORM), r.unreviewed_machine_answers(df)]
    assert once == sorted(tuple(x) for part in parts for x in part.collect())
    assert len(once) == 4


def test_status_steps_across_months(frame):
    days = [("k", 1, datetime(2024, 1, 1), "new"), ("k", 2, datetime(2024, 1, 2), "scoped"), ("k", 3, datetime(2024, 3, 1), "scoped"), ("k", 4, datetime(2024, 4, 1), "delivered"), ("k", 5, datetime(2024, 4, 1), "new")]
    log = frame(days, "k string, id int, at timestamp, status string")
    steps = {"new": "scoped", "scoped": "quoted", "quoted": "delivered"}
    out = r.status_step_violations(log, ["k"], "at", "id", "status", steps).collect()
    assert sorted((x.id, x.previous) for x in out) == [(4, "scoped"), (5, "delivered")]


def test_lint(frame):
    fields = frame([("a.b.c", "text", "C", None, None), ("a.b.c", "text", "D", None, None), ("zz", "blob", None, "GJ", None)], "field_key string, dtype string, concept string, unit string, unit_family string")
    relations = frame([("total", "a.b.c"), ("total", "gone")], "relation string, reference string")
    out = {(x.rule, x.subject) for x in r.lint_fields(fields, relations, 3).collect()}
    assert out == {("duplicate field_key", "a.b.c"), ("invalid field_key", "zz"), ("invalid dtype", "zz"), ("missing concept", "zz"), ("unit without family", "zz"), ("unknown relation reference", "total gone")}


def test_templates(frame):
    rows = r.expand_templates(frame([(1,), (2,)], "n int"), [F.col("n")], ["x", "y"], F.concat(F.lit("P"), "n"))
    assert {(x.principle, x.item) for x in rows.collect()} == {("P1", "x"), ("P1", "y"), ("P2", "x"), ("P2", "y")}


def test_totals_are_compared_with_all_digits(frame):
    strict = [r.Relation("a.b.total", ["a.b.one", "a.b.two"])]
    cases = {
        "eq": ("3.0", "1", "2.00"), "tiny": ("3.0000001", "1", "2"), "neg": ("-3", "-1.5", "-1.5"), "less": ("-3.25", "-1.5", "-1.5"),
        "big": ("1" * 35, "1" * 34 + "0", "1"), "bigger": ("1" * 35, "1" * 34 + "0", "2"), "exp": ("1e3", "999", "1"), "none": ("x", "1", "2"),
    }
    rows = [(f, k, v, None) for f, values in cases.items() for k, v in zip(("a.b.total", "a.b.one", "a.b.two"), values, strict=True)]
    found = {x.filing_id: x.message for x in r.relation_findings(answers(frame, *rows), strict).collect()}
    assert found == {
        "tiny": "Total 3.0000001 does not equal component sum 3",
        "less": "Total -3.25 does not equal component sum -3.0",
        "bigger": f"Total {'1' * 35} does not equal component sum {'1' * 34}2",
    }
    within = r.relation_findings(answers(frame, *rows), [r.Relation("a.b.total", ["a.b.one", "a.b.two"], "0.25")]).collect()
    assert {x.filing_id for x in within} == {"bigger"}


def test_conditions_look_below_the_basics(frame):
    form = [r.FieldDef("a.basics.listed", "A", required=False), r.FieldDef("a.b.code", "A", condition=("listed", "yes"))]
    df = answers(frame, ("f", "a.basics.listed", "yes", None), ("g", "a.basics.listed", "no", None))
    assert [x.filing_id for x in r.missing_required(of(df), df, form).collect()] == ["f"]


def test_small_prior_values_count(frame):
    prior = frame([("f", "a.b.one", "0.0000001")], "filing_id string, field_key string, value string")
    moved = r.movement_findings(answers(frame, ("f", "a.b.one", "0.0000003", None)), prior, FORM).collect()
    assert [x.field_key for x in moved] == ["a.b.one"]


def test_prefill_never_broadcasts_answers(frame, capsys):
    prior = frame([(1, "a", "x"), (1, "b", "y"), (None, "a", "z"), (2, "q", "w")], "filing_id long, field_key string, value string")
    now = frame([(1, "a"), (None, "a")], "filing_id long, field_key string")
    rows = r.prefill_candidates(now, prior, [r.FieldDef("a", "A"), r.FieldDef("b", "A")])
    assert {(x.filing_id, x.field_key) for x in rows.collect()} == {(1, "b"), (None, "a")}
    rows.explain()
    assert "BroadcastHashJoin [filing_id" not in capsys.readouterr().out


def test_filings_are_gathered_without_sorting(frame, capsys):
    form = [r.FieldDef(f"a.b.f{i}", "A", condition=("a.b.f0", "No") if i == 69 else None) for i in range(70)]
    rows = [("x", f"a.b.f{i}", "No" if i == 0 else "v", None) for i in range(70) if i not in (61, 62, 63, 69)] + [("y", "a.b.f0", "No", None), ("y", "a.b.f0", "Yes", None)]
    df = answers(frame, *rows)
    found = r.missing_required(of(df), df, form)
    assert sorted(x.field_key for x in found.where("filing_id = 'x'").collect()) == ["a.b.f61", "a.b.f62", "a.b.f63", "a.b.f69"]
    assert found.where("filing_id = 'y'").count() == 68  # the greatest answer is Yes, so f69 is not asked for
    found.explain()
    plan = capsys.readouterr().out
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
