from decimal import Decimal as D

from tidemark.operators import publication as p

VERSION = "field_id int, filing_id string, field_key string, version int, qa_status string, confidence decimal(5,4), method string, source_page int"


def versions(frame):
    rows = [
        (1, "f", "p1.e1.x", 1, "sampled_ok", D("0.95"), "llm", 1),
        (2, "f", "p1.e1.x", 2, "unreviewed", D("0.99"), "llm", 1),
        (3, "f", "p2.e1.y", 1, "corrected", D("0.50"), "human", 1),
        (4, "f", "p3.e1.z", 1, "sampled_ok", None, "llm", 1),
        (5, "f", "solo", 1, "unreviewed", D("0.70"), "llm", 2),
    ]
    return frame(rows, VERSION)


def test_unreviewed_versions_never_publish(frame):
    assert {r.field_id for r in p.latest_publishable(versions(frame)).collect()} == {1, 3, 4}


def test_three_gates(frame):
    accuracy = frame([("p1.e1", D("0.990000")), ("p2.e1", D("0.970000"))], "family string, accuracy decimal(7,6)")
    out = {r.field_id: r.reasons for r in p.publish_decision(versions(frame), accuracy).collect()}
    assert out[1] == []
    assert out[2] == ["qa_not_passed"]
    assert out[3] == ["confidence_below_threshold", "family_accuracy_below_target"]
    assert out[4] == ["confidence_below_threshold", "family_accuracy_below_target"]


def test_pins_move_and_bad_pins_show(frame):
    pins = frame([("f", "p1.e1.x", 2), ("f", "solo", 5)], "filing_id string, field_key string, field_id int")
    assert {r.field_id for r in p.pin_violations(pins, versions(frame)).collect()} == {2, 5}
    accuracy = frame([("p1.e1", D("1.000000"))], "family string, accuracy decimal(7,6)")
    moved = p.update_pins(pins, p.publish_decision(versions(frame), accuracy))
    assert {(r.field_key, r.field_id) for r in moved.collect()} == {("p1.e1.x", 1), ("solo", 5)}


def test_sample_skips_queued_and_reviewed(frame):
    queued = frame([(2,)], "field_id int")
    out = p.review_sample(versions(frame), queued, 5).collect()
    assert [(r.field_id, r.family, r.confidence_band) for r in out] == [(5, "solo", "medium")]


def test_correction_appends_a_version(frame):
    reviews = frame([(1, 7.0), (5, None)], "field_id int, corrected_value double")
    out = p.corrections(versions(frame), reviews).collect()
    assert [(r.field_key, r.value_num, r.version, r.qa_status) for r in out] == [("p1.e1.x", 7.0, 3, "corrected")]


def test_citations_must_be_verbatim(frame):
    items = frame(
        [("f", "k", 1, "1,000 GJ", 0.9, False), ("f", "k", 1, "made up", 0.9, False), ("f", "other", 1, "Nil", 0.9, False), ("f", "k", 9, "Nil", 0.9, False), ("f", "k", None, None, 0.9, True)],
        "filing_id string, field_key string, source_page int, quote string, confidence double, not_found boolean",
    )
    pages = frame([("f", 1, "Energy was 1,000 GJ. Fines: Nil")], "filing_id string, page_no int, text string")
    out = p.check_citations(items, pages, frame([("k",)], "field_key string")).collect()
    got = sorted((r.quote or "", r.confidence, tuple(r.flags)) for r in out)
    assert got == sorted(
        [("", 0.0, ("not_found",)), ("1,000 GJ", 0.9, ()), ("Nil", 0.0, ("unexpected_field",)), ("Nil", 0.0, ("source_quote_not_verbatim",)), ("made up", 0.0, ("source_quote_not_verbatim",))]
    )


def test_benchmark_counts_missing_as_wrong(frame):
    golden = frame([("p1.a.x", "1"), ("p1.a.y", "2"), ("p2.a.z", "3")], "field_key string, value string")
    found = frame([("p1.a.x", "1"), ("p2.a.z", "3")], "field_key string, value string")
    out = {r.family: (r.accuracy, r.passes) for r in p.benchmark_accuracy(golden, found, ["field_key"]).collect()}
    assert out == {"p1.a": (0.5, False), "p2.a": (1.0, True)}


def test_section_without_pages_reads_all(frame):
    pages = frame([("f", 1, "a"), ("f", 2, None)], "filing_id string, page_no int, section_key string")
    sections = frame([("f", "a"), ("f", "b")], "filing_id string, section string")
    out = sorted((r.section, r.page_no) for r in p.route_sections(sections, pages).collect())
    assert out == [("a", 1), ("b", 1), ("b", 2)]
