from datetime import date
from decimal import Decimal as D

from tidemark.sources import registry as g
from tidemark.sources import sinks, xbrl

INSTANCE = b"""<?xml version="1.0"?>
<xbrl xmlns:f="urn:f"><context id="C"><period><startDate>2024-04-01</startDate><endDate>2025-03-31</endDate></period>
<segment><explicitMember dimension="f:axis"> f:one </explicitMember></segment></context>
<unit id="U"><measure>iso4217:INR</measure></unit><unit id="R"><divide><measure>f:GJ</measure><measure>f:INR</measure></divide></unit>
<f:Turnover contextRef="C" unitRef="U" decimals="-7">1,250</f:Turnover><f:Unmapped contextRef="C">text</f:Unmapped>
<f:Ratio contextRef="C" unitRef="R" decimals="INF">0.5</f:Ratio><f:Blank contextRef="C"> </f:Blank><f:NoContext>1</f:NoContext></xbrl>"""


def test_instances_from_files(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(INSTANCE)
    (tmp_path / "broken.xml").write_bytes(b"<xbrl><open></xbrl>")
    rows = xbrl.read_instances(spark, str(tmp_path)).collect()
    facts = {r.concept: r for r in rows if r.error is None}
    assert set(facts) == {"Turnover", "Unmapped", "Ratio"}
    turnover = facts["Turnover"]
    assert (turnover.value_num, turnover.unit, turnover.decimals) == (D("1250"), "INR", -7)
    assert (turnover.period_start, turnover.period_end) == (date(2024, 4, 1), date(2025, 3, 31))
    assert turnover.dimensions == {"f:axis": "f:one"}
    assert facts["Ratio"].unit == "GJ/INR" and facts["Ratio"].decimals is None
    assert facts["Unmapped"].value_num is None
    assert sum(r.error is not None for r in rows) == 1


def test_artifacts_and_manifest(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.xml").write_bytes(b"\n <x/>")
    found = g.sniff(g.read_artifacts(spark, str(tmp_path)))
    kinds = {r.filename: r.artifact_type for r in found.collect()}
    assert kinds == {"a.pdf": "pdf", "b.pdf": None, "c.xml": "xbrl"}
    manifest = found.where("filename <> 'b.pdf'")
    assert [r.filename for r in g.manifest_mismatches(found, manifest).collect()] == ["b.pdf"]


def test_registry_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿Company Name,Industry,Symbol,ISIN Code\n Alpha ,Power, ALP ,IN1\n,,BET,IN2\nGamma,,,IN3\n", encoding="utf-8")
    out = [tuple(r) for r in g.read_registry(spark, str(path)).orderBy("symbol").collect()]
    assert out == [("Alpha", "Power", "ALP", "IN1"), ("BET", "Unclassified", "BET", "IN2")]


def test_second_list_keeps_first_slot(frame):
    first = frame([("A", 0), ("B", 1)], "symbol string, row_no int")
    second = frame([("B", 0), ("C", 1)], "symbol string, row_no int")
    rows = g.with_ordinal(g.ordered_union([first, second], "symbol", "row_no"))
    assert {r.symbol: r.ordinal for r in rows.collect()} == {"A": 0, "B": 1, "C": 2}
    assert {r.symbol for r in g.cohort_slice(rows, "next", 2, next_offset=1).collect()} == {"B", "C"}
    known = frame([("C",), ("A",)], "symbol string")
    assert [r.symbol for r in g.cohort_slice(rows, "refresh", 1, registered=known).collect()] == ["A"]


def test_registry_build_ranks_by_market_cap(frame):
    rows = [("L1", "One", "one", "35101", "Power", D(1000)), ("L2", "Two", "two", "62011", "IT", D(1100)), ("L3", "Three", "t3", "99000", "?", D(900))]
    out = g.build_registry(frame(rows, "cin string, name string, ticker string, nic_code string, industry string, market_cap decimal(10,2)"), 2)
    got = {r.cin: (r.rank, r.sector, r.ticker, r.mcap_band) for r in out.collect()}
    assert got == {"L2": (1, "Technology & Communications", "TWO", "large"), "L1": (2, "Energy & Utilities", "ONE", "large")}


def test_revision_beats_original(frame):
    rows = [
        (1, "abc", 2025, "01-Jul-2025", "-", "a.xml"),
        (2, "ABC", 2025, "30-Jun-2025", "03-Jul-2025", "b.xml"),
        (3, "ABC", 2025, "-", "09-Jul-2025", "c.xml"),
        (4, "ABC", 2025, "05-Jul-2025", "-", None),
    ]
    out = g.latest_revisions(frame(rows, "feed_id int, symbol string, fy_to int, submission string, revision string, xbrl_file string"))
    assert [(r.feed_id, r.revision_date) for r in out.collect()] == [(2, date(2025, 7, 3))]


def test_dataset_keeps_its_licence(spark, frame, tmp_path):
    df = frame([("S", 2025)], "sector string, financial_year int")
    for kind in ("csv", "parquet"):
        sinks.write_dataset(df, f"{tmp_path}/{kind}", kind)
        assert "licence" in spark.read.text(f"{tmp_path}/{kind}_licence").first().value
    meta = spark.read.parquet(f"{tmp_path}/parquet").schema["sector"].metadata
    assert meta["licence_terms"] == "/licence"


def test_every_csv_file_begins_with_the_licence(spark, frame, tmp_path):
    values = ["plain", "#not a note", 'with "quotes", comma', "", None, " padded ", "back\\slash", "é", "# licence: no"]
    schema = "`first, name` string, n int, note string"
    df = frame([(v, i, v) for i, v in enumerate(values)], schema).repartition(3)
    licence = {"licence": "Line one\nline two", "terms": "/t"}
    sinks.write_licensed_csv(df, f"{tmp_path}/csv", licence)
    files = [p.read_text().splitlines() for p in (tmp_path / "csv").glob("part-*")]
    assert len(files) == 3 and all(f[:4] == ["# licence: Line one", "# line two", "# terms: /t", '"first, name",n,note'] for f in files)
    options = {"header": True, "comment": "#", "escape": '"'}
    back = spark.read.options(**options).schema(schema).csv(f"{tmp_path}/csv")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == [(v or None, i, v or None) for i, v in enumerate(values)]
    assert sum('"",3,""' in f for f in files) == 1
    assert spark.read.options(**options).csv(f"{tmp_path}/csv").columns == df.columns
    sinks.write_licensed_csv(df.limit(0), f"{tmp_path}/empty", licence)
    assert spark.read.options(**options).schema(schema).csv(f"{tmp_path}/empty").count() == 0


def test_event_months_replace_only_themselves(spark, frame, tmp_path):
    path = f"{tmp_path}/events"
    df = frame([(1, "2024-01-05"), (2, "2024-02-05")], "event_id int, ts string").selectExpr("event_id", "timestamp(ts) ts")
    sinks.write_events_by_month(df, path)
    sinks.write_events_by_month(df.where("event_id = 2").selectExpr("event_id + 7 event_id", "ts"), path)
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == [1, 9]


def test_link_discovery(frame):
    html = '<a href="/x">2022</a><A class=z HREF=/brsr-2021.pdf><b>Report</b></A><a href="/brsr-2022.pdf">later</a>'
    out = g.find_report_link(frame([(1, html), (2, "<p>none</p>")], "page_id int, html string"), ["brsr"], __import__("pyspark.sql.functions", fromlist=["lit"]).lit(2022)).collect()
    assert [(r.page_id, r.href, r.label) for r in out] == [(1, "/brsr-2021.pdf", "Report")]


def test_short_documents_are_read_together_and_long_ones_as_a_stream():
    """Each document gives what it gives alone, whatever its neighbours are; broken ones do not mend each other."""
    read, alone = xbrl.fact_reader(), xbrl.fact_reader(0)
    fact = b'<x:r xmlns:x="urn:x"><x:context id="c"><x:instant>2024-01-01</x:instant></x:context><x:Q contextRef="c">7&amp;</x:Q></x:r>'
    nested = b'<r><context id="a"><context id="b"><instant>2024-01-01</instant></context></context><Q contextRef="b">1</Q></r>'
    odd = [b"<a><x/>", b"</a><b/>", b"<a/><b/>", b"<a/>&#32;", b" <a/> ", b'<a x=">', b'"/>', b"", b"<p:a/>", b"</r><r>", "<a/>".encode("utf-16"), b'<!DOCTYPE a [<!ENTITY e "v">]><a contextRef="c">&e;</a>']
    for those in ([fact] * 5, [fact, *odd, fact], [INSTANCE, nested, fact], *([fact, o] for o in odd), odd[:2]):
        assert read(those) == [alone([one])[0] for one in those]
    assert read([fact])[0] == [("Q", "7&", None, None, "2024-01-01", "c", [], 3, None, None)]
    assert read([nested])[0][0][3:6] == (None, "2024-01-01", "b")


def test_short_documents_take_no_call_for_every_element(monkeypatch):
    from xml.parsers import expat

    monkeypatch.setattr(expat, "ParserCreate", None)  # the stream is not needed
    many = [b'<r><unit id="u"><measure>iso:GJ</measure></unit><Q contextRef="c" unitRef="u" decimals="2">%d</Q></r>' % k for k in range(500)]
    assert [rows[0][:3] for rows in xbrl.fact_reader()(many)] == [("Q", str(k), "GJ") for k in range(500)]
