"""Sources, sinks, ingestion: S1-S14."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark import config
from tidemark.catalog import query
from tidemark.catalog.fragments import COMPANIES, FACTS, SCORES
from tidemark.catalog.governed import CATALOG
from tidemark.functions.exprs import rule_table
from tidemark.operators import relational as r
from tidemark.plans import semantic
from tidemark.session import shared_dir
from tidemark.sources import registry as g
from tidemark.sources import sinks, xbrl


@query(
    "s1_registry_csv",
    """SELECT CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE 'Company, ' || s_suppkey END AS name, CASE WHEN s_suppkey % 4 = 1 THEN 'Unclassified' ELSE n_name END AS industry,
      s_name AS symbol, 'IN' || (s_suppkey * 7) AS isin FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 9 <> 2 AND s_suppkey % 11 <> 3""",
)
def _s1(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("company_id")
    blank = lambda condition, value: F.when(condition, F.lit(None)).otherwise(value)
    rows = b.companies(spark, d).select(
        blank(key % 5 == 0, F.concat(F.lit(" Company, "), key)).alias(g.BOM + "Company Name"),
        blank(key % 4 == 1, F.col("industry")).alias("Industry"),
        blank(key % 9 == 2, F.concat(F.lit("  "), "company")).alias("Symbol"),
        blank(key % 11 == 3, F.concat(F.lit("IN"), key * 7)).alias("ISIN Code"),
    )
    path = shared_dir(spark, "registry")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return g.read_registry(spark, path)


def instances(spark: SparkSession, d: str) -> DataFrame:
    """One instance document per line item: a few facts in one context, as XML text."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"]
    li = b.spread(b.table(spark, d, "lineitem").select(*columns))
    text = lambda column: F.col(column).cast("string")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    year, whole = F.year("l_shipdate"), F.col("l_quantity").cast("int")
    body = F.concat(
        F.lit('<x:xbrl xmlns:x="urn:x" xmlns:f="urn:f"><x:context id="c1"><x:period><x:startDate>'),
        year - 1,
        F.lit("-04-01</x:startDate><x:endDate>"),
        year,
        F.lit('-03-31</x:endDate></x:period><x:scenario><x:explicitMember dimension="f:flag">'),
        text("l_returnflag"),
        F.lit('</x:explicitMember></x:scenario></x:context><x:unit id="u1"><x:measure>iso:GJ</x:measure></x:unit>'),
        F.lit('<x:unit id="u2"><x:divide><x:measure>iso:INR</x:measure><x:measure>f:piece</x:measure></x:divide></x:unit>'),
        F.lit('<f:Quantity contextRef="c1" unitRef="u1" decimals="2">1,0'),
        F.when(whole.isNull(), "null").when(whole.between(0, 9), F.concat(F.lit("0"), whole)).otherwise(whole.cast("string")),
        F.lit('</f:Quantity><f:Price contextRef="c1" unitRef="u2" decimals="INF"> '),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        F.lit(' </f:Price><f:Flag contextRef="c1">'),
        text("l_linestatus"),
        F.lit('</f:Flag><f:Empty contextRef="c1"> </f:Empty><f:Note>no context</f:Note></x:xbrl>'),
    )
    return li.select(name.alias("file_id"), F.encode(body, "UTF-8").alias("content"))


NAME = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
XFACT = f"""doc AS (SELECT {NAME} AS file_id, year(l_shipdate) AS y, l_returnflag AS rf, l_linestatus AS ls, CAST(l_quantity AS INTEGER) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem),
xf AS (SELECT file_id, 'Quantity' AS concept, '1,0' || lpad(CAST(q AS VARCHAR), 2, '0') AS value_raw, CAST(1000 + q AS DOUBLE) AS value_num, 'GJ' AS unit, y, rf, 2 AS decimals FROM doc
  UNION ALL SELECT file_id, 'Price', CAST(p AS VARCHAR), CAST(p AS DOUBLE), 'INR/piece', y, rf, NULL FROM doc
  UNION ALL SELECT file_id, 'Flag', ls, NULL, NULL, y, rf, NULL FROM doc)"""


@query(
    "s2_xbrl_facts",
    f"""WITH {XFACT} SELECT file_id, concept, value_raw, value_num, unit, (y - 1) || '-04-01' AS period_start, y || '-03-31' AS period_end, rf AS member, CAST(decimals AS DOUBLE) AS decimals FROM xf""",
)
def _s2(spark: SparkSession, d: str) -> DataFrame:
    facts = xbrl.parse_documents(instances(spark, d))
    return facts.select(
        "file_id",
        "concept",
        "value_raw",
        F.col("value_num").cast("double").alias("value_num"),
        "unit",
        F.col("period_start").cast("string").alias("period_start"),
        F.col("period_end").cast("string").alias("period_end"),
        F.col("dimensions")["f:flag"].alias("member"),
        F.col("decimals").cast("double").alias("decimals"),
    )


@query(
    "s2_mapped_facts",
    f"""WITH {XFACT} SELECT file_id, CASE concept WHEN 'Quantity' THEN 'p6.e1.energy' ELSE 'p1.price' END AS field_key, round(CASE concept WHEN 'Quantity' THEN value_num ELSE value_num END, 4) AS value_num,
      CASE concept WHEN 'Quantity' THEN 'GJ' ELSE unit END AS unit FROM xf WHERE concept IN ('Quantity', 'Price')""",
)
def _s2b(spark: SparkSession, d: str) -> DataFrame:
    fields = rule_table(
        spark, ["concept", "field_key", "unit"], [("Quantity", "p6.e1.energy", "GJ"), ("Price", "p1.price", "INR")]
    )
    rows = xbrl.mapped_facts(xbrl.parse_documents(instances(spark, d)), fields)
    return rows.select("file_id", "field_key", F.round(F.col("value_num").cast("double"), 4).alias("value_num"), "unit")


FILES = """files AS (SELECT page_id || CASE page_id % 4 WHEN 0 THEN '.xml' WHEN 1 THEN '.PDF' WHEN 2 THEN '.xbrl' ELSE '.html' END AS filename,
  CASE page_id % 4 WHEN 1 THEN CASE WHEN page_id % 3 = 0 THEN '%PDF-1.7 ' ELSE 'PDF ' END || html WHEN 2 THEN repeat(' ', CASE WHEN page_id % 8 = 2 THEN 2000 ELSE 2 END) || html ELSE html END AS content FROM pages)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("page_id")
    suffix = F.when(key % 4 == 0, ".xml").when(key % 4 == 1, ".PDF").when(key % 4 == 2, ".xbrl").otherwise(".html")
    head = F.when(key % 4 == 1, F.when(key % 3 == 0, "%PDF-1.7 ").otherwise("PDF ")).when(key % 8 == 2, " " * 2000).when(key % 4 == 2, "  ").otherwise("")
    return b.table(spark, d, "pages").select(
        F.concat(key, suffix).alias("filename"), F.encode(F.concat(head, "html"), "UTF-8").alias("content")
    )


@query(
    "s3_artifact_sniff",
    f"""WITH {FILES} SELECT filename, CASE WHEN filename LIKE '%.PDF' AND starts_with(content, '%PDF-') THEN 'pdf' WHEN (filename LIKE '%.xml' OR filename LIKE '%.xbrl') AND regexp_matches(content, '^\\s*<') THEN 'xbrl' END AS artifact_type,
      sha256(content) AS checksum, strlen(content) AS size FROM files""",
)
def _s3(spark: SparkSession, d: str) -> DataFrame:
    return g.sniff(files(spark, d)).drop("content")


@query(
    "s3_manifest_mismatches",
    f"WITH {FILES} SELECT filename FROM files WHERE strlen(content) % 6 IN (0, 1)",
)
def _s3b(spark: SparkSession, d: str) -> DataFrame:
    found = g.sniff(files(spark, d)).select("filename", "checksum", "size")
    # A manifest that misses some files and has a wrong checksum for others.
    manifest = found.where("size % 6 <> 0").withColumn(
        "checksum", F.when(F.col("size") % 6 == 1, "wrong").otherwise(F.col("checksum"))
    )
    return g.manifest_mismatches(found, manifest).select("filename")


@query(
    "s4_checksum_dedupe",
    """WITH i AS (SELECT page_id AS company_id, 2024 AS fy, sha256(html) AS checksum FROM pages), e AS (SELECT page_id AS company_id, 2024 AS fy, CASE WHEN page_id % 3 = 0 THEN sha256(html) ELSE 'old' END AS checksum, CAST(page_id % 4 + 1 AS BIGINT) AS attempts FROM pages WHERE page_id % 5 <> 0)
    SELECT i.company_id, i.fy, i.checksum, CASE WHEN e.attempts IS NULL THEN 'insert' WHEN e.checksum = i.checksum THEN 'skip' ELSE 'replace' END AS action,
      coalesce(e.attempts, 0) + CASE WHEN e.checksum = i.checksum THEN 0 ELSE 1 END AS attempts FROM i LEFT JOIN e USING (company_id, fy)""",
)
def _s4(spark: SparkSession, d: str) -> DataFrame:
    incoming, existing = ingest_sides(spark, d)
    return g.dedupe_ingest(existing, incoming)


def ingest_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("page_id")
    base = b.table(spark, d, "pages").select(
        key.alias("company_id"), F.lit(2024).alias("fy"), F.sha2("html", 256).alias("checksum")
    )
    company = F.col("company_id")
    existing = base.where(company % 5 != 0).select(
        "company_id",
        "fy",
        F.when(company % 3 == 0, F.col("checksum")).otherwise("old").alias("checksum"),
        (company % 4 + 1).alias("attempts"),
    )
    return base, existing


@query(
    "s4_filings_after_ingest",
    """SELECT page_id AS company_id, 2024 AS fy, sha256(html) AS checksum, CASE WHEN page_id % 5 = 0 THEN 1 WHEN page_id % 3 = 0 THEN page_id % 4 + 1 ELSE page_id % 4 + 2 END AS attempts FROM pages""",
)
def _s4b(spark: SparkSession, d: str) -> DataFrame:
    incoming, existing = ingest_sides(spark, d)
    return g.apply_ingest(existing, g.dedupe_ingest(existing, incoming))


DIVISIONS = ", ".join(
    f"({division}, '{sector}')"
    for sector, divisions in config.SECTOR_DIVISIONS
    for division in divisions
)


def constituents(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return b.table(spark, d, "customer").select(
        F.format_string("L%09d", key).alias("cin"),
        F.concat("c_name", F.lit(" ")).alias("name"),
        F.lower("c_name").alias("ticker"),
        F.format_string("%02d110", key % 99).alias("nic_code"),
        F.col("c_mktsegment").alias("industry"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("market_cap"),
    )


@query(
    "s5_registry_build",
    f"""WITH div(division, sector) AS (VALUES {DIVISIONS}), r AS (SELECT 'L' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS cin, c_name AS name, upper(c_name) AS ticker, c_custkey % 99 AS division, c_mktsegment AS industry,
      row_number() OVER (ORDER BY CAST(c_acctbal AS DECIMAL(18,2)) DESC, c_custkey) AS rank FROM customer)
    SELECT cin, name, ticker, coalesce(sector, '{config.SECTOR_FALLBACK}') AS sector, industry, CASE WHEN rank <= 100 THEN 'large' WHEN rank <= 250 THEN 'mid' ELSE 'small' END AS mcap_band, rank
    FROM r LEFT JOIN div USING (division) WHERE rank <= 1000""",
)
def _s5(spark: SparkSession, d: str) -> DataFrame:
    return g.build_registry(constituents(spark, d), 1000)


@query("s5_duplicate_keys", "SELECT c_nationkey * 10000 + CAST(floor(c_acctbal) AS BIGINT) AS key, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def _s5b(spark: SparkSession, d: str) -> DataFrame:
    key = (F.col("c_nationkey") * 10000 + F.floor("c_acctbal")).cast("long").alias("key")
    return g.duplicate_keys(b.table(spark, d, "customer").select(key), "key")


UNION = """a AS (SELECT c_name AS symbol, 0 AS source_no, c_custkey AS row_no FROM customer WHERE c_acctbal > 2000 UNION ALL SELECT c_name, 1, c_custkey FROM customer WHERE c_nationkey < 15 OR c_acctbal < 0),
u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY source_no, row_no) = 1),
o AS (SELECT *, row_number() OVER (ORDER BY source_no, row_no) - 1 AS ordinal FROM u)"""


def registry(spark: SparkSession, d: str) -> DataFrame:
    customers = b.table(spark, d, "customer")
    columns = [F.col("c_name").alias("symbol"), F.col("c_custkey").alias("row_no")]
    first = customers.where("c_acctbal > 2000").select(*columns)
    second = customers.where("c_nationkey < 15 OR c_acctbal < 0").select(*columns)
    return g.ordered_union([first, second], "symbol", "row_no")


@query("s6_ordered_union", f"WITH {UNION} SELECT symbol, source_no, row_no FROM u")
def _s6(spark: SparkSession, d: str) -> DataFrame:
    return registry(spark, d)


@query("s7_cohort_slice_next", f"WITH {UNION} SELECT symbol, source_no, row_no, ordinal FROM o WHERE ordinal >= 50 AND ordinal < 90")
def _s7(spark: SparkSession, d: str) -> DataFrame:
    return g.cohort_slice(g.with_ordinal(registry(spark, d)), "next", 40, next_offset=50)


@query(
    "s7_cohort_slice_refresh",
    f"WITH {UNION} SELECT symbol, source_no, row_no, ordinal FROM o WHERE symbol IN (SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000) ORDER BY ordinal LIMIT 40",
)
def _s7b(spark: SparkSession, d: str) -> DataFrame:
    orders = b.table(spark, d, "orders").where("o_totalprice > 450000")
    customers = b.table(spark, d, "customer")
    known = customers.join(orders, customers.c_custkey == orders.o_custkey, "left_semi").select(F.col("c_name").alias("symbol"))
    return g.cohort_slice(g.with_ordinal(registry(spark, d)), "refresh", 40, registered=known)


@query(
    "s8_latest_revision",
    """WITH f AS (SELECT o_orderkey AS feed_id, 'S' || o_custkey AS symbol, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INTEGER) END AS r
      FROM orders WHERE o_orderkey % 8 <> 5 AND o_orderkey % 10 <> 7)
    SELECT feed_id, symbol, fy, CAST(s AS VARCHAR) AS submission_date, CAST(r AS VARCHAR) AS revision_date FROM f QUALIFY row_number() OVER (PARTITION BY symbol, fy ORDER BY coalesce(r, s) DESC, s DESC, feed_id DESC) = 1""",
)
def _s8(spark: SparkSession, d: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = lambda column: F.date_format(column, g.FEED_DATE)
    feed = b.table(spark, d, "orders").select(
        key.alias("feed_id"),
        F.concat(F.lit("s"), "o_custkey").alias("symbol"),
        F.year("o_orderdate").alias("fy_to"),
        F.when(key % 10 == 7, " - ").otherwise(text(day)).alias("submission"),
        F.when(key % 3 == 1, text(F.date_add(day, (key % 200).cast("int")))).otherwise("-").alias("revision"),
        F.when(key % 8 != 5, F.concat(key, F.lit(".xml"))).alias("xbrl_file"),
    )
    rows = g.latest_revisions(feed)
    dates = {c: F.col(c).cast("string") for c in ("submission_date", "revision_date")}
    return rows.withColumns(dates).select("feed_id", "symbol", "fy", "submission_date", "revision_date")


@query(
    "s9_run_ledger",
    """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS run_id, CASE WHEN o_orderkey % 31 = 0 THEN 'error' WHEN o_orderstatus = 'F' THEN 'parsed' WHEN o_orderstatus = 'O' THEN 'fetched' ELSE 'missing' END AS outcome FROM orders)
    SELECT CAST(run_id AS VARCHAR) AS run_id, count(*) AS discovered, count(*) FILTER (WHERE outcome IN ('fetched', 'parsed')) AS fetched, count(*) FILTER (WHERE outcome = 'parsed') AS parsed,
      count(*) FILTER (WHERE outcome = 'missing') AS missing, count(*) FILTER (WHERE outcome = 'error') AS errors, CASE WHEN count(*) FILTER (WHERE outcome = 'error') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM o GROUP BY 1""",
)
def _s9(spark: SparkSession, d: str) -> DataFrame:
    outcome = (
        F.when(F.col("o_orderkey") % 31 == 0, "error")
        .when(F.col("o_orderstatus") == "F", "parsed")
        .when(F.col("o_orderstatus") == "O", "fetched")
        .otherwise("missing")
    )
    run = F.col("o_orderdate").cast("date").cast("string")
    return g.run_ledger(b.table(spark, d, "orders").select(run.alias("run_id"), outcome.alias("outcome")))


LINKED = """html || '<p><a class="doc" href="/files/annual-' || (2018 + page_id % 7) || '.pdf">Annual <b>report</b></a> <a href=''/brsr/' || (2020 + page_id % 3) || '''>BRSR filing</a></p>'"""


@query(
    "s10_link_discovery",
    f"""WITH p AS (SELECT page_id, url, {LINKED} AS html FROM pages), l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]+)["'']?[^>]*>(.*?)</a>', 1)) AS href,
      unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]+)["'']?[^>]*>(.*?)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]+)["'']?[^>]*>(.*?)</a>', 1), 1) AS pos FROM p)
    SELECT page_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href ELSE href END AS href, regexp_replace(label, '<[^>]*>', '', 'g') AS label FROM l WHERE (contains(lower(href || ' ' || regexp_replace(label, '<[^>]*>', '', 'g')), 'annual') OR contains(lower(href || ' ' || regexp_replace(label, '<[^>]*>', '', 'g')), 'brsr'))
      AND (contains(href || ' ' || regexp_replace(label, '<[^>]*>', '', 'g'), '2022') OR contains(href || ' ' || regexp_replace(label, '<[^>]*>', '', 'g'), '2021'))
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1""",
)
def _s10(spark: SparkSession, d: str) -> DataFrame:
    extra = F.concat(
        "html",
        F.lit('<p><a class="doc" href="/files/annual-'),
        (F.col("page_id") % 7 + 2018),
        F.lit(".pdf\">Annual <b>report</b></a> <a href='/brsr/"),
        (F.col("page_id") % 3 + 2020),
        F.lit("'>BRSR filing</a></p>"),
    )
    pages = b.table(spark, d, "pages").select("page_id", "url", extra.alias("html"))
    return g.find_report_link(pages, ["annual", "brsr"], F.lit(2022)).drop("html", "url")


DATASET = f"""WITH {COMPANIES}, {SCORES} SELECT sector, fy AS financial_year, score_key AS measure, count(*) AS company_count, round(CAST(sum(value) AS DOUBLE) / count(*), 4) AS average_value
  FROM scores JOIN companies USING (company_id) WHERE method_version = (SELECT max(method_version) FROM scores) GROUP BY 1, 2, 3 HAVING count(*) >= 5"""


def dataset(spark: SparkSession, d: str) -> DataFrame:
    rows = r.aggregate_dataset(b.scores(spark, d), b.companies(spark, d), config.SCORE_MEASURES)
    return rows.withColumnRenamed("fy", "financial_year")


@query("s11_dataset_csv", DATASET)
def _s11(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "dataset-csv")
    sinks.write_dataset(dataset(spark, d), path, "csv")
    schema = "sector string, financial_year int, measure string, company_count long, average_value double"
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


@query("s11_dataset_parquet", DATASET)
def _s11b(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "dataset-parquet")
    sinks.write_dataset(dataset(spark, d), path, "parquet")
    return spark.read.parquet(path).withColumn("average_value", F.col("average_value").cast("double"))


@query(
    "s12_table_twin",
    f"""WITH {COMPANIES}, {FACTS} SELECT industry AS "Industry", round(CAST(avg(value) AS DOUBLE), 6) AS revenue, count(*) AS cohort_n, CASE WHEN count(*) < 5 THEN 'true' ELSE 'false' END AS below_minimum_cohort
    FROM facts JOIN companies USING (company_id) WHERE metric_key = 'revenue' AND fy = 1997 GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 250""",
)
def _s12(spark: SparkSession, d: str) -> DataFrame:
    spec = {"measures": ["revenue"], "dimensions": ["industry"], "shape": "distribution", "limit": 250,
            "filters": [{"dimension": "fy", "operator": "eq", "value": 1997}]}
    result = semantic.semantic_query(
        b.long_metrics(spark, d), b.scores(spark, d), b.companies(spark, d), spec, "research", CATALOG
    )
    assert result.data is not None
    rows = result.data.withColumn("value", F.round("value", 6)).withColumn("label", F.col("industry"))
    path = shared_dir(spark, "table-twin")
    sinks.write_csv(sinks.table_twin(rows, "Industry", "revenue"), path)
    schema = "Industry string, revenue double, cohort_n long, below_minimum_cohort string"
    return spark.read.schema(schema).option("header", True).csv(path)


@query("s13_monthly_event_partitions", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _s13(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "events")
    sinks.write_events_by_month(b.events(spark, d), path)
    rows = spark.read.option("partitionColumnTypeInferenceEnabled", False).schema("event_id long, month string").parquet(path)
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))


@query(
    "s14_dimension_backfill",
    """WITH f AS (SELECT o_custkey, o_orderkey, repeat('X', CAST(o_orderkey % 30 AS INTEGER)) || o_orderkey AS v FROM orders WHERE o_orderstatus = 'F'),
    g AS (SELECT o_custkey, arg_min(v, o_orderkey) AS found FROM f WHERE length(v) <= 21 GROUP BY 1) SELECT c_custkey AS company_id, coalesce(found, 'UNKNOWN') AS cin FROM customer LEFT JOIN g ON o_custkey = c_custkey""",
)
def _s14(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    facts = b.table(spark, d, "orders").select(
        F.col("o_custkey").alias("company_id"),
        F.when(F.col("o_orderstatus") == "F", "Identity").otherwise("Other").alias("concept"),
        F.concat(F.repeat(F.lit("X"), (key % 30).cast("int")), key).alias("value_raw"),
        key.alias("ordinal"),
    )
    companies = b.table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.lit("UNKNOWN").alias("cin"))
    return g.backfill_dimension(companies, facts, "Identity")
