"""Company registries, filing feeds, artifacts and run ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.exprs import rule_table
from tidemark.operators.ranking import first_per_key
from tidemark.operators.relational import upsert

BOM = "\ufeff"
FEED_DATE = "dd-MMM-yyyy"  # fixed value: date format of the filings feed


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a registry CSV: name, industry, symbol, isin.

    A byte order mark before the header and blanks around values are dropped; rows need a symbol
    and an ISIN; the symbol stands in for a missing name.
    """
    raw = spark.read.option("header", True).csv(path)
    rows = raw.toDF(*[name.replace(BOM, "").strip() for name in raw.columns])
    cell = lambda name: F.nullif(F.trim(F.col(name)), F.lit(""))
    return rows.select(
        F.coalesce(cell("Company Name"), cell("Symbol")).alias("name"),
        F.coalesce(cell("Industry"), F.lit("Unclassified")).alias("industry"),
        cell("Symbol").alias("symbol"),
        cell("ISIN Code").alias("isin"),
    ).where(F.col("symbol").isNotNull() & F.col("isin").isNotNull())


def sector_table(spark: SparkSession) -> DataFrame:
    rows = [(division, sector) for sector, divisions in config.SECTOR_DIVISIONS for division in divisions]
    return rule_table(spark, ["division", "sector"], rows)


def build_registry(constituents: DataFrame, limit: int = 1000) -> DataFrame:
    """The largest companies with rank, size band and sector.

    ``constituents``: cin, name, ticker, nic_code, industry, market_cap. The limit comes before
    the ranking, so the one-partition rank window sees at most ``limit`` rows.
    """
    largest = constituents.orderBy(F.desc("market_cap"), F.asc("cin")).limit(limit)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("market_cap"), F.asc("cin")))
    ranked = largest.withColumn("rank", rank).withColumn(
        "division", F.substring(F.trim("nic_code"), 1, 2).try_cast("int")
    )
    band = F.when(F.col("rank") <= 100, "large").when(F.col("rank") <= 250, "mid").otherwise("small")
    return ranked.join(F.broadcast(sector_table(constituents.sparkSession)), "division", "left").select(
        F.trim("cin").alias("cin"),
        F.trim("name").alias("name"),
        F.upper(F.trim("ticker")).alias("ticker"),
        F.coalesce("sector", F.lit(config.SECTOR_FALLBACK)).alias("sector"),
        F.trim("industry").alias("industry"),
        band.alias("mcap_band"),
        "rank",
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; a registry with any must not be used."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def ordered_union(lists: Sequence[DataFrame], key: str, position: str) -> DataFrame:
    """Lists one after the other; a key keeps its first slot. Ordered by (source_no, position)."""
    out = None
    for number, df in enumerate(lists):
        part = df.withColumn("source_no", F.lit(number))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return first_per_key(out, [key], F.asc("source_no"), F.asc(position))


POSITION_BLOCK = 65_536


def with_ordinal(registry: DataFrame) -> DataFrame:
    """Zero-based place of each row in registry order (source_no, row_no).

    Places are counted within blocks of positions and the blocks are counted up, so that no task
    sees the whole list.
    """
    blocked = registry.withColumn("__block", F.floor(F.col("row_no") / POSITION_BLOCK))
    inside = W.partitionBy("source_no", "__block").orderBy("row_no")
    sizes = blocked.groupBy("source_no", "__block").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(F.lit(0)).orderBy("source_no", "__block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return (
        blocked.withColumn("__place", F.row_number().over(inside) - 1)
        .join(starts, ["source_no", "__block"])
        .withColumn("ordinal", F.col("__start") + F.col("__place"))
        .drop("__block", "__place", "__start")
    )


def cohort_slice(
    registry: DataFrame,
    mode: str,
    limit: int,
    next_offset: int = 0,
    registered: DataFrame | None = None,
    start: int | None = None,
) -> DataFrame:
    """Rows for one ingestion batch, by the explicit ``ordinal`` column.

    ``initial`` starts at 0, ``next`` at the stored offset, an explicit ``start`` overrides both;
    ``refresh`` takes the first registered symbols.
    """
    if mode == "refresh":
        assert registered is not None
        known = registry.join(registered.select("symbol").distinct(), "symbol", "left_semi")
        return known.orderBy("ordinal").limit(limit)
    offset = start if start is not None else (next_offset if mode == "next" else 0)
    return registry.where((F.col("ordinal") >= offset) & (F.col("ordinal") < offset + limit))


def feed_date(text: Column) -> Column:
    """Date of a feed cell; '-' and blanks are null."""
    return F.to_date(F.try_to_timestamp(F.nullif(F.trim(text), F.lit("-")), F.lit(FEED_DATE)))


def latest_revisions(feed: DataFrame) -> DataFrame:
    """One filing per (symbol, fy): the newest by revision, else submission date.

    ``feed``: feed_id, symbol, fy_to, submission, revision, xbrl_file as text. Entries without a
    file or a submission date do not count.
    """
    rows = feed.select(
        "feed_id",
        F.upper("symbol").alias("symbol"),
        F.col("fy_to").alias("fy"),
        "xbrl_file",
        feed_date(F.col("submission")).alias("submission_date"),
        feed_date(F.col("revision")).alias("revision_date"),
    ).where((F.coalesce("xbrl_file", F.lit("")) != "") & F.col("submission_date").isNotNull())
    effective = F.coalesce("revision_date", "submission_date")
    return first_per_key(rows, ["symbol", "fy"], F.desc(effective), F.desc("submission_date"), F.desc("feed_id"))


def run_ledger(outcomes: DataFrame) -> DataFrame:
    """Counts per ingestion run. ``outcomes``: run_id, outcome in parsed, fetched, missing, error.

    A parsed filing was fetched before.
    """
    kind = F.col("outcome")
    return (
        outcomes.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("discovered"),
            F.count_if(kind.isin("fetched", "parsed")).alias("fetched"),
            F.count_if(kind == "parsed").alias("parsed"),
            F.count_if(kind == "missing").alias("missing"),
            F.count_if(kind == "error").alias("errors"),
        )
        .withColumn("status", F.when(F.col("errors") > 0, "completed_with_errors").otherwise("completed"))
    )


def backfill_dimension(companies: DataFrame, facts: DataFrame, concept: str, max_length: int = 21) -> DataFrame:
    """Company ids replaced by the first identity fact of a valid length, where there is one.

    ``facts``: company_id, concept, value_raw, ordinal.
    """
    valid = (F.col("concept") == concept) & (F.length("value_raw") <= max_length)
    first = facts.where(valid).groupBy("company_id").agg(F.min_by("value_raw", F.struct("ordinal", "value_raw")).alias("found"))
    return companies.join(first, "company_id", "left").withColumn("cin", F.coalesce("found", "cin")).drop("found")


# ---- artifacts -----------------------------------------------------------------------------


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder as (filename, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def sniff(files: DataFrame) -> DataFrame:
    """Type by file name and first bytes, with checksum and size; null type when they disagree."""
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
    # Any amount of white space may come before the first tag.
    body = F.decode("content", "ISO-8859-1")
    kind = F.when((suffix == ".pdf") & body.startswith("%PDF-"), "pdf").when(
        suffix.isin(".xml", ".xbrl") & F.regexp_like(body, F.lit(r"^[ \t\n\r\f\x0B]*+<")), "xbrl"
    )
    return files.withColumns(
        {"artifact_type": kind, "checksum": F.sha2("content", 256), "size": F.length("content").cast("long")}
    )


def manifest_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest does not list with the same checksum and size."""
    return files.join(manifest.select("filename", "checksum", "size"), ["filename", "checksum", "size"], "left_anti")


def dedupe_ingest(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Action per incoming filing: skip the same checksum, replace a changed one, insert a new one.

    Both sides: company_id, fy (one row each), checksum; ``existing`` also has attempts.
    """
    old = existing.select("company_id", "fy", F.col("checksum").alias("old_checksum"), F.col("attempts").alias("old_attempts"))
    same = F.col("checksum").eqNullSafe(F.col("old_checksum"))
    action = F.when(F.col("old_attempts").isNull(), "insert").when(same, "skip").otherwise("replace")
    attempts = F.coalesce("old_attempts", F.lit(0)) + F.when(action == "skip", 0).otherwise(1)
    return (
        incoming.join(old, ["company_id", "fy"], "left")
        .withColumns({"action": action, "attempts": attempts})
        .drop("old_checksum", "old_attempts")
    )


def apply_ingest(existing: DataFrame, decided: DataFrame) -> DataFrame:
    """The filings table after an ingest: skipped filings stay as they are."""
    changed = decided.where(F.col("action") != "skip").select(*existing.columns)
    return upsert(existing, changed, ["company_id", "fy"])


# ---- links ---------------------------------------------------------------------------------

ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)[\"']?[^>]*>(.*?)</a>"


def page_links(html: Column) -> Column:
    """Anchors of a page in order, as (href, label); tags inside the label are dropped."""
    hrefs = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    labels = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    clean = lambda text: F.regexp_replace(text, "<[^>]*>", "")
    return F.zip_with(hrefs, labels, lambda h, l: F.struct(h.alias("href"), clean(l).alias("label")))


def resolved(base: Column, href: Column) -> Column:
    """The address that a link on the page ``base`` leads to."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    path = F.substring(page, F.length(origin) + 1, F.length(page))
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    relative = F.concat(F.when(folder == "", "/").otherwise(folder), F.regexp_replace(href, r"^(\./)+", ""))
    for _ in range(8):  # one folder up each time
        relative = F.regexp_replace(relative, r"^(.*?)/(?!\.\./)[^/]+/\.\./", "$1/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (F.coalesce(origin, F.lit("")) == ""), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^/]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(origin, relative))
    )


def find_report_link(pages: DataFrame, terms: Sequence[str], fy: Column) -> DataFrame:
    """First link per page whose address or label has a term and names the year or the year before.

    With a column ``url`` the address is that which the link leads to from there. Worked out inside
    the row, so nothing is shuffled.
    """
    links = pages.withColumn("__links", page_links(F.col("html"))).withColumn("__fy", fy)

    def wanted(link: Column) -> Column:
        text = F.concat_ws(" ", link["href"], link["label"])
        lowered = F.lower(text)
        term = F.lit(False)
        for word in terms:
            term = term | lowered.contains(word.lower())
        year = text.contains(F.col("__fy").cast("string")) | text.contains((F.col("__fy") - 1).cast("string"))
        return term & year

    chosen = F.try_element_at(F.filter("__links", wanted), F.lit(1))
    href = F.col("__chosen.href")
    target = resolved(F.col("url"), href) if "url" in pages.columns else href
    return (
        links.withColumn("__chosen", chosen)
        .where(F.col("__chosen").isNotNull())
        .select(*pages.columns, target.alias("href"), F.col("__chosen.label").alias("label"))
    )
