"""Operator inputs derived from the test tables (suppliers as companies, ship years as fiscal years)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.exprs import money, stable_key
from tidemark.session import shared_place

METRIC_KEYS = ("qty", "revenue", "discount", "tax", "rev_a", "rev_n", "rev_r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table below which dealing it anew costs next to nothing.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """At least as many tasks as the session has cores, for inputs of operators that work long on each row.

    A small table is dealt anew whatever its scan says: a file of one row group is one task, into however many
    ranges it is cut. A large one only if its scan has fewer partitions than there are cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL_BYTES or df.rdd.getNumPartitions() < cores else df


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    band = (
        F.when(F.col("s_acctbal") >= 7000, "large").when(F.col("s_acctbal") >= 3000, "mid").otherwise("small")
    )
    return (
        supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
        .select(
            F.col("s_suppkey").alias("company_id"),
            F.col("s_name").alias("company"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            band.alias("mcap_band"),
        )
    )


def wide_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (company, fy) with the reported amounts; flags without lines stay null."""
    li = table(spark, sf_dir, "lineitem")
    price = money("l_extendedprice")
    flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, price))
    amount = lambda c: c.cast("decimal(24,6)")
    wide = li.groupBy(F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("fy")).agg(
        F.sum(money("l_quantity")).alias("qty"),
        F.sum(price).alias("revenue"),
        F.sum(money("l_discount")).alias("discount"),
        F.sum(money("l_tax")).alias("tax"),
        flag("A").alias("rev_a"),
        flag("N").alias("rev_n"),
        flag("R").alias("rev_r"),
    )
    return wide.select(
        "company_id",
        "fy",
        *[amount(F.col(key)).alias(key) for key in METRIC_KEYS],
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric facts (company_id, fy, metric_key, value, pin_id)."""
    wide = wide_facts(spark, sf_dir)
    pairs = ", ".join(f"'{key}', {key}" for key in METRIC_KEYS)
    long = wide.select("company_id", "fy", F.expr(f"stack({len(METRIC_KEYS)}, {pairs}) as (metric_key, value)"))
    return long.where(F.col("value").isNotNull()).withColumn(
        "pin_id", stable_key("pin", "company_id", "fy", "metric_key")
    )


def candidates(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Metric facts with the company's sector; ``broken`` plants scale and sign mistakes."""
    sectors = companies(spark, sf_dir).select("company_id", "sector")
    rows = facts(spark, sf_dir).join(sectors, "company_id")
    if broken:
        value = (
            F.when((F.col("metric_key") == "revenue") & (F.col("company_id") % 7 == 3), F.col("value") * 10)
            .when((F.col("metric_key") == "discount") & (F.col("company_id") % 11 == 5), -F.col("value"))
            .otherwise(F.col("value"))
        )
        rows = rows.withColumn("value", value.cast("decimal(24,6)"))
    return rows


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores per (company, fy) under two method versions."""
    li = table(spark, sf_dir, "lineitem")
    hits = lambda c, v: F.count_if(F.col(c) == v)
    n = li.groupBy(F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("fy")).agg(
        F.count(F.lit(1)).alias("n"),
        hits("l_linestatus", "F").alias("f"),
        hits("l_returnflag", "A").alias("a"),
        hits("l_returnflag", "R").alias("r"),
    )
    share: dict[tuple[str, str], tuple[Column, Column]] = {
        ("completeness", "v1"): (F.col("f"), F.col("n")),
        ("completeness", "v2"): (F.col("f") * 2 + F.col("a"), F.col("n") * 3),
        ("substance", "v1"): (F.col("a"), F.col("n")),
        ("substance", "v2"): (F.col("a") + F.col("r"), F.col("n") * 2),
        ("assurance_readiness", "v1"): (F.col("r"), F.col("n")),
        ("assurance_readiness", "v2"): (F.col("r") * 3 + F.col("f"), F.col("n") * 4),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(key).alias("score_key"),
                F.lit(version).alias("method_version"),
                F.bround(F.lit(100.0) * top / bottom, 4).cast("decimal(10,4)").alias("value"),
            )
            for (key, version), (top, bottom) in share.items()
        ]
    )
    return n.select("company_id", "fy", F.inline(rows)).withColumn(
        "pin_id", stable_key("pin", "company_id", "fy", "score_key")
    )


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialised metrics in the shape the governed query reads."""
    return facts(spark, sf_dir).select("company_id", "fy", "metric_key", "value", "pin_id")


def governed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and newest scores with company dimensions, built once for each state of the tables they come from."""
    from tidemark.plans import store

    inputs = [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "supplier", "nation", "region")]
    key = store.fingerprint(spark, inputs, {"metrics": METRIC_KEYS, "scoring": config.SCORING})
    return store.FactStore(spark, shared_place(spark, "governed")).ensure(
        key,
        lambda: store.dimensioned_facts(long_metrics(spark, sf_dir), scores(spark, sf_dir), companies(spark, sf_dir)),
    )


# fixed values: order priorities stand for the fields of a filing
FIELD_OF_PRIORITY = {
    "1-URGENT": "p1.e1.urgent",
    "2-HIGH": "p1.e2.high",
    "3-MEDIUM": "p2.e1.medium",
    "4-NOT SPECIFIED": "p2.e2.not_specified",
    "5-LOW": "a.basics.low",
}


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filing per customer and year: the newest order."""
    from tidemark.operators.ranking import first_per_key

    orders = table(spark, sf_dir, "orders").withColumn("fy", F.year("o_orderdate"))
    newest = first_per_key(orders, ["o_custkey", "fy"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    status = (
        F.when(F.col("o_orderstatus") == "F", "fetched")
        .when(F.col("o_orderstatus") == "O", "parsed")
        .otherwise("missing")
    )
    return newest.select(
        F.col("o_orderkey").alias("filing_id"),
        F.col("o_custkey").alias("company_id"),
        "fy",
        status.alias("status"),
        F.col("o_orderdate").alias("submitted"),
    )


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registered companies."""
    band = (
        F.when(F.col("c_acctbal") >= 7000, "large").when(F.col("c_acctbal") >= 3000, "mid").otherwise("small")
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"),
        F.col("c_name").alias("company"),
        F.col("c_mktsegment").alias("sector"),
        band.alias("mcap_band"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only extracted-field versions: orders as versions of (customer, priority)."""
    field = F.create_map(*[F.lit(x) for pair in FIELD_OF_PRIORITY.items() for x in pair])
    status = (
        F.when(F.col("o_orderstatus") == "F", "sampled_ok")
        .when(F.col("o_orderstatus") == "P", "corrected")
        .otherwise("unreviewed")
    )
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("field_id"),
        F.col("o_custkey").alias("filing_id"),
        field[F.col("o_orderpriority")].alias("field_key"),
        (key + 1).alias("version"),
        status.alias("qa_status"),
        (((key * 37) % 101) / 100).cast("decimal(5,4)").alias("confidence"),
        F.when(key % 3 == 0, "xbrl").otherwise("llm").alias("method"),
        F.when(key % 10 != 0, (key % 50 + 1).cast("int")).alias("source_page"),
        money("o_totalprice").alias("value_num"),
        F.col("o_orderdate").alias("created_at"),
    )


AS_OF = "2024-01-31"
WINDOW_DAYS = 14


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(raw: DataFrame) -> DataFrame:
    """Events with some users nulled: every fifth is anonymous, every 25th has no id at all."""
    key = F.col("event_id")
    return raw.select(
        "event_id",
        "ts",
        F.col("event_type").alias("name"),
        F.when(key % 5 != 0, F.col("user_id")).alias("user_id"),
        F.when(key % 25 != 0, F.concat(F.lit("anon-"), F.col("user_id") % 40)).alias("anon_id"),
        "props",
        "value",
    )


# fixed values: closing sentences that give the invented prose something to find
CLOSINGS = (
    " We target a 20% cut by FY 2030 under ISO 14001.",
    " The policy and code of conduct help to reduce 15 kl of water.",
    " Training and safety of every employee and worker before 2027.",
    " Electricity in kWh and gigajoule follows the GHG Protocol methodology.",
    " Environment and ESG report, CSR and BRSR filing until FY2026.",
    "",
)


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a closing sentence by number: doc_id, company (source), text."""
    closing = F.element_at(F.array(*[F.lit(c) for c in CLOSINGS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("source").alias("company"), F.concat("text", closing).alias("text"), "lang", "n_chars"
    )


# fixed values: fields of the form that documents fill in turn (key, dtype, core), and two that none fills
FORM_FIELDS = (
    ("a.basics.name", "text", False),
    ("p1.policy.text", "text", True),
    ("p1.training.note", "text", False),
    ("p3.safety.note", "text", True),
    ("p6.e1.energy", "number", True),
    ("p6.e1.note", "text", False),
    ("p6.assurance.status", "text", True),
    ("p6.e2.water", "number", False),
    ("p8.csr.note", "text", False),
    ("p9.consumer.note", "text", False),
    ("p5.assured.flag", "boolean", False),
    ("p2.design.note", "text", False),
    ("p4.never.filled", "text", True),
    ("p7.never.filled", "number", False),
)


def form_fields(spark: SparkSession) -> DataFrame:
    from tidemark.functions.exprs import rule_table

    return rule_table(spark, ["field_key", "dtype", "core"], FORM_FIELDS)


def pinned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published fields of one filing per (source, language), filled from the documents."""
    keys = F.array(*[F.lit(key) for key, _, _ in FORM_FIELDS[:12]])
    doc = F.col("doc_id")
    key = F.element_at(keys, (F.floor(doc / 20) % 12 + 1).cast("int"))
    status = F.element_at(
        F.array(F.lit("nil"), F.lit("No"), F.lit("Reasonable assurance")), (F.col("n_chars") % 3 + 1).cast("int")
    )
    value = (
        F.when(key.isin("p6.e1.energy", "p6.e2.water"), F.col("n_chars").cast("string"))
        .when(key == "p5.assured.flag", F.when(doc % 4 == 0, "true").otherwise("false"))
        .when(key == "p6.assurance.status", status)
        .otherwise(F.col("text"))
    )
    year = F.when(F.col("lang") == "en", 2025).when(F.col("lang") == "fr", 2024).when(F.col("lang") == "es", 2023)
    return narratives(spark, sf_dir).select(
        F.concat("company", F.lit("/"), "lang").alias("filing_id"),
        F.col("company").alias("company_id"),
        year.otherwise(2022).alias("fy"),
        key.alias("field_key"),
        value.alias("value_raw"),
        F.when(doc % 3 == 0, "xbrl").otherwise("llm").alias("method"),
        F.when(doc % 7 != 0, (doc % 50).cast("int")).alias("source_page"),
        (doc % 5 != 0).alias("has_span"),
        stable_key("pin", "doc_id").alias("pin_id"),
    )
