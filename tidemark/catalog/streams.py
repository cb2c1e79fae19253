"""Streaming: R1-R6. Each runs its stream over the events table and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.bindings import AS_OF, WINDOW_DAYS
from tidemark.catalog import query
from tidemark.catalog import events as batch
from tidemark.operators import events as e
from tidemark.session import shared_dir
from tidemark.streaming import events as stream
from tidemark.streaming import runner


def raw_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = b.table(spark, d, "events").schema
    raw = runner.file_stream(spark, f"{d}/events.parquet", schema)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return b.shape_events(raw_stream(spark, d))


@query(
    "r1_stream_intake",
    """SELECT event_id, 'accepted' AS outcome FROM events WHERE event_type <> 'error' AND (event_id % 5 = 0 OR user_id % 13 <> 4)
    UNION ALL SELECT event_id, 'quarantined' FROM events WHERE event_type = 'error' AND (event_id % 5 = 0 OR user_id % 13 <> 4)""",
)
def _r1(spark: SparkSession, d: str) -> DataFrame:
    events = event_stream(spark, d)
    # Every event arrives twice; the copy must not get through.
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    folder = shared_dir(spark, "intake")
    stream.run_intake(twice, batch.REGISTERED, batch.opted_out(spark, d), folder)
    read = lambda name, label: spark.read.schema("event_id long").parquet(f"{folder}/{name}").select(
        "event_id", F.lit(label).alias("outcome")
    )
    return read("accepted", "accepted").unionByName(read("quarantine", "quarantined"))


@query(
    "r2_stream_quota_counters",
    f"""WITH {batch.USES} SELECT quota, identity, period, CAST(sum(amount) AS BIGINT) AS used FROM
      (SELECT quota, identity, amount, CASE quota WHEN 'nlq_per_day' THEN strftime(ts, '%Y-%m-%d 00:00') WHEN 'api_queries_per_minute' THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE strftime(ts, '%Y-%m-01 00:00') END AS period FROM uses) u GROUP BY ALL""",
)
def _r2(spark: SparkSession, d: str) -> DataFrame:
    uses = batch.shape_uses(raw_stream(spark, d))
    keys = ["quota", "tier", "identity", "period_start"]
    spans = {"%per_minute": "1 minute", "%per_day": "1 day", "%per_month": "1 day"}
    out = None
    for quota, span in spans.items():
        counters = stream.quota_counters(uses.where(F.col("quota").like(quota)), span)
        rows = runner.last_update(runner.collected(counters, "quota", "update"), *keys)
        rows = stream.monthly(rows) if quota == "%per_month" else rows
        out = rows if out is None else out.unionByName(rows)
    return out.select("quota", "identity", F.date_format("period_start", "yyyy-MM-dd HH:mm").alias("period"), "used")


@query("r3_stream_rate_limit", batch.LIMITED)
def _r3(spark: SparkSession, d: str) -> DataFrame:
    hits = event_stream(spark, d).withColumn("identity", e.identity())
    return runner.collected(stream.rate_limiter(hits, 2, 6 * 3600), "rate-limit").drop("batch")


@query(
    "r4_stream_daily_rollup",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS name, count(*) AS event_count FROM events
    WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
)
def _r4(spark: SparkSession, d: str) -> DataFrame:
    rows = runner.collected(stream.daily_rollup(event_stream(spark, d)), "daily").drop("batch")
    return rows.withColumn("day", F.col("day").cast("string"))


@query("r5_stream_lead_scores", f"WITH {batch.SIGNALS} SELECT * FROM leads")
def _r5(spark: SparkSession, d: str) -> DataFrame:
    return stream.run_lead_scores(event_stream(spark, d), None, batch.RULES, AS_OF, WINDOW_DAYS, shared_dir(spark, "leads"))


@query("r6_stream_funnel_progress", f"SELECT stage, users FROM ({batch.FUNNEL}) f")
def _r6(spark: SparkSession, d: str) -> DataFrame:
    progress = stream.funnel_progress(event_stream(spark, d), batch.STEPS)
    rows = runner.collected(progress, "funnel")
    return rows.groupBy("stage").agg(F.count_distinct("identity").alias("users"))
