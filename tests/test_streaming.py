import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as e
from tidemark.streaming import events as s
from tidemark.streaming import runner

EV = "event_id int, ts timestamp, name string, user_id string, anon_id string, props string"
STEPS = [("View", ["view"]), ("Click", ["click"]), ("Buy", ["buy"])]


@pytest.fixture(scope="module")
def feed(frame, tmp_path_factory):
    """Events in time order, in five files, read two files per micro-batch."""
    rng = random.Random(2)
    at, rows = datetime(2024, 1, 1), []
    for i in range(250):
        at += timedelta(seconds=rng.randrange(0, 2500))
        rows.append((i, at, rng.choice(["view", "click", "buy", "odd"]), rng.choice([None, "u", "v", "w"]), None, "{}"))
    folder = tmp_path_factory.mktemp("feed")
    for part in range(5):
        df = frame(rows[part * 50 : part * 50 + 50], EV)
        df.coalesce(1).write.mode("append").parquet(str(folder))
        import time

        time.sleep(1.1)  # the file source reads files in the order of their times
    table = frame(rows, EV)
    return table, runner.file_stream(table.sparkSession, str(folder), table.schema, files_per_batch=2)


def test_rate_limit_equals_batch(feed):
    table, stream = feed
    with_id = lambda df: df.withColumn("identity", e.identity())
    streamed = runner.collected(s.rate_limiter(with_id(stream), 3, 3600), "t-limit")
    assert streamed.select("batch").distinct().count() >= 3
    batch = e.rate_limit(with_id(table), 3, 3600)
    key = lambda df: sorted((r.event_id, r.place, r.rejected) for r in df.collect())
    assert key(streamed) == key(batch)


def test_funnel_equals_batch(feed):
    table, stream = feed
    rows = runner.collected(s.funnel_progress(stream, STEPS), "t-funnel")
    got = {r.stage: r.n for r in rows.groupBy("stage").agg(F.count_distinct("identity").alias("n")).collect()}
    want = {r.stage: r.users for r in e.funnel(table, STEPS).collect()}
    assert got == want


def test_a_busy_identity_comes_in_chunks(spark, tmp_path):
    """40,000 hits of one identity in one file, not in time order: placed in time order, from many chunks."""
    shuffled = F.xxhash64("id")
    ts = F.timestamp_micros(F.col("id") * 7_000_000 + 1_700_000_000_000_000)
    table = spark.range(40_000).select(
        F.col("id").cast("int").alias("event_id"), ts.alias("ts"), F.when(F.col("id") % 5000 < 10, "view").otherwise("click").alias("name"),
        F.lit("bot").alias("user_id"), F.lit(None).cast("string").alias("anon_id"), F.lit("{}").alias("props"),
    )
    table.orderBy(shuffled).coalesce(1).write.parquet(str(tmp_path / "hits"))
    stream = runner.file_stream(spark, str(tmp_path / "hits"), table.schema).withColumn("identity", e.identity())
    got = runner.collected(s.rate_limiter(stream, 3, 60, "30 days"), "t-busy").select("event_id", "place").collect()
    want = e.rate_limit(table.withColumn("identity", e.identity()), 3, 60).select("event_id", "place").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    reached = runner.collected(s.funnel_progress(stream, [("V", ["view"]), ("C", ["click"]), ("V2", ["view"])], delay="30 days"), "t-steps").collect()
    assert sorted((r.stage, r.event_id) for r in reached) == [(0, 0), (1, 10), (2, 5000)]


def test_state_goes_when_the_watermark_passes(spark):
    """Timers: a renewed value outlives its earlier timer, and a passed moment keeps nothing."""
    from types import SimpleNamespace

    box, timers = {}, []
    kept = SimpleNamespace(exists=lambda: "v" in box, get=lambda: box["v"], update=lambda v: box.update(v=v), clear=lambda: box.pop("v"))
    keeper = s._limiter(60_000_000, 3, s.SLOT)
    keeper.init(SimpleNamespace(getValueState=lambda *_: kept, getMapState=lambda *_: None, registerTimer=timers.append))
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 1_000)
    fired = lambda at: list(keeper.handleExpiredTimer(("a",), now, SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    keeper.hold((1, 1), 5_000, now)
    keeper.hold((2, 1), 9_000, now)
    assert timers == [5_000, 9_000] and fired(5_000) == [] and box["v"] == (2, 1, 9_000)
    assert fired(9_000) == [] and not box
    keeper.hold((3, 1), 4_000, now)
    keeper.hold((3, 1), 900, now)
    assert not box


def test_daily_counts_equal_closed_days(feed):
    table, stream = feed
    got = {(str(r.day), r.name): r.event_count for r in runner.collected(s.daily_rollup(stream), "t-daily").collect()}
    end = table.agg(F.max("ts")).first()[0] - timedelta(hours=1)
    closed = table.where(F.col("ts") < F.lit(datetime(end.year, end.month, end.day)))
    want = {(str(r.day), r.name): r["count"] for r in closed.groupBy(F.to_date("ts").alias("day"), "name").count().collect()}
    assert got == want and want


def test_intake_drops_repeats_and_sets_unknown_names_aside(feed, spark, tmp_path):
    table, stream = feed
    twice = stream.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("c")
    gone = table.where("user_id = 'w'").select("user_id")
    s.run_intake(twice, ["view", "click", "buy"], gone, str(tmp_path))
    accepted = spark.read.parquet(f"{tmp_path}/accepted")
    kept = table.where("user_id IS NULL OR user_id <> 'w'")
    assert sorted(r.event_id for r in accepted.collect()) == sorted(r.event_id for r in kept.where("name <> 'odd'").collect())
    assert spark.read.parquet(f"{tmp_path}/quarantine").count() == kept.where("name = 'odd'").count()


def test_lead_scores_equal_batch(feed, tmp_path):
    table, stream = feed
    rules = [e.SignalRule("view", 10, "V", max_occurrences=3), e.SignalRule("buy", 50, "B", instant=True)]
    as_of = "2024-01-06"
    got = s.run_lead_scores(stream, None, rules, as_of, 3, str(tmp_path))
    want = e.lead_scores(table, rules, as_of, 3).select("user_id", "score", "instant")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quota_counters_equal_batch(feed):
    table, stream = feed
    shape = lambda df: df.where("user_id IS NOT NULL").select(
        "ts", F.lit("q").alias("quota"), F.lit("t").alias("tier"), F.col("user_id").alias("identity"), F.lit(1).alias("amount")
    )
    rows = runner.last_update(runner.collected(s.quota_counters(shape(stream), "1 day"), "t-quota", "update"), "identity", "period_start")
    got = {(r.identity, r.period_start): r.used for r in rows.collect()}
    want = {(r.identity, r.d): r.n for r in shape(table).groupBy("identity", F.date_trunc("day", "ts").alias("d")).agg(F.sum("amount").alias("n")).collect()}
    assert got == want


@pytest.mark.parametrize("parts", [0, 1, 3])
def test_streams_read_files_folders_and_empty_tables(spark, tmp_path, parts):
    """The same answers from one file, a folder of files and a table without rows."""
    import shutil

    from tidemark.catalog import streams as registered

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    if parts == 1:
        shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "events.parquet")
    else:
        (source.repartition(parts) if parts else source.limit(0)).write.parquet(str(tmp_path / "events.parquet"))
    count = lambda fn: fn(spark, str(tmp_path)).count()
    queries = (registered._r1, registered._r3, registered._r4, registered._r5, registered._r6)
    got = {fn.__name__: count(fn) for fn in queries}
    here = lambda fn: fn(spark, "/root/testdata/sf0.001").count()
    assert got == {fn.__name__: here(fn) if parts else 0 for fn in queries}


def test_months_are_sums_of_days(frame):
    days = frame([("q", "t", "u", datetime(2024, 1, d), 2) for d in (1, 30)] + [("q", "t", "u", datetime(2024, 2, 1), 1)], "quota string, tier string, identity string, period_start timestamp, used long")
    assert sorted((r.period_start, r.used) for r in s.monthly(days).collect()) == [(datetime(2024, 1, 1), 4), (datetime(2024, 2, 1), 1)]
