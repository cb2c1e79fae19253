from tidemark.operators import relational as r
from tidemark.operators import stats


def rows(frame, values, group="g"):
    return frame([(group, float(v), i) for i, v in enumerate(values)], "g string, v double, t int")


def test_summary_interpolates_quartiles(frame):
    out = stats.five_number_summary(rows(frame, [52, 61, 78, 67, 71, float("nan"), float("inf")]), ["g"], "v").first()
    assert (out.n, out.min, out.max, out.median, out.total, out.iqr, out["mean"]) == (5, 52, 78, 67, 329, 10, 65.8)
    assert stats.five_number_summary(rows(frame, [10, 20, 30, 40]), ["g"], "v").first().median == 25
    assert stats.five_number_summary(rows(frame, [float("nan")]), ["g"], "v").count() == 0


def test_at_or_below(frame):
    out = {x.v: x.percentile for x in stats.at_or_below_rank(rows(frame, [10, 20, 30, 40]), ["g"], "v").collect()}
    assert out == {10: 25, 20: 50, 30: 75, 40: 100}


def test_concentration(frame):
    share = lambda values: stats.top_share(rows(frame, values), ["g"], "v", 3).first().share
    assert share([50, 30, 15, 5]) == 95
    assert share([50, 30, 20]) is None and share([0, 0, 0, 0]) is None
    assert share([4, 4, 4, 4, -9]) == 75


def test_histogram(frame):
    bins = stats.histogram(rows(frame, range(11)), ["g"], "v", 5).orderBy("bin").collect()
    assert len(bins) == 5 and sum(x["count"] for x in bins) == 11 and bins[4].to == 10 and bins[4]["count"] == 3
    assert [(x["from"], x.to, x["count"]) for x in stats.histogram(rows(frame, [5, 5, 5]), ["g"], "v").collect()] == [(5, 5, 3)]
    kept = stats.histogram(rows(frame, [0, 10]), ["g"], "v", 4).collect()
    assert sorted(x["count"] for x in kept) == [0, 0, 1, 1]


def test_change(frame):
    out = stats.first_to_last(rows(frame, [50, 60, 75]), ["g"], "v", "t").first()
    assert (out.absolute, out.percent) == (25, 50)
    assert stats.first_to_last(rows(frame, [80]), ["g"], "v", "t").count() == 0
    assert stats.first_to_last(rows(frame, [0, 10]), ["g"], "v", "t").first().percent is None


def test_row_context_and_comparison(frame):
    out = {x.v: x for x in stats.row_context(rows(frame, [10, 20, 70]), ["g"], "v", True).collect()}
    assert (out[70].delta_to_median, out[70].percentile, out[70].share_of_total) == (50, 100, 70)
    left = frame([("a", 1.0), ("b", 3.0), ("c", 9.0)], "k string, value double")
    right = frame([("a", 5.0), ("b", 7.0)], "k string, value double")
    points = stats.compare_measures(left, right, "k").collect()
    assert {(p.k, p.x, p.y, p.x_median, p.y_median) for p in points} == {("a", 1, 5, 2, 6), ("b", 3, 7, 2, 6)}
    assert stats.compare_measures(left, right.where("k = 'a'"), "k").count() == 0


def test_coverage_with_total(frame):
    companies = frame([(1, "S", "large"), (2, "S", "large"), (3, "T", "mid"), (4, "T", "mid"), (5, "T", "mid")], "company_id int, sector string, mcap_band string")
    filings = frame([(1, 2025, "fetched"), (2, 2024, "fetched"), (3, 2025, "fetched"), (4, 2025, "fetched"), (5, 2025, "fetched")], "company_id int, fy int, status string")
    out = {x.sector: (x.companies, x.fetched, x.coverage_percent) for x in r.coverage(companies, filings, 2025).collect()}
    assert out == {"S": (2, 1, 50.0), "T": (3, 3, 100.0), None: (5, 4, 80.0)}


def test_versions_upserts_and_drift(frame):
    old = frame([("f", "k", 1), ("f", "k", 2)], "filing_id string, field_key string, version int")
    new = frame([("f", "k"), ("g", "k")], "filing_id string, field_key string")
    out = {x.filing_id: x.version for x in r.append_versions(old, new, ["filing_id", "field_key"]).collect()}
    assert out == {"f": 3, "g": 1}
    scores = frame([(1, 1, "s", "a", 10.0), (1, 1, "s", "b", 13.0), (2, 1, "s", "a", 5.0), (2, 1, "s", "b", 4.0), (3, 1, "s", "a", 1.0)], "company_id int, fy int, score_key string, method_version string, value double")
    assert tuple(r.score_drift(scores, "a", "b").first()) == ("s", 2, 2.0, 3.0)


def test_close_values_spread_over_many_blocks(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import ranking

    # a hundred thousand values within 0.01 % of each other, and some far away
    close = spark.range(100_000).select(F.lit("g").alias("g"), (F.lit(5000) + F.col("id") * 5e-6).alias("v"))
    far = spark.range(-500, 500).select(F.lit("g").alias("g"), (F.col("id") * 1.5).alias("v"))
    df = close.unionByName(far)
    per_block = df.groupBy(ranking.value_block(F.col("v")).alias("b")).count()
    assert per_block.agg(F.max("count")).first()[0] <= 200
    out = ranking.ordered_counts(df, ["g"], "v")
    from pyspark.sql import Window as W

    plain = df.withColumn("want", F.rank().over(W.partitionBy("g").orderBy("v")) - 1)
    wrong = plain.join(out, ["g", "v"]).where("want <> below OR total <> 101000").count()
    assert wrong == 0 and out.count() == 101_000
