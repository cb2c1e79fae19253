"""Event analytics: E1-E18 and J11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b, config
from tidemark.bindings import AS_OF, WINDOW_DAYS
from tidemark.catalog import query
from tidemark.catalog.fragments import hash_vectors_sql
from tidemark.catalog.texts import SEEDS
from tidemark.functions.exprs import stable_key
from tidemark.operators import events as e

REGISTERED = ("view", "click", "purchase", "signup")
STEPS = [("View", ["view"]), ("Click", ["click"]), ("Purchase", ["purchase"])]
LABELS = {"view": "Company deep-dives", "click": "Gap panels", "purchase": "Board exports"}
RULES = [
    e.SignalRule("view", 10, "Reviewed a company disclosure gap", max_occurrences=3),
    e.SignalRule("click", 15, "Asked about timing", max_occurrences=2),
    e.SignalRule("intent", 5, "Signed up with intent", event="signup", max_occurrences=2, contains={"k": ["9", "4"]}),
    e.SignalRule("purchase", 50, "Requested a deep-dive", instant=True),
]

EV = """ev AS (SELECT event_id, ts, event_type AS name, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id,
  CASE WHEN event_id % 25 <> 0 THEN 'anon-' || (user_id % 40) END AS anon_id, props, value FROM events),
idy AS (SELECT *, coalesce(CAST(user_id AS VARCHAR), anon_id, 'unknown') AS identity FROM ev)"""

SIGNALS = f"""{EV}, rules(signal, name, points, label, cap, instant) AS (VALUES
  ('view', 'view', 10, 'Reviewed a company disclosure gap', 3, false), ('click', 'click', 15, 'Asked about timing', 2, false),
  ('intent', 'signup', 5, 'Signed up with intent', 2, false), ('purchase', 'purchase', 50, 'Requested a deep-dive', 1, true)),
matched AS (SELECT * FROM ev JOIN rules USING (name) WHERE signal <> 'intent'
  OR contains(json_extract_string(props, '$.k'), '9') OR contains(json_extract_string(props, '$.k'), '4')),
signals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, signal ORDER BY ts DESC, event_id DESC) AS place
  FROM matched WHERE user_id IS NOT NULL AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL {WINDOW_DAYS} DAYS) m WHERE place <= cap),
leads AS (SELECT user_id, CAST(sum(points) AS BIGINT) AS score, bool_or(instant) AS instant FROM signals GROUP BY 1)"""


def plain_leads(spark: SparkSession, d: str) -> DataFrame:
    return e.lead_scores(b.events(spark, d), RULES, AS_OF, WINDOW_DAYS)


@query("e1_registry_quarantine", "SELECT event_id, event_type AS name FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')")
def _e1(spark: SparkSession, d: str) -> DataFrame:
    return e.split_registered(b.events(spark, d), REGISTERED)[1].select("event_id", "name")


def opted_out(spark: SparkSession, d: str) -> DataFrame:
    users = b.table(spark, d, "events").select("user_id").distinct()
    return users.where(F.col("user_id") % 13 == 4)


@query("e2_opt_out_suppression", f"WITH {EV} SELECT event_id, user_id FROM ev WHERE user_id IS NULL OR user_id % 13 <> 4")
def _e2(spark: SparkSession, d: str) -> DataFrame:
    return e.drop_opted_out(b.events(spark, d), opted_out(spark, d)).select("event_id", "user_id")


LINKS = "(SELECT DISTINCT 'anon-' || (user_id % 40) AS anon_id, user_id % 40 AS linked FROM events WHERE user_id % 40 < 25)"


@query(
    "e3_identity_merge",
    f"""WITH {EV} SELECT event_id, coalesce(ev.user_id, l.linked) AS user_id, ev.anon_id FROM ev LEFT JOIN {LINKS} l ON l.anon_id = ev.anon_id""",
)
def _e3(spark: SparkSession, d: str) -> DataFrame:
    slot = F.col("user_id") % 40
    links = b.table(spark, d, "events").where(slot < 25)
    links = links.select(F.concat(F.lit("anon-"), slot).alias("anon_id"), slot.alias("user_id")).distinct()
    return e.merge_identity(b.events(spark, d), links).select("event_id", "user_id", "anon_id")


@query("e4_identity_resolution", f"WITH {EV} SELECT identity, count(*) AS events FROM idy GROUP BY 1")
def _e4(spark: SparkSession, d: str) -> DataFrame:
    return b.events(spark, d).groupBy(e.identity().alias("identity")).agg(F.count(F.lit(1)).alias("events"))


FUNNEL = f"""WITH {EV}, o AS (SELECT identity, name, {{'ts': ts, 'id': event_id}} AS m FROM idy),
    s1 AS (SELECT identity, min(m) AS m FROM o WHERE name = 'view' GROUP BY 1),
    s2 AS (SELECT o.identity, min(o.m) AS m FROM o JOIN s1 USING (identity) WHERE name = 'click' AND o.m > s1.m GROUP BY 1),
    s3 AS (SELECT o.identity, min(o.m) AS m FROM o JOIN s2 USING (identity) WHERE name = 'purchase' AND o.m > s2.m GROUP BY 1),
    c AS (SELECT 0 AS stage, 'View' AS name, count(*) AS users FROM s1 UNION ALL SELECT 1, 'Click', count(*) FROM s2
      UNION ALL SELECT 2, 'Purchase', count(*) FROM s3)
    SELECT *, round(users / lag(users) OVER (ORDER BY stage), 4) AS conversion_from_previous FROM c"""


@query("e5_ordered_funnel", FUNNEL)
def _e5(spark: SparkSession, d: str) -> DataFrame:
    return e.funnel(b.events(spark, d), STEPS)


USAGE = """SELECT CASE name WHEN 'view' THEN 'Company deep-dives' WHEN 'click' THEN 'Gap panels' ELSE 'Board exports' END AS name,
  count(*) AS count FROM ev WHERE name IN ('view', 'click', 'purchase') GROUP BY 1"""
INTEREST = "SELECT json_extract_string(props, '$.k') AS name, count(*) AS count FROM ev GROUP BY 1"


ASKED = ("Which sector is leader on renewable energy?", "How much water is recycled?", "Any stock tip or weather news?", "")


def themes_sql(events: str) -> str:
    """Themes of the questions asked with clicks, as a query of its own."""
    cases = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(ASKED) if text)
    return f"""WITH conv AS (SELECT * FROM (SELECT event_id AS doc_id, CASE event_id % 4 {cases} END AS text FROM {events} WHERE name = 'click') WHERE text IS NOT NULL),
    seeds(seed, theme, words) AS (VALUES {SEEDS}), {hash_vectors_sql("sv", "seeds", "seed", "words", 256)}, {hash_vectors_sql("v", "conv", "doc_id", "text", 256)},
    s AS (SELECT doc_id, seed, sum(v.weight * sv.weight) / (sqrt(any_value(v.norm2)) * sqrt(any_value(sv.norm2))) AS sim FROM v JOIN sv USING (index) GROUP BY 1, 2),
    best AS (SELECT doc_id, seed, sim FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, seed) = 1)
    SELECT coalesce(theme, '{config.THEME_OTHER}') AS name, count(*) AS count FROM conv LEFT JOIN best ON best.doc_id = conv.doc_id AND sim > 0 LEFT JOIN seeds USING (seed) GROUP BY 1"""


def with_questions(events: DataFrame) -> DataFrame:
    question = F.element_at(F.array(*[F.lit(text) for text in ASKED]), (F.col("event_id") % 4 + 1).cast("int"))
    return events.withColumn("props", F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), question.alias("question"))))


@query(
    "e6_usage_and_interest",
    f"""WITH {EV} SELECT 'usage' AS kind, name, count FROM ({USAGE}) UNION ALL SELECT 'interest', name, count FROM ({INTEREST})
    UNION ALL SELECT 'theme', name, count FROM ({themes_sql("ev")})
    UNION ALL SELECT 'range_start', strftime(min(ts), '%Y-%m-%d %H:%M:%S'), count(*) FROM ev""",
)
def _e6(spark: SparkSession, d: str) -> DataFrame:
    ev = with_questions(b.events(spark, d))
    tag = lambda kind, df: df.select(F.lit(kind).alias("kind"), "name", "count")
    start = ev.agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("name"), F.count(F.lit(1)).alias("count")
    )
    parts = tag("usage", e.feature_usage(ev, LABELS)).unionByName(tag("interest", e.property_counts(ev, "k")))
    return parts.unionByName(tag("theme", e.question_themes(ev, name="click"))).unionByName(tag("range_start", start))


@query("e7_look_back_window", f"WITH {EV} SELECT event_id, name FROM ev WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {WINDOW_DAYS} DAYS")
def _e7(spark: SparkSession, d: str) -> DataFrame:
    return e.look_back(b.events(spark, d), AS_OF, WINDOW_DAYS).select("event_id", "name")


TOP = "ORDER BY count DESC, name LIMIT 5"


@query(
    "e8_digest_top_five",
    f"""WITH {EV}, ev7 AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS)
    SELECT 'usage' AS kind, * FROM ({USAGE.replace('FROM ev', 'FROM ev7')} {TOP}) UNION ALL SELECT 'interest', * FROM ({INTEREST.replace('FROM ev', 'FROM ev7')} {TOP})
    UNION ALL SELECT 'theme', * FROM ({themes_sql("ev7")} {TOP})""",
)
def _e8(spark: SparkSession, d: str) -> DataFrame:
    week = with_questions(e.look_back(b.events(spark, d), AS_OF, 7))
    counts = {"usage": e.feature_usage(week, LABELS), "interest": e.property_counts(week, "k"), "theme": e.question_themes(week, name="click")}
    parts = [e.digest_top(rows).select(F.lit(kind).alias("kind"), "name", "count") for kind, rows in counts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "e9_lead_scores",
    f"""WITH {SIGNALS} SELECT user_id, CAST(sum(points) AS BIGINT) AS score, bool_or(instant) AS instant,
      string_agg(signal, ',' ORDER BY ts, event_id, signal) AS timeline FROM signals GROUP BY 1""",
)
def _e9(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array_join(F.transform("timeline", lambda step: step["key"]), ",")
    return plain_leads(spark, d).withColumn("timeline", keys)


@query(
    "j11_rule_join",
    f"WITH {SIGNALS} SELECT event_id, signal, points FROM matched",
)
def _j11(spark: SparkSession, d: str) -> DataFrame:
    return e.match_signals(b.events(spark, d), RULES).select("event_id", "signal", "points")


@query(
    "e10_lead_upsert",
    f"""WITH {SIGNALS}, existing AS (SELECT DISTINCT sha256('old/' || user_id) AS lead_id, user_id, CAST(99 AS BIGINT) AS org_id,
      CASE WHEN user_id % 12 = 0 THEN 'new' ELSE 'won' END AS status, CAST(1 AS BIGINT) AS score FROM events WHERE user_id % 6 = 0),
    chg AS (SELECT coalesce(x.lead_id, sha256('lead/' || l.user_id)) AS lead_id, l.user_id,
      CASE WHEN x.lead_id IS NULL THEN l.user_id % 20 ELSE x.org_id END AS org_id, coalesce(x.status, 'new') AS status, l.score
      FROM leads l LEFT JOIN existing x ON x.user_id = l.user_id AND x.status IN ('new', 'routed'))
    SELECT * FROM existing WHERE lead_id NOT IN (SELECT lead_id FROM chg) UNION ALL SELECT * FROM chg""",
)
def _e10(spark: SparkSession, d: str) -> DataFrame:
    users = b.table(spark, d, "events").select("user_id").distinct()
    existing = users.where("user_id % 6 = 0").select(
        stable_key("old", "user_id").alias("lead_id"),
        "user_id",
        F.lit(99).cast("long").alias("org_id"),
        F.when(F.col("user_id") % 12 == 0, "new").otherwise("won").alias("status"),
        F.lit(1).cast("long").alias("score"),
    )
    # Every user joined its own organisation first and a shared one a year later.
    joined = F.inline(
        F.array(
            F.struct((F.col("user_id") % 20).alias("org_id"), F.lit("2020-01-01").alias("created_at")),
            F.struct(F.lit(7).cast("long").alias("org_id"), F.lit("2021-01-01").alias("created_at")),
        )
    )
    return e.upsert_leads(existing, plain_leads(spark, d), users.select("user_id", joined))


@query(
    "e11_routing_eligibility",
    f"""WITH {SIGNALS} SELECT user_id, user_id % 20 AS org_id, score FROM leads
    WHERE user_id % 13 <> 4 AND user_id % 17 <> 3 AND (instant OR score >= 50) AND user_id % 20 NOT IN (2, 5)
    QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY score DESC, user_id) = 1""",
)
def _e11(spark: SparkSession, d: str) -> DataFrame:
    leads = plain_leads(spark, d).select(
        "user_id",
        (F.col("user_id") % 20).alias("org_id"),
        "score",
        "instant",
        (F.col("user_id") % 13 == 4).alias("opted_out"),
        (F.col("user_id") % 17 == 3).alias("routed"),
    )
    orgs = b.table(spark, d, "events").select((F.col("user_id") % 20).alias("org_id")).where("org_id IN (2, 5)")
    return e.routable_leads(leads, orgs).select("user_id", "org_id", "score")


@query(
    "e12_opening_context",
    f"""WITH {SIGNALS} SELECT user_id, arg_max(label, {{'ts': ts, 'id': event_id}}) AS focus,
      arg_max(json_extract_string(props, '$.k'), {{'ts': ts, 'id': event_id}}) AS company FROM signals GROUP BY 1""",
)
def _e12(spark: SparkSession, d: str) -> DataFrame:
    return e.opening_context(e.scored_signals(b.events(spark, d), RULES, AS_OF, WINDOW_DAYS), "k")


@query(
    "e13_signal_quality",
    f"""WITH {SIGNALS}, o AS (SELECT DISTINCT user_id, signal, CASE user_id % 4 WHEN 0 THEN 'won' WHEN 1 THEN 'lost' WHEN 2 THEN 'meeting' END AS outcome FROM signals)
    SELECT signal, count(*) AS leads, count(*) FILTER (WHERE outcome IN ('qualified', 'meeting', 'proposal', 'won')) AS positive_outcomes,
      round_even(count(*) FILTER (WHERE outcome IN ('qualified', 'meeting', 'proposal', 'won')) / count(*), 4) AS conversion_rate
    FROM o WHERE outcome IS NOT NULL GROUP BY 1""",
)
def _e13(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("user_id") % 4
    outcome = F.when(kind == 0, "won").when(kind == 1, "lost").when(kind == 2, "meeting")
    return e.signal_quality(plain_leads(spark, d).withColumn("outcome", outcome))


@query(
    "e14_retention_rollup",
    f"""WITH {EV}, daily AS (SELECT CAST(ts AS DATE) AS day, name, CAST(1000 AS BIGINT) AS event_count FROM ev WHERE ts < TIMESTAMP '2024-01-05' GROUP BY 1, 2),
    old AS (SELECT CAST(ts AS DATE) AS day, name, count(*) AS event_count FROM ev WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2)
    SELECT CAST(day AS VARCHAR) AS day, name, CAST(sum(event_count) AS BIGINT) AS event_count FROM (FROM daily UNION ALL FROM old) u GROUP BY 1, 2""",
)
def _e14(spark: SparkSession, d: str) -> DataFrame:
    ev = b.events(spark, d)
    daily = ev.where("ts < '2024-01-05'").select(
        F.col("ts").cast("date").alias("day"), "name", F.lit(1000).cast("long").alias("event_count")
    )
    rows = e.retention_rollup(ev, daily.distinct(), "2024-02-16 08:30:00", 1)
    return rows.withColumn("day", F.col("day").cast("string"))


@query("e14_retained_events", f"WITH {EV} SELECT event_id FROM ev WHERE ts >= TIMESTAMP '2024-01-16'")
def _e14b(spark: SparkSession, d: str) -> DataFrame:
    return e.retained(b.events(spark, d), "2024-02-16 08:30:00", 1).select("event_id")


@query(
    "e15_subject_export",
    f"WITH {EV} SELECT event_id, user_id, name FROM ev WHERE user_id % 50 = 7",
)
def _e15(spark: SparkSession, d: str) -> DataFrame:
    requests = b.table(spark, d, "events").select("user_id").where("user_id % 50 = 7")
    return e.export_subjects(b.events(spark, d), requests).select("event_id", "user_id", "name")


@query("e15_subject_erasure", f"WITH {EV} SELECT event_id FROM ev WHERE user_id IS NULL OR user_id % 50 <> 7")
def _e15b(spark: SparkSession, d: str) -> DataFrame:
    requests = b.table(spark, d, "events").select("user_id").where("user_id % 50 = 7")
    return e.erase_subjects(b.events(spark, d), requests).select("event_id")


def uses(spark: SparkSession, d: str) -> DataFrame:
    return shape_uses(b.table(spark, d, "events"))


def shape_uses(raw: DataFrame) -> DataFrame:
    """Quota uses: four event kinds as four quotas, the user's tier by its number."""
    tier = F.element_at(F.array(*[F.lit(t) for t in ("explore", "pro", "studio", "research")]), (F.col("user_id") % 4 + 1).cast("int"))
    quota = (
        F.when(F.col("event_type") == "view", "nlq_per_day")
        .when(F.col("event_type") == "click", "api_queries_per_minute")
        .when(F.col("event_type") == "purchase", "exports_per_month")
        .otherwise("studio_tokens_per_month")
    )
    return raw.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("identity"),
        tier.alias("tier"),
        quota.alias("quota"),
        (F.col("event_id") % 12 + 1).alias("amount"),
    )


USES = """uses AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS identity, (user_id % 4 = 0)::INT AS t0,
  CASE user_id % 4 WHEN 0 THEN 'explore' WHEN 1 THEN 'pro' WHEN 2 THEN 'studio' ELSE 'research' END AS tier,
  CASE event_type WHEN 'view' THEN 'nlq_per_day' WHEN 'click' THEN 'api_queries_per_minute' WHEN 'purchase' THEN 'exports_per_month'
    ELSE 'studio_tokens_per_month' END AS quota,
  CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d') WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M') ELSE strftime(ts, '%Y-%m') END AS period,
  event_id % 12 + 1 AS amount FROM events),
lim(tier, quota, "limit") AS (VALUES ('explore', 'nlq_per_day', 10), ('pro', 'nlq_per_day', 100), ('pro', 'exports_per_month', 25),
  ('studio', 'nlq_per_day', 100), ('studio', 'exports_per_month', 50), ('studio', 'studio_tokens_per_month', 1000000),
  ('research', 'nlq_per_day', 500), ('research', 'exports_per_month', 100), ('research', 'api_queries_per_minute', 60))"""


@query(
    "e16_quota_usage",
    f"""WITH {USES}, u AS (SELECT quota, tier, identity, period, CAST(sum(amount) AS BIGINT) AS used FROM uses GROUP BY ALL)
    SELECT u.*, coalesce("limit", 0) AS "limit", greatest(0, coalesce("limit", 0) - used) AS remaining,
      coalesce("limit", 0) > 0 AND used / coalesce("limit", 0) >= 0.8 AS warning, coalesce("limit", 0) <= 0 OR used > coalesce("limit", 0) AS exceeded
    FROM u LEFT JOIN lim USING (tier, quota)""",
)
def _e16(spark: SparkSession, d: str) -> DataFrame:
    return e.quota_usage(uses(spark, d), e.quota_limits(spark))


@query(
    "e16_quota_decisions",
    f"""WITH {USES}, r AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY quota, tier, identity, period ORDER BY ts, event_id) AS BIGINT) AS used FROM uses)
    SELECT event_id, quota, period, used, coalesce("limit", 0) <= 0 OR used > coalesce("limit", 0) AS rejected FROM r LEFT JOIN lim USING (tier, quota)""",
)
def _e16b(spark: SparkSession, d: str) -> DataFrame:
    rows = e.quota_decisions(uses(spark, d), e.quota_limits(spark))
    return rows.select("event_id", "quota", "period", "used", "rejected")


LICENCE = """CASE WHEN o_orderkey % 7 = 0 OR TIMESTAMP '1998-06-01' <= o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) THEN 'active'
  WHEN o_orderkey % 3 <> 0 AND TIMESTAMP '1998-06-01' <= o_orderdate + to_days(CAST(o_orderkey % 400 + 90 AS INTEGER)) THEN 'grace' ELSE 'read_only' END"""


@query("e17_licence_state", f"SELECT o_orderkey, {LICENCE} AS state FROM orders")
def _e17(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    expires = F.when(key % 7 != 0, F.col("o_orderdate") + F.make_dt_interval((key % 400).cast("int")))
    grace = F.when(key % 3 != 0, expires + F.expr("INTERVAL 90 DAYS"))
    orders = b.table(spark, d, "orders")
    return orders.select("o_orderkey", e.licence_state(expires, grace, "1998-06-01").alias("state"))


LIMITED = f"""WITH RECURSIVE {EV}, starts AS (SELECT identity, min(ts) AS s FROM idy GROUP BY 1
      UNION ALL SELECT identity, n FROM (SELECT st.identity, (SELECT min(ts) FROM idy WHERE idy.identity = st.identity AND idy.ts >= st.s + INTERVAL 6 HOURS) AS n
        FROM starts st) x WHERE n IS NOT NULL),
    placed AS (SELECT i.identity, i.event_id, i.ts, max(s) AS s FROM idy i JOIN starts st ON st.identity = i.identity AND st.s <= i.ts GROUP BY 1, 2, 3)
    SELECT identity, event_id, row_number() OVER (PARTITION BY identity, s ORDER BY ts, event_id) AS place,
      row_number() OVER (PARTITION BY identity, s ORDER BY ts, event_id) > 2 AS rejected FROM placed"""


@query("e18_anchored_rate_limit", LIMITED)
def _e18(spark: SparkSession, d: str) -> DataFrame:
    hits = b.events(spark, d).withColumn("identity", e.identity())
    return e.rate_limit(hits, limit=2, window_seconds=6 * 3600)
