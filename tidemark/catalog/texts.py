"""Text, similarity and documents: T1-T16 (T6 also serves the event digest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark import config
from tidemark.catalog import query
from tidemark.catalog.fragments import NARRATIVES, SCORES, SHINGLES, hash_vectors_sql
from tidemark.functions import text as t
from tidemark.functions.exprs import any_term
from tidemark.operators import text as x


@query(
    "t1_word_shingles",
    f"""WITH {SHINGLES} SELECT doc_id, count(*) AS shingles, count(DISTINCT phrase) AS distinct_shingles,
      min(sha256(phrase)) AS first_hash, max(sha256(phrase)) AS last_hash FROM sh GROUP BY 1""",
)
def _t1(spark: SparkSession, d: str) -> DataFrame:
    return x.shingle_counts(b.narratives(spark, d), "doc_id", "text")


@query(
    "t2_shared_phrases",
    f"""WITH {SHINGLES} SELECT sha256(phrase) AS phrase_hash, phrase, count(DISTINCT company) AS company_count
    FROM sh GROUP BY phrase HAVING count(DISTINCT company) >= 3""",
)
def _t2(spark: SparkSession, d: str) -> DataFrame:
    return x.shared_phrases(b.narratives(spark, d), ["doc_id"], "company", "text")


ORIGINALITY = f"""{SHINGLES}, shared AS (SELECT phrase FROM sh GROUP BY phrase HAVING count(DISTINCT company) >= 3),
own AS (SELECT DISTINCT doc_id, phrase FROM sh),
orig AS (SELECT n.doc_id, count(o.phrase) AS phrase_count, count(s.phrase) AS boilerplate_phrases,
  1 - count(s.phrase) / greatest(1, count(o.phrase)) AS originality
  FROM (SELECT DISTINCT doc_id FROM narr) n LEFT JOIN own o USING (doc_id) LEFT JOIN shared s USING (phrase) GROUP BY 1)"""


@query("t3_originality", f"WITH {ORIGINALITY} SELECT doc_id, phrase_count, boilerplate_phrases, round(originality, 6) AS originality FROM orig")
def _t3(spark: SparkSession, d: str) -> DataFrame:
    texts = b.narratives(spark, d)
    phrases = x.distinct_phrases(texts, ["doc_id", "company"], "text")
    docs = b.table(spark, d, "documents").select("doc_id")
    rows = x.originality(phrases, docs, "doc_id", x.boilerplate(phrases, "company"))
    return rows.withColumn("originality", F.round("originality", 6))


@query(
    "t4_hash_embedding",
    f"""WITH {hash_vectors_sql("v", "documents", "doc_id", "text", 1024)}
    SELECT doc_id, index, CAST(weight AS BIGINT) AS weight, round(weight / sqrt(norm2), 6) AS value FROM v""",
)
def _t4(spark: SparkSession, d: str) -> DataFrame:
    rows = x.hash_vectors(b.spread(b.table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    value = F.col("weight") / F.sqrt(F.col("norm2").cast("double"))
    return rows.select("doc_id", "index", "weight", F.round(value, 6).alias("value"))


@query(
    "t5_vector_top_k",
    """WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY 1),
    s AS (SELECT query_id, vec_id, list_dot_product(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings)
    SELECT query_id, vec_id, round(score, 6) AS score FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 12""",
)
def _t5(spark: SparkSession, d: str) -> DataFrame:
    vectors = b.table(spark, d, "embeddings")
    queries = vectors.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    top = x.vector_top_k(queries, vectors, "query_id", "vec_id", "embedding", 12)
    return top.withColumn("score", F.round("score", 6))


SEEDS = ", ".join(f"({i}, '{label}', '{words}')" for i, (label, words) in enumerate(config.THEME_SEEDS.items()))
CONVERSATION_TEXT = """conv AS (SELECT conv_id * 1000 + turn AS doc_id, text || CASE (conv_id + turn) % 4 WHEN 0 THEN ' Which sector is leader on renewable energy?'
  WHEN 1 THEN ' How much water is recycled?' WHEN 2 THEN ' Any stock tip or weather news?' ELSE '' END AS text FROM conversations WHERE role = 'user')"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    closings = (
        " Which sector is leader on renewable energy?",
        " How much water is recycled?",
        " Any stock tip or weather news?",
        "",
    )
    number = ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int")
    closing = F.element_at(F.array(*[F.lit(c) for c in closings]), number)
    users = b.table(spark, d, "conversations").where("role = 'user'")
    return users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat("text", closing).alias("text"))


@query(
    "t6_theme_classification",
    f"""WITH {CONVERSATION_TEXT}, seeds(seed, theme, words) AS (VALUES {SEEDS}),
    {hash_vectors_sql("sv", "seeds", "seed", "words", 256)}, {hash_vectors_sql("v", "conv", "doc_id", "text", 256)},
    s AS (SELECT doc_id, seed, sum(v.weight * sv.weight) / (sqrt(any_value(v.norm2)) * sqrt(any_value(sv.norm2))) AS sim
      FROM v JOIN sv USING (index) GROUP BY 1, 2),
    best AS (SELECT doc_id, seed, sim FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, seed) = 1)
    SELECT conv.doc_id, coalesce(theme, '{config.THEME_OTHER}') AS theme FROM conv LEFT JOIN best ON best.doc_id = conv.doc_id AND sim > 0
    LEFT JOIN seeds USING (seed)""",
)
def _t6(spark: SparkSession, d: str) -> DataFrame:
    return x.themes(questions(spark, d), "doc_id", "text")


JACCARD = """q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS org, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2)) AS qs FROM benchmark),
p AS (SELECT doc_id AS page_id, source AS org, text, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2)) AS ps FROM documents),
m AS (SELECT query_id, page_id, len(list_intersect(qs, ps)) AS common, len(qs) AS nq, len(ps) AS np FROM q JOIN p USING (org)),
j AS (SELECT query_id, page_id, common / (nq + np - common) AS score FROM m WHERE common > 0)"""


def field_queries(spark: SparkSession, d: str) -> DataFrame:
    dtypes = F.array(*[F.lit(v) for v in ("number", "integer", "boolean", "text")])
    return b.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("org"),
        F.col("text").alias("label"),
        F.concat(F.lit("a.evidence.item"), F.col("item_id") % 7).alias("field_key"),
        F.when(F.col("item_id") % 3 == 0, "percent").alias("unit"),
        F.element_at(dtypes, (F.col("item_id") % 4 + 1).cast("int")).alias("dtype"),
    )


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    return b.spread(b.table(spark, d, "documents")).select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("org"), "text"
    )


@query(
    "t7_jaccard_retrieval",
    f"""WITH {JACCARD} SELECT query_id, page_id, round(score, 9) AS score FROM j
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) <= 5""",
)
def _t7(spark: SparkSession, d: str) -> DataFrame:
    queries = field_queries(spark, d).withColumnRenamed("label", "query")
    return x.retrieve(queries, document_pages(spark, d), 5).withColumn("score", F.round("score", 9))


def report_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of a filing per source; the headings come from the closing sentences."""
    headings = (
        "Section A: General disclosures. ",
        "Sectlon A general disclosure. ",
        "Principle 6 environment. ",
        "",
        "",
        "Business Responsibility and Sustainability Report. ",
        "",
    )
    heading = F.element_at(F.array(*[F.lit(h) for h in headings]), (F.floor(F.col("doc_id") / 20) % 7 + 1).cast("int"))
    return b.spread(b.table(spark, d, "documents")).select(
        F.col("source").alias("filing_id"),
        F.floor(F.col("doc_id") / 20).alias("page_no"),
        F.concat(heading, "text").alias("text"),
    )


@query("t8_section_locator")
def _t8(spark: SparkSession, d: str) -> DataFrame:
    return x.locate_sections(report_pages(spark, d))[0]


@query("t8_page_sections")
def _t8b(spark: SparkSession, d: str) -> DataFrame:
    return x.locate_sections(report_pages(spark, d))[1]


@query(
    "t9_section_carry_forward",
    """WITH h AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'p' || (length(text) % 9 + 1) END AS hit FROM conversations)
    SELECT conv_id, turn, last_value(hit IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM h""",
)
def _t9(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("text")
    hit = F.when(size % 3 == 0, F.concat(F.lit("p"), size % 9 + 1))
    rows = b.table(spark, d, "conversations").select("conv_id", "turn", hit.alias("hit"))
    return x.carry_forward(rows, ["conv_id"], "turn", "hit", "section").drop("hit")


@query(
    "t10_table_regions",
    """WITH words AS (SELECT l_partkey AS page_id, CAST(l_orderkey % 600 AS DOUBLE) AS x0, l_quantity AS y0 FROM lineitem),
    k AS (SELECT *, x0 + 10 AS x1, y0 + 4 AS y1, round_even(y0 / 5, 0) AS r, round_even(x0 / 12, 0) AS c, count(*) OVER (PARTITION BY page_id) AS words,
      count(*) OVER (PARTITION BY page_id, round_even(y0 / 5, 0)) AS in_row FROM words)
    SELECT page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(DISTINCT r) AS rows, count(DISTINCT c) AS columns
    FROM k WHERE in_row >= 3 GROUP BY page_id, words HAVING count(DISTINCT r) >= 2 AND count(DISTINCT c) >= 3 AND words >= 8""",
)
def _t10(spark: SparkSession, d: str) -> DataFrame:
    left, top = (F.col("l_orderkey") % 600).cast("double"), F.col("l_quantity")
    words = b.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("page_id"),
        left.alias("x0"),
        top.alias("y0"),
        (left + 10).alias("x1"),
        (top + 4).alias("y1"),
    )
    return x.table_regions(words)


def _kinds_sql() -> str:
    counts = []
    for kind, terms in config.DOCUMENT_KINDS:
        parts = " + ".join(f"CAST((length(t) - length(replace(t, '{v}', ''))) / {len(v)} AS INTEGER)" for v in terms)
        counts.append(f"{parts} AS {kind}")
    names = [kind for kind, _ in config.DOCUMENT_KINDS]
    cases = " ".join(f"WHEN {n} = best THEN '{n}'" for n in names)
    return f"""l AS (SELECT doc_id, lower(text) AS t FROM narr), c AS (SELECT doc_id, {', '.join(counts)} FROM l),
    g AS (SELECT *, greatest({', '.join(names)}) AS best FROM c)
    SELECT doc_id, CASE WHEN best = 0 THEN 'other' {cases} END AS kind FROM g"""


@query("t11_document_classification", f"WITH {NARRATIVES}, {_kinds_sql()}")
def _t11(spark: SparkSession, d: str) -> DataFrame:
    return b.narratives(spark, d).select("doc_id", t.classify(F.col("text"), config.DOCUMENT_KINDS).alias("kind"))


NORMAL = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query(
    "t12_verbatim_quotes",
    f"""WITH d AS (SELECT doc_id AS page_id, {NORMAL.format('text')} AS t FROM documents), q AS (SELECT item_id AS quote_id, {NORMAL.format('text')} AS s FROM benchmark)
    SELECT quote_id, page_id FROM q JOIN d ON s <> '' AND contains(t, s)""",
)
def _t12(spark: SparkSession, d: str) -> DataFrame:
    quotes = b.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return x.find_quotes(quotes, document_pages(spark, d))


@query(
    "t13_field_proposals",
    f"""WITH {JACCARD.replace("lower(text)", "lower(text || ' a.evidence.item' || (item_id % 7))", 1)}, best AS (SELECT * FROM j WHERE query_id % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) = 1),
    v AS (SELECT query_id, page_id, score, text, replace(nullif(regexp_extract(text, '(^|[^A-Za-z])([0-9][0-9,]*(?:\\.[0-9]+)?)', 2), ''), ',', '') AS num
      FROM best JOIN p USING (page_id)),
    o AS (SELECT query_id, page_id, CASE query_id % 4 WHEN 0 THEN num WHEN 1 THEN CAST(CAST(floor(CAST(num AS DOUBLE)) AS BIGINT) AS VARCHAR)
        WHEN 2 THEN CASE WHEN contains(lower(text), 'yes') OR contains(lower(text), 'approved') OR contains(lower(text), 'available') THEN 'true' ELSE 'false' END
        ELSE nullif(left(trim(text), 500), '') END AS value, trim(left(text, 280)) AS quote, least(0.98::DOUBLE, 0.7::DOUBLE + score) AS confidence FROM v)
    SELECT query_id, 'a.evidence.item' || (query_id % 7) AS field_key, CASE WHEN query_id % 3 = 0 THEN 'percent' END AS unit, page_id, value, quote, round(confidence, 9) AS confidence, 'unreviewed' AS review_status FROM o WHERE value IS NOT NULL AND quote <> ''""",
)
def _t13(spark: SparkSession, d: str) -> DataFrame:
    fields = field_queries(spark, d)
    answered = fields.where("query_id % 10 = 3")
    rows = x.propose_fields(fields, document_pages(spark, d), answered)
    return rows.withColumn("confidence", F.round("confidence", 9))


@query(
    "t14_evidence_gaps",
    """WITH f AS (SELECT p_partkey AS field_key, p_brand || ' ' || p_name AS principle FROM part), e AS (SELECT DISTINCT l_partkey AS field_key FROM lineitem WHERE l_extendedprice > 90000)
    SELECT principle, count(*) AS fields FROM f LEFT JOIN e USING (field_key) GROUP BY 1 HAVING count(e.field_key) = 0""",
)
def _t14(spark: SparkSession, d: str) -> DataFrame:
    defs = b.table(spark, d, "part").select(F.col("p_partkey").alias("field_key"), F.concat_ws(" ", "p_brand", "p_name").alias("principle"))
    lines = b.table(spark, d, "lineitem").where("l_extendedprice > 90000")
    return x.evidence_gaps(defs, lines.select(F.col("l_partkey").alias("field_key")))


@query(
    "t15_high_score_page_search",
    f"""WITH {SCORES}, pg AS (SELECT doc_id AS page_id, doc_id % 10 AS company_id, CAST(1996 + doc_id % 5 AS INTEGER) AS fy, text FROM documents),
    ok AS (SELECT pg.* FROM pg WHERE EXISTS (SELECT 1 FROM scores s WHERE s.company_id = pg.company_id AND s.fy = pg.fy AND s.score_key = 'substance'
      AND s.method_version = (SELECT max(method_version) FROM scores) AND s.value >= 33)),
    {hash_vectors_sql("qv", "benchmark", "item_id", "text", 1024)}, {hash_vectors_sql("v", "ok", "page_id", "text", 1024)},
    s AS (SELECT item_id AS query_id, page_id, sum(v.weight * qv.weight) / (sqrt(any_value(v.norm2)) * sqrt(any_value(qv.norm2))) AS similarity
      FROM v JOIN qv USING (index) GROUP BY 1, 2)
    SELECT query_id, page_id, round(similarity, 6) AS similarity, left(text, 500) AS excerpt, fy FROM s JOIN ok USING (page_id)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, page_id) <= 5""",
)
def _t15(spark: SparkSession, d: str) -> DataFrame:
    pages = b.spread(b.table(spark, d, "documents")).select(
        F.col("doc_id").alias("page_id"),
        (F.col("doc_id") % 10).alias("company_id"),
        (F.col("doc_id") % 5 + 1996).cast("int").alias("fy"),
        "text",
    )
    queries = b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    rows = x.high_score_pages(queries, pages, b.scores(spark, d), 33)
    return rows.withColumn("similarity", F.round("similarity", 6))


BLOCKED = " OR ".join(f"contains(lower(text), '{term}')" for term in config.BLOCKED_TERMS)


@query("t16_blocked_terms", f"WITH {CONVERSATION_TEXT} SELECT doc_id, {BLOCKED} AS out_of_scope FROM conv")
def _t16(spark: SparkSession, d: str) -> DataFrame:
    rows = questions(spark, d)
    return rows.select("doc_id", any_term(F.col("text"), config.BLOCKED_TERMS).alias("out_of_scope"))
