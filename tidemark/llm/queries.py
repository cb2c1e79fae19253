"""The registered queries of the corpus operators, with SQL where SQL can state them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, hamming, html_text, language, lexical, licenses, packing, simhash, substrings, token_counts, toxicity, whitening
from tidemark.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contamination_oracle(window: int = decontaminate.WINDOW) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    words = words.format(decontaminate.UPPER, decontaminate.LOWER)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words} AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item, w[i:i + {window - 1}] AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, i, size, w[i:i + size - 1] AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT len(g) AS size FROM windows))),
hits AS MATERIALIZED (SELECT doc_id, i, size, item FROM places JOIN windows USING (g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op1_decontamination", contamination_oracle())
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.summary(decontaminate.contamination(documents, table(spark, sf_dir, "benchmark")))


@query("op2_license_scan", licenses.oracle())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and again after its personal data have been replaced."""
    trees = token_counts.build(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    before = trees.withColumn("before", F.struct("doc_id", "n_tokens")).drop("doc_id").withColumnRenamed("before", "doc_id")
    after = token_counts.apply_edits(token_counts.with_redactions(before), RANKS, public_tokenizers.PATTERN)
    return after.select("doc_id.doc_id", F.col("doc_id.n_tokens").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), "n_edits", "n_again")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(documents, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), WORDS)


@query("op7_simhash_components")
def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def hamming_oracle(k: int = hamming.K) -> str:
    bits = " + ".join(f"(CASE WHEN embedding[{b + 1}] > 0 THEN {1 << b} ELSE 0 END)::UBIGINT" for b in range(64))
    return f"""
WITH c AS (SELECT DISTINCT vec_id, {bits} AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, CAST(min(bit_count(xor(q.code, r.code))) AS INTEGER) AS distance
  FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, neighbour_id, distance FROM n WHERE rank <= {k}"""


@query("op8_hamming_top_k", hamming_oracle())
def op8_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op9_repeated_substrings")
def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_page_text")
def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    component = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of")
    rows = done.select("row.vec_id", "n", "deviation", "deviation_digits", "identity_error", component)
    figures = ["of.whitened", "of.explained", "identity_error", "deviation_digits"]
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", *figures)


@query("op12_lexical_search", lexical.oracle())
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_chat_format", chat.oracle())
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and one whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(planted)))
