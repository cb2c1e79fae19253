"""The full rebuild: metrics, shared phrases, scores and the governed facts from the published fields."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import metrics as m
from tidemark.operators import scores as s
from tidemark.operators import text as x
from tidemark.plans import store


def rebuild(
    pinned: DataFrame,
    companies: DataFrame,
    field_defs: DataFrame,
    rules: m.MetricRules,
    out_dir: str,
    scoring: dict[str, Any] | None = None,
) -> dict[str, DataFrame]:
    """Write metrics, scores, shared phrases and governed facts below ``out_dir`` and return them.

    ``pinned`` has the columns of :mod:`tidemark.operators.scores` plus ``value`` for numeric
    fields. Metrics are replaced as a whole; scores and phrases only for the method version of this
    run, so earlier versions stay for comparison. The same inputs always give the same rows, and a new build
    of the governed facts is written only if rows or rules are others than before.
    """
    scoring = scoring or config.SCORING
    spark = pinned.sparkSession
    numeric = pinned.where(F.col("value").isNotNull()).select(
        "company_id", "fy", F.col("field_key").alias("metric_key"), "value", "pin_id"
    )
    candidates = m.build_candidates(numeric.join(companies.select("company_id", "sector"), "company_id"))
    metrics = m.materialise(candidates, rules).withColumn(
        "lineage", F.col("contributing_pin_ids")
    ).drop("contributing_pin_ids")
    metrics.write.mode("overwrite").partitionBy("fy").parquet(f"{out_dir}/metrics")

    version = F.lit(scoring["method_version"])
    m.replace_partitions(s.score_rows(pinned, field_defs, scoring), f"{out_dir}/scores", "method_version")

    texts = pinned.join(field_defs.where("dtype = 'text'").select("field_key"), "field_key", "left_semi")
    words = scoring["substance"]["phrase_words"]
    threshold = scoring["substance"]["company_threshold"]
    shared = x.shared_phrases(texts, ["company_id", "fy", "field_key"], "company_id", "value_raw", threshold, words)
    shared = shared.withColumn("method_version", version)
    m.replace_partitions(shared, f"{out_dir}/shared_phrases", "method_version")
    out = {name: spark.read.parquet(f"{out_dir}/{name}") for name in ("metrics", "scores", "shared_phrases")}
    key = store.content([store.facts_of(out["metrics"], out["scores"]), companies], [rules, scoring])
    out["governed"] = store.FactStore(spark, f"{out_dir}/governed").ensure(
        key, lambda: store.dimensioned_facts(out["metrics"], out["scores"], companies)
    )
    return out
