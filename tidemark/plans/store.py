"""Governed facts as a table, so that a query reads the rows of its measures and years and nothing else.

A build holds the metrics and the scores of the newest method version with the company's dimensions on
every row, in one folder per measure, ordered by year so that row groups of other years are skipped.
Builds are known by the hash of what they were made from; a manifest names the folder of each hash and gets
its line only after the whole build is written, so a reader never sees half of one and two writers do no harm.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans import semantic

MANIFEST = "fingerprint string, folder string, columns string"


def fingerprint(spark: SparkSession, paths: Sequence[str], settings: Any) -> str:
    """Hash of the settings and of name, length and time of every file below the paths; no content is read.

    Files are added up as a multiset, so the order of the listing does not matter. A file that is
    rewritten counts as new, also where its bytes stay the same.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    state = files.agg(F.count(F.lit(1)), F.sum(each)).first()
    return _hash([sorted(paths), settings, state])


def content(tables: Sequence[DataFrame], settings: Any) -> str:
    """Hash of the settings and of all rows of the tables, in any order: one pass over each, combined on the map side.

    Unlike :func:`fingerprint` it is the same for tables that were worked out again with the same rows.
    """
    states = []
    for table in tables:
        each = F.xxhash64(*table.columns).cast("decimal(38,0)")
        states.append([table.dtypes, table.agg(F.count(F.lit(1)), F.sum(each)).first()])
    return _hash([states, settings])


def _hash(state: Any) -> str:
    return hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()


def dimensioned_facts(metrics: DataFrame, scores: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows of the store: measure, fy, company_id, value, pin_id and the columns of ``companies``.

    A fact whose company is unknown is in no answer and not in the store. Rows without a value or a
    year stay. ``companies`` has one row per company_id.
    """
    return facts_of(metrics, scores).join(companies, "company_id")


def facts_of(metrics: DataFrame, scores: DataFrame) -> DataFrame:
    """Metrics and newest scores as one table, without the company's columns."""
    columns = ("company_id", "fy", "value", "pin_id")
    return metrics.select(F.col("metric_key").alias("measure"), *columns).unionByName(
        semantic.newest_scores(scores).select(F.col("score_key").alias("measure"), *columns)
    )


class FactStore:
    """The builds below one folder, which all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def find(self, key: str) -> DataFrame | None:
        """The facts of the build with that hash, or None."""
        manifest = self._manifest()
        if manifest is None:
            return None
        known = manifest.where(F.col("fingerprint") == key).orderBy("folder").first()
        if known is None:
            return None
        schema = StructType.fromJson(json.loads(known.columns))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{known.folder}")

    def publish(self, key: str, facts: DataFrame) -> DataFrame:
        """Write a build and name it in the manifest.

        Rows are rebalanced by measure: AQE writes a small folder as one file and cuts a large one by size,
        so that no measure is the work of one task. Each file is ordered by year.
        """
        folder = f"facts-{uuid.uuid4().hex}"
        rows = facts.hint("rebalance", F.col("measure")).sortWithinPartitions("measure", "fy", "company_id")
        rows.write.partitionBy("measure").parquet(f"{self.path}/{folder}")
        line = [(key, folder, facts.schema.json())]
        self.spark.createDataFrame(line, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        found = self.find(key)
        assert found is not None
        return found

    def ensure(self, key: str, facts: Callable[[], DataFrame]) -> DataFrame:
        """The build with that hash; ``facts`` is called, and its rows are written, only if there is none."""
        found = self.find(key)
        return found if found is not None else self.publish(key, facts())


def answer(facts: DataFrame, spec: dict[str, Any], tier: str, catalog: semantic.Catalog) -> semantic.Result:
    """A governed query over a build: no join, and at most one exchange for each of its measures."""
    return semantic.compile_query(
        lambda key: facts.where(F.col("measure") == key).drop("measure"), spec, tier, catalog
    )
