"""Dataset exports and partitioned tables."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LICENCE = {
    "licence": "Aggregate research use; see the licence terms",
    "methodology": "/methodology",
    "licence_terms": "/licence",
}


def _sidecar(df: DataFrame, path: str, licence: dict[str, str]) -> None:
    """Licence text next to the data, for readers that look at no comments and no column metadata."""
    spark = df.sparkSession
    note = spark.range(1).select(F.lit(json.dumps(licence, sort_keys=True)).alias("value"))
    note.coalesce(1).write.mode("overwrite").text(f"{path}_licence")


def with_licence(df: DataFrame, licence: dict[str, str] = LICENCE) -> DataFrame:
    """The same columns, each carrying the licence in its metadata (kept by Parquet)."""
    return df.select(*[F.col(name).alias(name, metadata=licence) for name in df.columns])


def write_licensed_csv(df: DataFrame, path: str, licence: dict[str, str] = LICENCE) -> None:
    """CSV files that begin with the licence as comment lines and the column names.

    Every task writes its own file, and every file has the lines, so that a file keeps its licence when it is passed on
    alone. Rows are formatted in the JVM; Python only puts the lines before the first of them. Read back with
    ``comment='#', header=True``. Nulls are empty and empty texts are ``""`` (Spark's reader takes both for
    null), a first value that begins with ``#`` is quoted; texts with line breaks need ``multiLine``. A table without partitions gives no file with lines.
    """
    names = io.StringIO()
    csv.writer(names, lineterminator="").writerow(df.columns)
    notes = [f"# {line}" for key, value in licence.items() for line in f"{key}: {value}".splitlines()]
    head = [*notes, names.getvalue()]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": pa.array(head, pa.string())})
        yield from batches

    plain = {"comment": "#", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.to_csv(F.struct(*[F.col(f"`{name}`") for name in df.columns]), plain)
    df.select(line.alias("value")).mapInArrow(begin, "value string").write.mode("overwrite").text(path)


def write_dataset(df: DataFrame, path: str, kind: str, licence: dict[str, str] = LICENCE) -> None:
    """Public aggregate as CSV or Parquet (snappy) with its licence."""
    if kind == "csv":
        write_licensed_csv(df, path, licence)
    elif kind == "parquet":
        with_licence(df, licence).write.mode("overwrite").option("compression", "snappy").parquet(path)
    else:
        raise ValueError("supported formats: csv, parquet")
    _sidecar(df, path, licence)


def table_twin(rows: DataFrame, label: str, measure: str) -> DataFrame:
    """Export columns of a plotted result: label, value, cohort size, thin flag."""
    return rows.select(
        F.col("label").alias(label),
        F.col("value").alias(measure),
        "cohort_n",
        F.when(F.col("thin_cohort"), "true").otherwise("false").alias("below_minimum_cohort"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_events_by_month(events: DataFrame, path: str) -> None:
    """Events under one folder per month; only months present in the input are replaced.

    Rows go to tasks by month and day, so that a busy month is written by many tasks.
    """
    monthly = events.withColumn("month", F.date_format("ts", "yyyy-MM"))
    (
        monthly.repartition("month", F.dayofmonth("ts"), F.hour("ts"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )
