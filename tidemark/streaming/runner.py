"""Running streams over what is available now, with results kept per micro-batch."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.session import shared_dir

BatchWriter = Callable[[DataFrame, int], None]

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream.

    ``files_per_batch`` bounds a micro-batch, and with it what a stateful task holds at once.
    """
    path = path.rstrip("/")
    any_kind = f"{path[:-1]}[{path[-1]}]"  # as a pattern of this one name, which may then be a file too
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(any_kind)


@contextlib.contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB, which typed state and timers need and memory does not bound."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_available(stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there now, then stop. Restarts go on from the checkpoint."""
    with state_on_disk(stream.sparkSession):
        query = _started(stream, write, checkpoint, mode)
    query.awaitTermination()


def _started(stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def batch_folder(path: str) -> BatchWriter:
    """Writer with one folder per batch id: a batch that is run again replaces its own rows."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def nothing_yet(spark: SparkSession, schema: StructType, path: str, partition: str = "batch") -> None:
    """An empty first part, so that the table can be read when no batch has been written."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{partition}=-1")


def collected(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Rows of all micro-batches, with their ``batch`` number."""
    spark = stream.sparkSession
    folder = shared_dir(spark, purpose)
    nothing_yet(spark, stream.schema, f"{folder}/rows")
    run_available(stream, batch_folder(f"{folder}/rows"), f"{folder}/checkpoint", mode)
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def last_update(rows: DataFrame, *keys: str) -> DataFrame:
    """Current state of an update-mode result: per key the row of its last batch."""
    from tidemark.operators.ranking import first_per_key

    return first_per_key(rows, list(keys), F.desc("batch")).drop("batch")
