"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution.

    On a cluster the submitter sets master, memory and shuffle partitions; only settings that
    change results (time zone) or that the operators count on (AQE, skew join) are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-code-")).resolve() / f"tidemark-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))


_BASES: dict[str, str] = {}


def _base(spark: SparkSession) -> str:
    """The application's own folder below the cluster's checkpoint folder; everything in it is scratch."""
    context = spark.sparkContext
    if context.applicationId not in _BASES:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tidemark-")
        _BASES[context.applicationId] = f"{base.rstrip('/')}/tidemark-{context.applicationId}"
        atexit.register(_at_exit, spark)
    return _BASES[context.applicationId]


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped before
        release(spark)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the application's folder, which ``release`` removes.

    The cluster names the place in ``spark.checkpoint.dir``. Only a local session may do without:
    it gets a temporary folder, which no executor on another machine could see.
    """
    return f"{_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def shared_place(spark: SparkSession, name: str) -> str:
    """The folder of that name below the application's folder, the same at every call."""
    return f"{_base(spark)}/{name}"


def release(spark: SparkSession) -> None:
    """Remove all staged tables and stream folders of the application; called at exit, or when results are written."""
    context = spark.sparkContext
    base = _BASES.pop(context.applicationId, None)
    if base and context._jsc is not None and context._jvm is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: worked out once, and safe from lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
