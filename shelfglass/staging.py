"""Intermediate tables in the shared folder, used to cut lineage in iterative jobs.

A staged frame is a written Parquet table read back. It survives the loss of executors, and the
planner sees its true size, so AQE and the broadcast threshold decide on measured bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_written: list[str] = []


def stage_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only for local masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="shelfglass-")
    return _local_roots[app]


# Methods above 8000 bytes of bytecode are never compiled by the JVM's JIT. Plans with many
# numeric columns pass that easily and then run interpreted, ten times slower or worse.
_METHOD_LIMIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# A staged table is read from its files, so its shuffles are of no use once it is written.
_SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Texts go to Python workers in batches of so many bytes: each is held by the JVM and by the worker.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def compiled_plans(spark: SparkSession):
    """Let Spark split up generated methods the JIT would refuse, while the block runs."""
    return _settings(spark, _METHOD_LIMIT)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for files that ``drop_stages`` deletes."""
    _written.append(f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def stage(df: DataFrame, label: str = "stage", *, small_batches: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back; its shuffle files go.
    ``small_batches`` is for plans that hand texts to Python workers."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with _settings(spark, _METHOD_LIMIT | _SHUFFLES_GO | (SMALL_BATCHES if small_batches else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Tasks for work that is heavy on small tables: one per core of the cluster."""
    return spark.sparkContext.defaultParallelism


def drop_stages(spark: SparkSession) -> int:
    """Delete the tables this process staged. Call it only when no result reads them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    dropped = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped
