"""What every plan needs from the session: tables, shared scratch space, importable workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: What goes to a Python worker at once, unless the session says otherwise: texts are long,
#: and a batch lies in memory on both sides.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``, whatever file system that is on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the path the driver has it on, and bound their batches.

    On a cluster the package is installed or sent with ``--py-files``; there the extra
    entry of PYTHONPATH does nothing.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for key, value in ARROW_BATCH.items():
        if spark.conf.get(key) == _default(spark, key):
            spark.conf.set(key, value)


def _default(spark: SparkSession, key: str) -> str:
    conf = spark._jvm.org.apache.spark.sql.internal.SQLConf()
    return conf.getConfString(key)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent (tests, local runs) a temporary folder takes its
    place; it goes when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_base: list[str] = []


def _local_base() -> str:
    if not _base:
        _base.append(tempfile.mkdtemp(prefix="claimloom-"))
        atexit.register(shutil.rmtree, _base[0], True)
    return "file://" + _base[0]


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared scratch space once and go on from the written table.

    The lineage ends there: a lost executor costs a re-read, not a recomputation.
    """
    return keep(df, scratch(df.sparkSession, name), **options)


def keep(df: DataFrame, path: str, **options) -> DataFrame:
    """As ``stored``, at a path that the caller may drop once nothing reads it any more."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete their shuffle files when they end, instead of when the driver happens to collect them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Rounds:
    """Tables of the rounds of a loop: writing one drops the one before, which nothing needs any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.last = spark, name, None

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, self.name)
        out = keep(df, path)
        if self.last is not None:
            drop_path(self.spark, self.last)
        self.last = path
        return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())
