"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder: ``spark.checkpoint.dir``. Where it is unset, a temporary folder in
    local mode; elsewhere an error, as a machine-local folder would lose rows."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="spark-loomery-")
    return f"file://{_local}"


_local: str | None = None


def stash(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back. Later stages start from the files, so a
    lost executor costs no more than its own tasks. The files go when the session's JVM ends."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, df.write))


def stash_parts(df: DataFrame, part: Column, parts: int) -> tuple[DataFrame, Callable[[int], None]]:
    """A stash cut by ``part``, a number below ``parts``: the rows with their ``part``, of which a reader that asks for some
    reads those files only, and what deletes a part's files once nothing reads them any more."""
    spark = df.sparkSession
    with _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(parts + 1)):  # no sort by part
        marked = df.withColumn("part", part.cast("int"))
        path = _written(df, marked.write.partitionBy("part"))
    rows = spark.read.schema(marked.schema).option("basePath", path).parquet(path)
    return rows, lambda i: _delete(spark, f"{path}/part={i}")


class Appended:
    """A table in the shared folder that is written in turns."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.turns = spark, schema, 0
        self.path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/turn={self.turns}")
        system, target = _file(self.spark, self.path)
        system.deleteOnExit(target)
        self.turns += 1

    def read(self) -> DataFrame:
        if not self.turns:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(f"{self.schema}, turn int").parquet(self.path).drop("turn")


def stash_last(df: DataFrame) -> DataFrame:
    """A stash of ``df`` that takes the shuffles it was made from off the disks."""
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return stash(df)


def _written(df: DataFrame, writer: DataFrameWriter) -> str:
    path = f"{shared_folder(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    writer.parquet(path)
    system, target = _file(df.sparkSession, path)
    system.deleteOnExit(target)
    return path


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    system, target = _file(spark, path)
    system.delete(target, True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Bounds the Arrow batches that Python workers get, as one text may be megabytes long."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": mb << 20}
    for key, most in limits.items():
        if int(_plain(spark.conf.get(key, "2147483647"))) > most:
            spark.conf.set(key, str(most))


def _plain(size: str) -> str:
    return "2147483647" if not size.lstrip("-").isdigit() or int(size) <= 0 else size
