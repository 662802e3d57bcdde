"""What model calls have answered, kept by key in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.sources.rounds import settled


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that fit a pattern, in order; none where nothing is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


TASKS = 2000  # at most so many tasks make the calls


class Ledger:
    """An append-only table of ``keys`` and ``replies`` (both as DDL) below ``folder``. Requests whose keys it holds are
    joined away before a model is called, so a second action, a retry of the job or a later run asks only what is not answered
    yet. Calls are made in one job, however many there are. Each task keeps what it was answered when it ends, so a run that
    breaks off loses the calls under way only: about ``portion`` for all tasks that run at a time, or, of very many requests,
    one in TASKS for each of them. A reply whose first column is null is a failed call: it is not kept and is asked again by the next
    run. Of two replies to one key, by runs at the same time, the one of the least run name counts."""

    def __init__(self, spark: SparkSession, folder: str, keys: str, replies: str, portion: int = 10_000):
        self.spark, self.folder, self.portion = spark, folder.rstrip("/"), portion
        self.keys = [f.name for f in T.StructType.fromDDL(keys).fields]
        self.replies = [f.name for f in T.StructType.fromDDL(replies).fields]
        self.schema = f"{keys}, {replies}"

    def known(self) -> DataFrame:
        """(keys.., replies..), each key once."""
        runs = folders(self.spark, f"{self.folder}/run=*")
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        # Runs are named one by one: Spark takes two scans of one folder for the same, also when it has grown between them.
        rows = self.spark.read.schema(f"{self.schema}, run string").option("basePath", self.folder).parquet(*runs)
        first = F.min_by(F.struct(*self.replies), "run").alias("r")
        return rows.groupBy(*self.keys).agg(first).select(*self.keys, "r.*")

    def ask(self, requests: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
        """``requests``, each key once, with their replies; requests without a reply are left out. ``model`` sees all columns of
        the requests and returns keys and replies."""
        wanted = settled(requests.dropDuplicates(self.keys))
        left = wanted.join(self.known().select(*self.keys), self.keys, "left_anti")
        n, slots = left.count(), self.spark.sparkContext.defaultParallelism
        if n:
            tasks = -(-n // max(1, self.portion // slots, -(-n // TASKS)))
            answered = left.repartition(tasks, *self.keys).mapInPandas(model, self.schema).where(F.col(self.replies[0]).isNotNull())
            # By this algorithm a task's file is in its place when the task ends, whatever becomes of the others.
            answered.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.folder}/run={uuid.uuid4().hex}")
        return wanted.join(self.known(), self.keys)
