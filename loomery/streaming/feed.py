"""File feeds: new files through the batch operators, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomery.sources.ledger import folders


def feed(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Takes up what came since the last run, applies ``step`` and appends it to ``target``. The file sink's log makes
    each input file count once, also when a run breaks off."""
    rows = spark.readStream.schema(schema).format(format).load(source)
    return step(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def batches(spark: SparkSession, source: str, schema: str, write: Callable[[DataFrame, int], None], checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """The same for steps that need a batch whole (aggregates, joins of the batch with itself); ``write`` gets the batch
    and its number and must be repeatable for that number."""
    rows = spark.readStream.schema(schema).format(format).load(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the batches whose table is complete."""
    return sorted(int(f.split("/")[-2].removeprefix("version=")) for f in folders(spark, f"{target}/version=*/_SUCCESS"))


def running(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The table of running counts as the last batch, or the last before a number, left it; None before the first."""
    known = [v for v in _versions(spark, target) if before is None or v < before]
    return spark.read.parquet(f"{target}/version={known[-1]}") if known else None


def merge_counts(batch: DataFrame, number: int, by: list[str], value: str, target: str) -> None:
    """The running table (by.., n, total, least, most) with the rows of a batch. A batch's table is made from that of the one
    before and replaces what an earlier try at it has written, so a batch that comes again counts once. Tables of batches
    further back are deleted: what grows is the number of keys only."""
    spark = batch.sparkSession
    v = F.col(value).cast("long")
    new = batch.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))
    old = running(spark, target, number)
    if old is not None:
        new = old.unionByName(new).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    new.write.mode("overwrite").parquet(f"{target}/version={number}")
    for v in _versions(spark, target):
        if v < number - 1:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/version={v}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running_counts(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], by: list[str], value: str, target: str, checkpoint: str, format: str = "parquet", files: int | None = None) -> StreamingQuery:
    """Takes up the files that came since the last run, ``files`` of them to a batch, and merges the counts of ``step``'s rows
    into the running table."""
    rows = spark.readStream.schema(schema).format(format)
    rows = (rows.option("maxFilesPerTrigger", files) if files else rows).load(source)
    merge = lambda batch, number: merge_counts(step(batch), number, by, value, target)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
