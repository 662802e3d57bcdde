"""Counts of hits and misses to precision, recall and F1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp and fn; 0 where undefined."""
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def micro(counts: DataFrame, *by: str) -> DataFrame:
    """Sums tp, fp and fn over documents, by some columns, and rates the sums."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    return prf(counts.groupBy(*by).agg(*sums))


def macro(scores: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Means of scores over documents, by some columns; 0 where there are none."""
    return scores.groupBy(*by).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def by_category(counts: DataFrame, category: str) -> DataFrame:
    """Micro ratings of each category and, as "overall", of all; one shuffle."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    rolled = counts.rollup(category).agg(*sums, F.grouping(category).alias("g"))
    return prf(rolled.select(F.when(F.col("g") == 1, "overall").otherwise(F.col(category)).alias(category), "tp", "fp", "fn"))


def weighted(df: DataFrame, reference: Column, predicted: Column) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 of each reference label weighted by its frequency."""
    cells = df.groupBy(reference.alias("ref"), predicted.alias("pred")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("ref").alias("label"), F.col("n").alias("ref_n"), F.lit(0).cast("long").alias("pred_n"), F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("ref_n"), F.col("n").alias("pred_n"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    label = sides.groupBy("label").agg(F.sum("tp").alias("tp"), (F.sum("pred_n") - F.sum("tp")).alias("fp"), (F.sum("ref_n") - F.sum("tp")).alias("fn"), F.sum("ref_n").alias("support"))
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return prf(label).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), mean("precision"), mean("recall"), mean("f1"))


def accuracy(df: DataFrame, right: Column, category: str) -> DataFrame:
    """Share of exact matches by category and, as "overall", of all."""
    rolled = df.select(F.col(category).cast("string").alias(category), right.cast("int").alias("right")).rollup(category).agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"), F.grouping(category).alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "overall").otherwise(F.col(category)).alias(category), "n", "accuracy")
