"""Connected components in rounds of joins, each round written to the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.skewed import split_join
from loomery.sources.rounds import settled


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the least id that it reaches. An id takes the least label of its
    neighbours, then that label's own label, so a path is halved in each round. An id with very many neighbours, or a label
    of very many ids, is dealt over several tasks."""
    edges = settled(edges.select("a", "b"))
    both = settled(edges.union(edges.select("b", "a")).where("a <> b").distinct())
    alone = edges.where("a = b").select(F.col("a").alias("id")).distinct()
    labels = settled(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"))
    total = None
    while (now := labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]) != total:
        total = now
        near = split_join(both, labels.withColumnRenamed("id", "b"), "b", F.col("a")).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        step = settled(labels.join(near, labels.id == near.a, "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label")))
        labels = settled(split_join(step, own, "label", F.col("id"), "left").select("id", F.least("label", F.coalesce("beyond", "label")).alias("label")))
    rest = alone.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    return labels.select("id", F.col("label").alias("component")).union(rest)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of links between 0 .. n-1 the places of some that join all that they join, without circles: fewer than n."""
    label, kept, at = np.arange(n), [], np.arange(len(i))
    while len(at):
        a, b = label[i[at]], label[j[at]]
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        if not len(at):
            break
        high, first = np.unique(np.maximum(a, b), return_index=True)  # each label joins one lower label
        kept.append(at[first])
        to = np.arange(n)
        to[high] = np.minimum(a, b)[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)
