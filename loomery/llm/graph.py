"""Connected components by passing least labels, without gathering the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import skew
from loomery.llm.spill import stash


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the least id that it reaches. In each round an id takes the least
    label among its own and its neighbours'; from the fourth round on also that label's own label, so that the rounds grow
    with the logarithm of a path's length. Each round is written to the shared folder; the driver sees one sum, which stays
    the same once no label falls. An id with very many neighbours, or a label of very many ids, is split over tasks."""
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    start = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("n")).select(F.col("a").alias("id"), "label", "n"))
    size, links = start.count(), both.count()
    degrees, labels = start.select(F.col("id").alias("b"), "n"), start.select("id", "label")
    total, turn = None, 0
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels.select("id", F.col("label").alias("component"))
        total, turn = now, turn + 1
        told = skew.split_join(both, labels.withColumnRenamed("id", "b"), "b", degrees, links, F.col("a")).select(F.col("a").alias("id"), "label").union(labels)
        if turn > 3:
            own = labels.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
            held = labels.groupBy("label").agg(F.count("*").alias("n"))
            told = told.union(skew.split_join(labels, own, "label", held, size, F.col("id")).select("id", F.col("beyond").alias("label")))
        labels = stash(told.groupBy("id").agg(F.min("label").alias("label")))
