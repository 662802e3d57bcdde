"""Joins in which a key may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.sources.rounds import settled

KEYS = 10_000  # at most so many keys are split
_LEAST = 500


def share(rows: int) -> int:
    """Rows that one task takes of one key; fewer than KEYS keys can have more."""
    return max(_LEAST, -(-rows // KEYS))


def split_join(many: DataFrame, one: DataFrame, key: str | Sequence[str], salt: Column, how: str = "inner", most: int | None = None) -> DataFrame:
    """``many`` joined with ``one`` on ``key``. Keys with more than ``most`` rows in ``many`` (by default their share) are
    dealt by ``salt`` to several tasks, each of which gets a copy of the rows of ``one``. The list of these keys, below KEYS
    rows whatever the data, is broadcast. ``how``: inner, left, left_semi or left_anti."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = settled(many.groupBy(*keys).agg(F.count("*").alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    bound = max(most or share(total), -(-total // KEYS))
    hot = settled(counts.where(F.col("__n") > bound).select(*(F.col(k).alias(f"__{k}") for k in keys), F.ceil(F.col("__n") / bound).cast("int").alias("__pieces")))
    if hot.isEmpty():
        return many.join(one, keys, how)
    pieces = F.coalesce("__pieces", F.lit(1))

    def marked(df: DataFrame, place: Column) -> DataFrame:
        out = df.join(F.broadcast(hot), [df[k] == hot[f"__{k}"] for k in keys], "left").withColumn("__salt", place)
        return out.drop("__pieces", *(f"__{k}" for k in keys))

    # Rows without a key match nothing and go anywhere.
    left = marked(many, F.pmod(F.xxhash64(salt), F.when(many[keys[0]].isNull(), KEYS).otherwise(pieces)).cast("int"))
    right = marked(one, F.explode(F.sequence(F.lit(0), pieces - 1)))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def join_apart(many: DataFrame, one: DataFrame, key: str, value: str, salt: Column, most: int) -> DataFrame:
    """``many`` with the ``value`` that ``one`` has for its ``key``, null without any; ``one`` has a key once. For long values
    that many rows share: keys with more than ``most`` rows are dealt by ``salt`` in pieces, and a piece is a task of its own,
    which puts out one value. A Parquet writer looks at its buffers after as many rows as would fill them if rows stayed as
    long as before, up to 10,000; where long values follow short ones, or ones that it keeps once, it holds them all till then.

    A join's hash would put several keys in a task, so rows and values are put together by ranges of the key and its piece."""
    counts = settled(many.groupBy(key).agg(F.count("*").alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    bound = max(most, -(-total // KEYS))
    hot = settled(counts.where(F.col("__n") > bound).select(F.col(key).alias("__hot"), F.ceil(F.col("__n") / bound).cast("int").alias("__pieces")))
    if hot.isEmpty():
        return many.join(one.select(key, value), key, "left")
    pieces = F.coalesce("__pieces", F.lit(1))

    def marked(df: DataFrame, place: Column) -> DataFrame:
        out = df.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", place)
        return out.withColumn("__few", F.col("__pieces").isNull()).drop("__hot", "__pieces")

    # Rows without a key match nothing and go anywhere. A piece has half the bound or more, and so fills a range.
    left = marked(many, F.pmod(F.xxhash64(salt), F.when(F.col(key).isNull(), KEYS).otherwise(pieces)).cast("int")).withColumn("__asks", F.lit(True))
    right = marked(one.select(key, value).where(F.col(key).isNotNull()), F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("__asks", F.lit(False))
    place = ["__few", key, "__salt"]
    both = left.unionByName(right, allowMissingColumns=True).repartitionByRange(-(-2 * total // bound), *place)
    met = both.withColumn(value, F.first(value, ignorenulls=True).over(Window.partitionBy(*place)))
    return met.where("__asks").drop("__asks", "__few", "__salt")
