"""Joins in which a key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.spill import stash

KEYS = 10_000  # at most so many keys are split
_LEAST = 500


def share(rows: int) -> int:
    """Rows that one task takes of one key; fewer than KEYS keys can have more."""
    return max(_LEAST, -(-rows // KEYS))


def split_join(many: DataFrame, one: DataFrame, key: str | list[str], counts: DataFrame, rows: int, salt: Column, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` on ``key``, which ``one`` holds once. Keys with more than the share of ``rows``, as
    ``counts`` (key, n) has them, are dealt by ``salt`` to several tasks, each of which gets the row of ``one``. The list of
    these keys, below KEYS rows whatever the data, is broadcast."""
    most, keys = share(rows), [key] if isinstance(key, str) else key
    hot = counts.where(F.col("n") > most).select(*(F.col(k).alias(f"__{k}") for k in keys), F.ceil(F.col("n") / most).cast("int").alias("__pieces"))
    hot = stash(hot)
    pieces = F.coalesce("__pieces", F.lit(1))

    def marked(df: DataFrame, place: Column) -> DataFrame:
        out = df.join(F.broadcast(hot), [df[k] == hot[f"__{k}"] for k in keys], "left").withColumn("__salt", place)
        return out.drop("__pieces", *(f"__{k}" for k in keys))

    # Rows without a key match nothing and go anywhere.
    left = marked(many, F.pmod(F.xxhash64(salt), F.when(many[keys[0]].isNull(), KEYS).otherwise(pieces)).cast("int"))
    right = marked(one, F.explode(F.sequence(F.lit(0), pieces - 1)))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
