"""Choosing rows, records, paths and columns by what a caller names; what is not named leaves all."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import to_number


def where_given(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows whose columns equal all the values that are given; plain comparisons, so they reach partitions and scans."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def holding_both(values: DataFrame, by: Sequence[str], first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """The records of values (by.., path, id) that have one id at one path and another at another. One shuffle."""
    at = lambda of: F.bool_or((F.col("path") == of[0]) & (F.col("id") == of[1]))
    found = values.where(F.col("path").isin(first[0], second[0])).groupBy(*by).agg(at(first).alias("a"), at(second).alias("b"))
    return found.where("a and b").select(*by)


def where_number(leaves: DataFrame, path: str, number: float, doc: str) -> DataFrame:
    """The documents whose value at the path is that number."""
    return leaves.where((F.col("path") == path) & (to_number(F.col("value")) == number)).select(doc).distinct()


def names(all_: Iterable[str], only: Iterable[str] | None = None, skip: Iterable[str] = ()) -> list[str]:
    """Columns, categories or paths, those in ``only`` if given and none in ``skip``, in their order."""
    kept, gone = None if only is None else set(only), set(skip)
    return [n for n in all_ if (kept is None or n in kept) and n not in gone]


def linked_or_raw(linked: Column, raw: Column) -> Column:
    """The linked record where there is one."""
    return F.coalesce(linked, raw)
