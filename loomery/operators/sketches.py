"""Distinct counts that can be kept and added up: one sketch per file or day, merged when asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_bound(lg: int, sigmas: float = 3) -> float:
    """The relative error of a merged count that so many standard deviations allow: 1.04 * 2 ** (-lg / 2) each."""
    return sigmas * 1.04 / 2 ** (lg / 2)


def distinct_sketches(df: DataFrame, by: Sequence[str], value: str, lg: int = 14) -> DataFrame:
    """(by.., sketch): a sketch of the distinct values of each key, at most some 2 ** lg bytes however many there are. Nulls
    are no values. Sketches are columns like others: write them, one part per file or day, and merge them later."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(value), F.lit(lg)).alias("sketch"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """(by.., sketch) of coarser keys; of one row without keys. Sketches of one day that were made twice count once."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))


def estimate(sketch: Column | str) -> Column:
    return F.hll_sketch_estimate(sketch)


def replaced(kept: DataFrame, new: DataFrame, *part: str) -> DataFrame:
    """Kept sketches with those of the parts in ``new`` in place of their older ones, so that a day can be done again."""
    return kept.join(new.select(*part).distinct(), list(part), "left_anti").unionByName(new)
