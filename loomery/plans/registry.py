"""All queries on the reference tables with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.plans import annotations, jobs, linking, mechanisms, profiles, records, scoring, texts

_ALL = scoring.QUERIES | texts.QUERIES | records.QUERIES | linking.QUERIES | jobs.QUERIES | profiles.QUERIES | annotations.QUERIES | mechanisms.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.set_match_micro(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
