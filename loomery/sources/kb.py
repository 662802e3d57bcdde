"""The synonym knowledge base and curated dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_synonyms(spark: SparkSession, path: str, on_duplicate: str = "last") -> DataFrame:
    """(synonym, id) from tab-separated ``id synonym`` lines. The last line of a synonym stands, by file and place, or all
    do ("all")."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("place"))
    return parse_synonyms(lines, on_duplicate)


def parse_synonyms(lines: DataFrame, on_duplicate: str = "last") -> DataFrame:
    """The same from (value, place)."""
    cells = F.split(F.trim("value"), "\t")
    rows = lines.where(F.size(cells) == 2).select(F.trim(cells[0]).alias("id"), F.trim(cells[1]).alias("synonym"), "place").where("id <> '' and synonym <> ''")
    if on_duplicate == "all":
        return rows.select("synonym", "id").distinct()
    return rows.groupBy("synonym").agg(F.max_by("id", "place").alias("id"))


def store(kb: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Bucketed by synonym, so that lookups need no shuffle of the large side; below ``path`` if given, else in the
    warehouse."""
    writer = kb.write.bucketBy(buckets, "synonym").sortBy("synonym").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def curated(json: Column) -> Column:
    """A JSON object ``{synonym: "id[, id]"}`` as an array of (synonym, id)."""
    pairs = F.map_entries(F.from_json(json, "map<string,string>"))
    return F.flatten(F.transform(pairs, lambda e: F.transform(F.split(e.value, ","), lambda i: F.struct(e.key.alias("synonym"), F.trim(i).alias("id")))))
