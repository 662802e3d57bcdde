"""Writing results: documents, wide tables, triples; and runs that can be taken up again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_documents(df: DataFrame, root: str, *by: str) -> None:
    """JSON lines below ``root``, partitioned by the given columns."""
    df.write.partitionBy(*by).mode("append").option("ignoreNullFields", True).json(root)


def wide(leaves: DataFrame, by: Sequence[str], paths: Sequence[str] | None = None, sep: str = ", ", missing: str | None = "", most: int = 2000) -> DataFrame:
    """One row per record, one column per named path in order, values of a repeated path joined in order of ``nth``. One
    aggregation by record gathers its leaves, none of which is exchanged where they are already dealt by record; the cells
    are cut from their sorted list. Without ``paths`` one pass
    finds them; more than ``most`` are no table and an error."""
    if paths is None:
        paths = [r[0] for r in leaves.select("path").distinct().limit(most + 1).collect()]
        if len(paths) > most:
            raise ValueError(f"more than {most} paths: name those to be columns")
    leaf = F.struct("path", "nth", F.coalesce("value", F.lit("")).alias("v"))
    rows = leaves.where(F.col("path").isin(*paths)).groupBy(*by).agg(F.array_sort(F.collect_list(leaf)).alias("all"))
    new = lambda i: F.when(i == 0, True).otherwise(F.get("all", i).path != F.get("all", i - 1).path)
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("all")), lambda i: F.coalesce(new(i), F.lit(True))))  # and the end
    text = lambda i, k: F.array_join(F.transform(F.slice("all", i + 1, F.get("starts", k + 1) - i), lambda x: x.v), sep)
    cells = F.transform(F.slice("starts", 1, F.size("starts") - 1), lambda i, k: F.struct(F.get("all", i).path, text(i, k)))
    rows = rows.select(*by, F.map_from_entries(cells).alias("cells"))
    cell = lambda p: F.try_element_at("cells", F.lit(p))
    return rows.select(*by, *[(cell(p) if missing is None else F.coalesce(cell(p), F.lit(missing))).alias(p) for p in sorted(paths)])


def flat_export(leaves: DataFrame, meta: Sequence[str], paths: Sequence[str], sep: str = "; ") -> DataFrame:
    """Records with their meta columns and a column per path; a path that is named like a meta column comes as
    ``process.`` and its name."""
    cells = wide(leaves, meta, paths, sep)
    taken = set(meta)
    if not taken & set(paths):
        return cells
    renamed = leaves.withColumn("path", F.when(F.col("path").isin(*taken), F.concat(F.lit("process."), F.col("path"))).otherwise(F.col("path")))
    return wide(renamed, meta, [f"process.{p}" if p in taken else p for p in paths], sep)


def parsed_or_rejects(raw: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Raw JSON texts with a VARIANT ``v``, and the rows that can't be read."""
    made = raw.withColumn("v", F.try_parse_json(text))
    return made.where("v is not null"), made.where("v is null").drop("v")


#: What a table of ratings must have.
RATINGS = {"tp": "bigint", "fp": "bigint", "fn": "bigint", "precision": "double", "recall": "double", "f1": "double"}


def write_ratings(df: DataFrame, path: str) -> None:
    """Ratings as JSON, after a look at their shape: columns, kinds, and no rate outside 0 to 1."""
    kinds = dict(df.dtypes)
    wrong = [c for c, kind in RATINGS.items() if kinds.get(c) != kind]
    if wrong:
        raise ValueError(f"no ratings: {', '.join(wrong)}")
    if df.where(" or ".join(f"{c} is null or {c} not between 0 and 1" for c in ("precision", "recall", "f1"))).limit(1).count():
        raise ValueError("a rate is missing or outside 0 to 1")
    df.write.mode("overwrite").json(path)


def same_as(values: DataFrame, subject: Column) -> DataFrame:
    """(subject, predicate, object, datatype) edges from linked values (path, ids)."""
    rows = values.select(F.sha2(subject.cast("string"), 256).alias("subject"), F.concat("path", F.lit(".sameAs")).alias("predicate"), F.explode("ids").alias("object"))
    return rows.select("subject", "predicate", "object", F.lit("iri").alias("datatype"))


def triples(leaves: DataFrame, subject: Column) -> DataFrame:
    """(subject, predicate, object, datatype) of flattened leaves; null leaves say nothing."""
    value = F.col("value")
    kind = F.when(value.rlike(r"^-?\d+$"), "integer").when(value.rlike(r"^-?\d+\.\d*([eE][+-]?\d+)?$"), "decimal").when(value.isin("true", "false"), "boolean").when(value.rlike("^https?://"), "iri").otherwise("string")
    return leaves.where(value.isNotNull()).select(F.sha2(subject.cast("string"), 256).alias("subject"), F.col("path").alias("predicate"), value.alias("object"), kind.alias("datatype"))


def remaining(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What a run that was broken off has still to do."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in order."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__nth = 1").drop("__nth")
