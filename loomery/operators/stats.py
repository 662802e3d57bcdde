"""Statistics over flattened records: coverage, frequencies, ranges, pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.text import holds_any, present, to_number


def property_statistics(leaves: DataFrame, doc: str = "doc", skip: list[str] | None = None, list_most: int = 0) -> DataFrame:
    """Per path: documents with a value, occurrences, distinct texts and the numbers' range. Leaves are
    counted by document first, without an exchange where they are dealt by document, and texts by path; neither is gathered. With ``list_most``, paths of at most so many distinct
    texts also list them, sorted; others have a null list."""
    kept = leaves.where(present(F.col("value")) & ~holds_any(F.col("path"), skip or [])).withColumn("x", to_number(F.col("value")))
    of_doc = kept.groupBy(doc, "path").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    counts = of_doc.groupBy("path").agg(F.count(doc).alias("docs"), F.sum("n").alias("occurrences"), F.min("least").alias("least"), F.max("most").alias("most"))
    texts = kept.where("x is null").select("path", F.col("value").alias("text")).distinct()
    n_texts = texts.groupBy("path").agg(F.count("*").alias("n"))
    df = counts.join(n_texts, "path", "left").select("path", "docs", "occurrences", F.coalesce("n", F.lit(0)).alias("distinct_texts"), "least", "most")
    return _with_texts(df, texts, list_most) if list_most else df


def _with_texts(df: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    few = df.where(F.col("distinct_texts") <= most).select("path")
    listed = texts.join(few, "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    none = F.when(F.col("distinct_texts") <= most, F.array().cast("array<string>"))
    return df.join(listed, "path", "left").withColumn("texts", F.coalesce("texts", none))


def document_frequency(values: DataFrame, doc: str, value: str) -> DataFrame:
    """In how many documents each value stands, most first."""
    return values.groupBy(value).agg(F.count_distinct(doc).alias("docs")).orderBy(F.desc("docs"), value)


def coverage_per_record(leaves: DataFrame, *by: str, skip: list[str] | None = None) -> DataFrame:
    """How many leaves of each record are given."""
    return leaves.groupBy(*by).agg(F.count_if(present(F.col("value")) & ~holds_any(F.col("path"), skip or [])).alias("n"))


def counts_pivot(df: DataFrame, row: str, column: Column, columns: list[str]) -> DataFrame:
    """Counts by row and column, 0 where there are none. The columns are named, so no pass is spent on finding them."""
    return df.groupBy(row).agg(*[F.count_if(column == c).alias(c) for c in columns])


def numbered(df: DataFrame, by: Column, order: Column, key: Column) -> Column:
    """``key``, ``key_2``, ...: repeated keys told apart."""
    n = F.row_number().over(Window.partitionBy(by, key).orderBy(order))
    return F.when(n == 1, key).otherwise(F.concat(key, F.lit("_"), n.cast("string")))


def extraction_statistics(processes: DataFrame, model: str, paper: str, n: str) -> DataFrame:
    """Per model, from one row per process with its ``n`` properties (null for a paper without any process): processes in
    all, their mean and most by paper, and the mean number of properties."""
    papers = processes.groupBy(model, paper).agg(F.count(n).alias("k"), F.sum(n).alias("p"))
    sums = papers.groupBy(model).agg(F.sum("k").alias("processes"), F.avg("k").alias("by_paper"), F.max("k").alias("most"), F.sum("p").alias("p"))
    return sums.select(model, "processes", F.round("by_paper", 2).alias("mean_by_paper"), F.col("most").alias("most_in_paper"), F.round(F.coalesce(F.try_divide("p", "processes"), F.lit(0.0)), 2).alias("mean_properties"))


def property_frequency(leaves: DataFrame, only: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """How often each path stands, most first; of paths that hold one of ``only``, if given, and none of ``skip``."""
    named = leaves.where((holds_any(F.col("path"), only) if only else F.lit(True)) & ~holds_any(F.col("path"), skip or []))
    return named.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path")


def relation_statistics(documents: DataFrame, variant: str, n: str, variants: list[str]) -> DataFrame:
    """Per variant of a list: relations in all, and mean, least and most by document; zeros where it has no document."""
    listed = documents.sparkSession.createDataFrame([(v,) for v in variants], f"{variant} string")
    sums = documents.groupBy(variant).agg(F.sum(n).alias("total"), F.round(F.avg(n), 2).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))
    zero = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    return listed.join(sums, variant, "left").select(variant, zero("total", "long"), zero("mean", "double"), zero("least", "long"), zero("most", "long"))


def dataset_profile(mentions: DataFrame, split: str, kind: str, doc: str, identifier: str, novel: Column | None = None) -> DataFrame:
    """By split and type, and by split over all types ("all"): documents, mentions, distinct ids and the share of novel
    ones. No row is copied: mentions are counted by document, ids are made distinct, and what is left is counted twice."""
    new = (novel if novel is not None else F.lit(False)).cast("int")
    of_doc = mentions.groupBy(split, kind, F.col(doc).alias("__key")).agg(F.count("*").alias("__n"), F.sum(new).alias("__new"), F.count(new).alias("__told"))
    of_id = mentions.select(split, kind, F.col(identifier).alias("__key")).distinct()

    def counted(rows: DataFrame, name: str, *sums: str) -> DataFrame:
        add, key = [F.sum(c).alias(c) for c in sums], F.count("__key").alias(name)
        each = rows.groupBy(split, kind).agg(key, *add).withColumn("__all", F.lit(False))
        once = rows.groupBy(split, "__key").agg(*add) if add else rows.select(split, "__key").distinct()
        over = once.groupBy(split).agg(key, *add).withColumns({kind: F.lit(None).cast(mentions.schema[kind].dataType), "__all": F.lit(True)})
        return each.unionByName(over)

    a, b = counted(of_doc, "docs", "__n", "__new", "__told"), counted(of_id, "ids").select(F.col(split).alias("__s"), F.col(kind).alias("__k"), F.col("__all").alias("__a"), "ids")
    met = a.join(b, a[split].eqNullSafe(b["__s"]) & a[kind].eqNullSafe(b["__k"]) & (a["__all"] == b["__a"]))
    share = F.round(F.try_divide(F.col("__new"), F.col("__told")), 6).alias("novel")
    return met.select(split, F.when(F.col("__all"), "all").otherwise(F.col(kind).cast("string")).alias(kind), "docs", F.col("__n").alias("mentions"), "ids", share)


def relation_profile(relations: DataFrame, split: str, kind: str, doc: str, members: list[str], novel: Column | None = None) -> DataFrame:
    """By split, type and arity (the members that are not null), and by split and arity over all types ("all"): relations,
    documents and the share of novel ones. Relations of fewer than two members are none."""
    arity = sum((F.when(F.col(m).isNotNull(), 1).otherwise(0) for m in members), F.lit(0)).cast("int")
    share = F.avg((novel if novel is not None else F.lit(False)).cast("int"))
    rows = relations.withColumn("arity", arity).where("arity >= 2")
    sets = rows.groupingSets([[split, kind, "arity"], [split, "arity"]], split, kind, "arity").agg(F.count("*").alias("relations"), F.count_distinct(doc).alias("docs"), F.round(share, 6).alias("novel"), F.grouping(kind).alias("g"))
    return sets.select(split, F.when(F.col("g") == 1, "all").otherwise(F.col(kind).cast("string")).alias(kind), "arity", "relations", "docs", "novel")


def ids_in_text(df: DataFrame, text: Column, pattern: str, group: int = 0) -> DataFrame:
    """The distinct ids that a pattern finds anywhere in the texts."""
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("id")).distinct()


def merged_ids(values: DataFrame, *by: str, ids: str = "ids") -> DataFrame:
    """The union of the ids that a key has anywhere, sorted. Ids, not lists of them, are shuffled, each once a key."""
    each = values.select(*by, F.explode_outer(ids).alias("id")).distinct()
    return each.groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias(ids))


def linking_statistics(values: DataFrame) -> DataFrame:
    """From values (path, value, ids), by path and overall: linked and not linked ones, distinct values, distinct first ids."""
    linked = F.size("ids") > 0
    sums = [F.count_if(linked).alias("linked"), F.count_if(~linked).alias("unlinked"), F.count_distinct("value").alias("texts"), F.count_distinct(F.get("ids", F.lit(0))).alias("ids")]
    return values.rollup("path").agg(*sums, F.grouping("path").alias("g")).select(F.when(F.col("g") == 1, "overall").otherwise(F.col("path")).alias("path"), "linked", "unlinked", "texts", "ids")


def linking_table(values: DataFrame, paths: list[str]) -> DataFrame:
    """Side by side, one row per place: for each path its values in order with their ids, joined by commas; "" beyond a
    path's last value. A path's values are numbered in one window, so a path is for a vocabulary, not for a corpus."""
    merged = merged_ids(values.where(F.col("path").isin(*paths)), "path", "value")
    place = merged.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("value")))
    cell = lambda p, c: F.coalesce(F.max(F.when(F.col("path") == p, c)), F.lit(""))
    columns = [x for p in paths for x in (cell(p, F.col("value")).alias(p), cell(p, F.array_join("ids", ",")).alias(f"{p}_ids"))]
    return place.groupBy("nth").agg(*columns)


def similarity_matrix(outputs: DataFrame, file: str, model: str, text: str, similarity: Callable[[Column, Column], Column], models: list[str]) -> DataFrame:
    """Mean similarity of two models' outputs for the same file, as a table with a column per model; 1 on the diagonal.
    Each unordered pair is computed once."""
    a = outputs.select(file, F.col(model).alias("a"), F.col(text).alias("x"))
    b = outputs.select(file, F.col(model).alias("b"), F.col(text).alias("y"))
    mean = a.join(b, file).where("a < b").select("a", "b", similarity(F.col("x"), F.col("y")).alias("s")).groupBy("a", "b").agg(F.avg("s").alias("s"))
    both = mean.select("a", F.explode(F.array(F.struct(F.col("a").alias("m"), F.col("b").alias("o")), F.struct(F.col("b").alias("m"), F.col("a").alias("o")))).alias("x"), "s").select("x.m", "x.o", "s")
    own = outputs.select(F.col(model).alias("m"), F.col(model).alias("o"), F.lit(1.0).alias("s")).distinct()
    return both.union(own).groupBy(F.col("m").alias(model)).agg(*[F.max(F.when(F.col("o") == m, F.col("s"))).alias(m) for m in models])
