"""Trees of extraction results and what their folder names say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators.skewed import split_join

#: Folder names that say nothing about a record.
STRUCTURAL = ("results", "extractions", "experimental-usecase", "simulation-usecase", "processed", "raw", "data")


def scan_extractions(spark: SparkSession, root: str) -> DataFrame:
    """(path, record): every ``.json`` below the root as VARIANT; unreadable and empty files are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    parsed = files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("record"))
    return parsed.where(F.col("record").isNotNull() & ~F.schema_of_variant("record").isin("VOID", "OBJECT<>", "ARRAY<VOID>"))


def path_metadata(path: Column, materials: tuple[str, ...] = (), variants: tuple[str, ...] = ()) -> Column:
    """A struct from ``.../material/[variant/]condition/model/file``: the names from the end on, structural ones null."""
    parts = F.split(path, "/")
    from_end = lambda k: F.try_element_at(parts, F.lit(-k))
    sound = lambda c: F.when(~c.isin(*STRUCTURAL) & (c != ""), c)
    above = from_end(4)
    variant = F.when(above.isin(*variants), above) if variants else F.when(~above.isin(*materials), sound(above))
    material = F.get(F.reverse(F.filter(parts, lambda x: x.isin(*materials))), F.lit(0)) if materials else sound(from_end(4))
    return F.struct(sound(from_end(2)).alias("model"), sound(from_end(3)).alias("condition"), variant.alias("variant"), material.alias("material"), F.regexp_replace(from_end(1), r"\.[^.]*$", "").alias("stem"))


def gold_of_folder(folder: Column, precursors: int) -> Column:
    """``a - b - c``: the first parts are precursors, up to three more co-reactants; what is missing is ""."""
    parts = F.transform(F.split(folder, " - "), lambda x: F.trim(x))
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    names = [(f"precursor{i + 1}", at(i)) for i in range(precursors)] + [(f"coreactant{i + 1}", at(precursors + i)) for i in range(3 if precursors == 1 else 1)]
    return F.struct(*[c.alias(n) for n, c in names])


def html_text(page: Column) -> Column:
    """A page's text by regular expressions alone, for staging: scripts, styles, comments and tags go, block tags become
    newlines, the five basic entities are decoded."""
    c = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|footer|header|title|br)\b[^>]*>", "\n")
    c = F.regexp_replace(c, "<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(mark))
    c = F.regexp_replace(c, "[ \\t\\r\\f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, " ?\\n ?", "\n"), "\\n+", "\n"), F.lit(" \n"))


def texts_or_rejects(pages: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a text, and those without."""
    made = pages.withColumn("text", text)
    return made.where(F.col("text") != ""), made.where(F.coalesce("text", F.lit("")) == "")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(stem, path, text): Markdown and plain-text files below the root, one row each."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(root)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def of_document(extractions: DataFrame, documents: DataFrame, how: str = "inner") -> DataFrame:
    """Extractions (path, ..) with the ``text`` of the document (stem, text) they were made from, by the file name without its
    ending. Extractions without a document are left out, or, with ``how`` "left", have a null text. Of documents of one name in
    several folders the first path counts; a document of very many extractions is dealt over several tasks."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    first = documents.groupBy("stem").agg(F.min_by("text", "path").alias("text"))
    return split_join(extractions.withColumn("stem", stem), first, "stem", F.col("path"), how)
