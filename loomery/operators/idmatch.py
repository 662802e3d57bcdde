"""Evaluation by identifiers: a prediction matches a gold name through its ids' known names or through its own text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.similarity import token_set_ratio
from loomery.functions.text import key_form
from loomery.operators import matching, metrics

SYNONYMS = 200  # fixed value: of an id, in their order, that are compared by similarity


def name_matches(gold: DataFrame, predicted: DataFrame, known: DataFrame, group: Sequence[str], percent: int | None = 85, form=key_form, synonyms: int | None = SYNONYMS) -> DataFrame:
    """(group, p, g): predictions (group, p, ids, value) and gold names (group, g, text) that agree. Equal keys first: an
    id's ``name``, ``formula`` or any of its ``synonyms`` in ``known`` (id, ...), or the value itself, joined on the key.
    With ``percent``, names, the first ``synonyms`` synonyms (None: all) and values also match from that token-set ratio on; those pairs
    meet only within their group."""
    golds = gold.where(F.col("text") != "").select(*group, "g", form(F.col("text")).alias("key"))
    asked = predicted.select(*group, "p", F.explode("ids").alias("id"))
    names = lambda c: F.filter(c, lambda x: x.isNotNull() & (x != ""))
    exact = known.select("id", F.explode(F.array_distinct(F.transform(names(F.concat(F.array("name", "formula"), F.coalesce("synonyms", F.array()))), form))).alias("key"))
    own = predicted.where(F.col("value") != "").select(*group, "p", form(F.col("value")).alias("key"))
    by_key = asked.join(exact, "id").select(*group, "p", "key").unionByName(own).join(golds, [*group, "key"])
    found = [by_key.select(*group, "p", "g")]
    if percent is not None:
        compared = F.coalesce("synonyms", F.array().cast("array<string>"))
        compared = compared if synonyms is None else F.slice(compared, 1, synonyms)
        near = known.select("id", F.explode(names(F.concat(F.array("name"), compared))).alias("said"))
        said = asked.join(near, "id").select(*group, "p", form(F.col("said")).alias("said")).unionByName(own.withColumnRenamed("key", "said"))
        pairs = said.distinct().join(golds, list(group)).where(token_set_ratio(F.col("key"), F.col("said")) >= percent)
        found.append(pairs.select(*group, "p", "g"))
    return reduce(DataFrame.unionByName, found).distinct()


def annotated(df: DataFrame, doc: Sequence[str], material: str, annotations: str, three: Sequence[str] = ("IGZO",)) -> DataFrame:
    """Gold rows (doc, category, g, text) of annotated folders: the material; precursors, left out where there is but one
    annotation; co-reactants. The first annotation is the precursor, or, for the materials in ``three``, all but the last."""
    a, many = F.col(annotations), F.col(material).isin(*three)
    size = F.size(a)
    cut = F.when(many, F.greatest(size - 1, F.lit(0))).otherwise(F.least(size, F.lit(1)))
    part = lambda name, texts: F.transform(texts, lambda x, i: F.struct(F.lit(name).alias("category"), i.alias("g"), x.alias("text")))
    first = F.when(size > 1, F.slice(a, F.lit(1), cut)).otherwise(F.array().cast("array<string>"))
    rest = F.when(size > cut, F.slice(a, cut + 1, size - cut)).otherwise(F.array().cast("array<string>"))
    rows = F.concat(part("material", F.array(material)), part("precursor", first), part("coreactant", rest))
    return df.select(*doc, F.explode(rows).alias("x")).select(*doc, "x.*")


def by_ids(gold: DataFrame, predicted: DataFrame, known: DataFrame, doc: Sequence[str], how: Mapping[str, str], percent: int | None = 85, form=key_form) -> DataFrame:
    """Ratings by ``category`` and overall. ``how`` says for each category whether it is matched "greedy" or by "coverage".
    Where a category was left out of a document's gold, its predictions there don't count if ``how`` is coverage."""
    group = [*doc, "category"]
    hits = name_matches(gold, predicted, known, group, percent, form)
    counts = []
    for category, way in how.items():
        of = lambda df: df.where(F.col("category") == category)  # noqa: E731, B023
        shown = of(predicted) if way == "greedy" else of(predicted).join(of(gold).select(*doc).distinct(), list(doc), "left_semi")
        counts.append(matching.knowledge_base_counts(of(gold), shown, of(hits), group, way))
    return metrics.by_category(reduce(DataFrame.unionByName, counts), "category")
