"""Evaluations: predictions joined to gold, matched, aggregated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators import matching, metrics


def flat_corpus(gold: DataFrame, predicted: DataFrame, doc: str, keys: Sequence[str], unpredicted: str = "skip") -> DataFrame:
    """Micro ratings of exact key matches over documents."""
    return metrics.micro(matching.set_counts(gold, predicted, [doc], keys, unpredicted))


def category_corpus(gold: DataFrame, predicted: DataFrame, doc: str, category: str, text: str, subtype: str) -> DataFrame:
    """Ratings by category and overall. In a document's category, items compare by text and subtype if any gold or
    predicted item there has a subtype, else by text."""
    side = lambda df, s: df.select(doc, category, text, subtype, F.lit(s).alias("side"))
    both = side(gold, "g").unionByName(side(predicted, "p"))
    typed = both.groupBy(doc, category).agg(F.bool_or(F.col(subtype).isNotNull()).alias("typed"))
    keyed = both.join(typed, [doc, category]).withColumn(subtype, F.when(F.col("typed"), F.col(subtype)))
    counts = matching.set_counts(keyed.where("side = 'g'"), keyed.where("side = 'p'"), [doc, category], [text, subtype])
    return metrics.by_category(counts, category)


def positional_corpus(gold: DataFrame, predicted: DataFrame, items: str, keys: Sequence[str], idx: str = "idx") -> DataFrame:
    """Micro ratings of corpora that are joined by their documents' place ``idx``: rows of a document with an array of
    ``items``, structs that hold the keys. Documents that only one side has are skipped."""
    side = lambda df: df.select(idx, F.explode(items).alias("x")).select(idx, *[F.col(f"x.{k}").alias(k) for k in keys])
    both = gold.select(idx).join(predicted.select(idx), idx)
    counted = matching.set_counts(side(gold).join(both, idx, "left_semi"), side(predicted).join(both, idx, "left_semi"), [idx], keys, "count")
    return metrics.micro(counted)


def sentence_corpus(gold: DataFrame, predicted: DataFrame, doc: str, sentence: str, keys: Sequence[str]) -> DataFrame:
    """Micro ratings where only sentences on both sides count."""
    return metrics.micro(matching.set_counts(gold, predicted, [doc, sentence], keys))


def field_scores(gold: DataFrame, predicted: DataFrame, group: Sequence[str], fields: Sequence[str], by: str | None = None) -> DataFrame:
    """Each gold row against each prediction of its group, field by field: ratings by field and overall, and each of these
    by the group's column ``by`` (a material) too, if given. A value that only one side has is a miss or a false hit, two
    different ones are both."""
    both = matching.pairs(gold, predicted, group)
    rows = both.select(*([by] if by else []), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"g.{f}").cast("string").alias("g"), F.col(f"p.{f}").cast("string").alias("p")) for f in fields])).alias("x")).select(*([by] if by else []), "x.*")
    g, p = F.coalesce("g", F.lit("")), F.coalesce("p", F.lit(""))
    one = lambda c: F.when(c, 1).otherwise(0)
    counts = rows.select(*([by] if by else []), "field", one((g == p) & (g != "")).alias("tp"), one((p != "") & (g != p)).alias("fp"), one((g != "") & (g != p)).alias("fn"))
    if by is None:
        return metrics.by_category(counts, "field")
    sums = [F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    cube = counts.cube(by, "field").agg(*sums, F.grouping(by).alias("a"), F.grouping("field").alias("b"))
    named = [F.when(F.col("a") == 1, "all").otherwise(F.col(by)).alias(by), F.when(F.col("b") == 1, "overall").otherwise(F.col("field")).alias("field")]
    return metrics.prf(cube.select(*named, "tp", "fp", "fn"))


def expert_comparison(scored: DataFrame, gold: DataFrame, predicted: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row: accuracy and weighted scores of the values at common paths, each predicted record held against the gold
    record that ``scored`` (group, g, p, score) rates best for it."""
    pairs = matching.best_gold(scored, group)
    return metrics.weighted(matching.aligned_values(pairs, gold, predicted, group), F.col("gold_value"), F.col("value"))


def expanded_ids(df: DataFrame, key: str, reference: str, predicted: str) -> DataFrame:
    """(key, ref, pred): two arrays of ids aligned by place, the shorter, sorted, repeated to the longer's size."""
    a, b = F.array_sort(reference), F.array_sort(predicted)
    n = F.greatest(F.size(a), F.size(b))
    at = lambda x, i: F.when(F.size(x) > 0, F.get(x, F.pmod(i, F.greatest(F.size(x), F.lit(1)))))
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(a, i).alias("ref"), at(b, i).alias("pred")))
    return df.where(n > 0).select(key, F.explode(rows).alias("x")).select(key, "x.ref", "x.pred")


def reference_comparison(df: DataFrame, category: str, reference: str, predicted: str, names: dict[str, str]) -> DataFrame:
    """Accuracy by category and overall after both sides' names went through a fixed map; names it lacks stay."""
    same = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    mapped = lambda c: F.coalesce(F.try_element_at(same, F.col(c)), F.col(c))
    return metrics.accuracy(df, mapped(reference).eqNullSafe(mapped(predicted)), category)
