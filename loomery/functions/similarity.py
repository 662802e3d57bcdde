"""Similarities as column expressions; edit ratios as a vectorised function for candidates that a join has narrowed."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Of the token sets; two empty sets are equal, an empty and another have nothing in common."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def common_subsequence(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence, by one addition for each item of the longer side: the columns of the table
    are the bits of one number, and a 0 stands where the length grows."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = every = (1 << len(a)) - 1
    for x in b:
        if here := places.get(x):
            hit = row & here
            row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


_PAIRS = 100_000  # of texts up to _SHORT characters, that a task remembers at most
_SHORT = 500


def _by_pair(score: Callable[[str | None, str | None], float | None]) -> Callable[..., Column]:
    """``score`` of two texts as a function of columns. Pairs that come again in a task are not worked out again."""

    @F.pandas_udf("double")
    def told(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple, float | None] = {}

        def of(pair: tuple) -> float | None:
            if pair in known:
                return known[pair]
            found = score(*pair)
            if len(known) >= _PAIRS:
                known.clear()
            if len(pair[0] or "") <= _SHORT and len(pair[1] or "") <= _SHORT:
                known[pair] = found
            return found

        for x, y in parts:
            yield pd.Series([of(pair) for pair in zip(x, y, strict=True)], dtype=float)

    return told


def _edit_ratio(p: str | None, q: str | None) -> float | None:
    return None if p is None or q is None else 100.0 if p == q else 200.0 * common_subsequence(p, q) / (len(p) + len(q))


def edit_ratio(a: Column | str, b: Column | str) -> Column:
    """200 * common subsequence / both lengths: 100 for equal texts, also for two empty ones."""
    return _by_pair(_edit_ratio)(a, b)


def _token_set_ratio(p: str | None, q: str | None) -> float | None:
    x, y = (None if t is None else {w for w in re.split(r"\s+", t, flags=re.ASCII) if w} for t in (p, q))
    if x == set() or y == set():
        return 0.0
    if x is None or y is None:
        return None
    both = sorted(x & y)
    if both and len(both) in (len(x), len(y)):
        return 100.0
    one, two = (" ".join(both + sorted(t - o)) for t, o in ((x, y), (y, x)))
    return max(_edit_ratio(one, two), *(_edit_ratio(" ".join(both), t) for t in (one, two) if both), 0.0)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Over sorted distinct tokens: 100 if one set holds the other, else the best edit ratio among the common tokens and
    the common tokens followed by either rest; 0 if a side has no tokens."""
    return _by_pair(_token_set_ratio)(a, b)


def ngrams(t: Column, n: int) -> Column:
    """All runs of n tokens, as text."""
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def common_count(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def rouge(candidate: Column, reference: Column, n: int) -> Column:
    """ROUGE-n as a struct of precision, recall and F1."""
    a, b = ngrams(tokens(candidate), n), ngrams(tokens(reference), n)
    hit = common_count(a, b)
    p, r = F.coalesce(F.try_divide(hit, F.size(a)), F.lit(0.0)), F.coalesce(F.try_divide(hit, F.size(b)), F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def rouge_l(candidate: Column, reference: Column) -> Column:
    """ROUGE-L as a struct: precision, recall and F1 of the longest common subsequence of words."""

    @F.pandas_udf("int")
    def longest(x: pd.Series, y: pd.Series) -> pd.Series:
        one = lambda p, q: None if p is None or q is None else common_subsequence(p.tolist(), q.tolist())
        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    a, b = tokens(candidate), tokens(reference)
    hit = longest(a, b)
    p, r = F.coalesce(F.try_divide(hit, F.size(a)), F.lit(0.0)), F.coalesce(F.try_divide(hit, F.size(b)), F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def bleu(df: DataFrame, candidate: str, reference: str, n: int = 4) -> DataFrame:
    """Corpus BLEU, one row: clipped n-gram counts summed over all rows, their geometric mean, and the brevity penalty; 0 if
    some order has no hit."""
    a, b = tokens(F.col(candidate)), tokens(F.col(reference))
    sums = [F.sum(F.size(a)).alias("c"), F.sum(F.size(b)).alias("r")]
    for k in range(1, n + 1):
        sums += [F.sum(common_count(ngrams(a, k), ngrams(b, k))).alias(f"hit{k}"), F.sum(F.size(ngrams(a, k))).alias(f"all{k}")]
    mean = sum((F.log(F.try_divide(F.col(f"hit{k}"), F.col(f"all{k}"))) for k in range(2, n + 1)), F.log(F.try_divide(F.col("hit1"), F.col("all1")))) / n
    penalty = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("r"), F.col("c"))))
    return df.agg(*sums).select(F.coalesce(penalty * F.exp(mean), F.lit(0.0)).alias("bleu"))


def chunk_cosine(pairs: DataFrame) -> DataFrame:
    """(pair, score): mean cosine of aligned chunks (pair, chunk, a, b)."""
    return pairs.groupBy("pair").agg(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("a"), F.col("b"))))).alias("score"))


def token_scores(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """(pair, p, r, score) with all cosines within a pair, from token vectors (pair, idx, vec)."""
    a = predicted.select("pair", F.col("idx").alias("p"), F.col("vec").alias("a"))
    b = reference.select("pair", F.col("idx").alias("r"), F.col("vec").alias("b"))
    return a.join(b, "pair").select("pair", "p", "r", cosine(F.col("a"), F.col("b")).alias("score"))


def alignment(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Per pair: precision, the mean of each predicted token's best cosine; recall, of each reference token's; F1."""
    scores = token_scores(predicted, reference)
    best = lambda side, name: scores.groupBy("pair", side).agg(F.max("score").alias("m")).groupBy("pair").agg(F.avg("m").alias(name))
    both = best("p", "precision").join(best("r", "recall"), "pair")
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
