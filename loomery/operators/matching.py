"""Predictions against gold, group by group: sets, bags, assignments and knowledge-base matches."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.similarity import token_jaccard, token_scores
from loomery.operators import graph
from loomery.operators.skewed import split_join
from loomery.sources.rounds import settled


def set_counts(gold: DataFrame, predicted: DataFrame, group: Sequence[str], keys: Sequence[str], unpredicted: str = "skip", form: Callable[[Column], Column] | None = None) -> DataFrame:
    """tp, fp and fn per group, comparing distinct keys, as ``form`` gives their text if named; a null key equals a null. Groups without any gold row are left
    out, those without any prediction too unless ``unpredicted`` is "count". One shuffle: both sides go to their groups
    and keys as flags, so a pair never meets by a join."""
    if form:
        texts = lambda df: df.withColumns({k: form(F.col(k)) for k in keys if dict(df.dtypes)[k] == "string"})
        gold, predicted = texts(gold), texts(predicted)
    flag = lambda df, g, p: df.select(*group, *keys, F.lit(g).alias("in_gold"), F.lit(p).alias("in_predicted"))
    both = flag(gold, 1, 0).unionByName(flag(predicted, 0, 1))
    distinct = both.groupBy(*group, *keys).agg(F.max("in_gold").alias("g"), F.max("in_predicted").alias("p"))
    count = lambda cond: F.count_if(cond)
    g, p = F.col("g") == 1, F.col("p") == 1
    counts = distinct.groupBy(*group).agg(count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn"))
    kept = F.col("tp") + F.col("fn") > 0
    return counts.where(kept if unpredicted == "count" else kept & (F.col("tp") + F.col("fp") > 0))


def pairs(gold: DataFrame, predicted: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each prediction with each gold row of its group: ``g`` and ``p`` structs."""
    a = gold.select(*group, F.struct(*[c for c in gold.columns if c not in group]).alias("g"))
    b = predicted.select(*group, F.struct(*[c for c in predicted.columns if c not in group]).alias("p"))
    return a.join(b, list(group))


def greedy(matches: DataFrame, group: Sequence[str]) -> DataFrame:
    """From match pairs (group, p, g): predictions in order take the first gold that is still free. tp per group. Each choice
    hangs on all before it, so a group is one row, in time of its pairs and the square of its predictions: a group is meant to
    be a document."""
    lists = matches.groupBy(*group, "p").agg(F.array_sort(F.collect_set("g")).alias("gs")).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("p", "gs"))).alias("ps"))
    kind = dict(matches.dtypes)["g"]
    taken = F.aggregate("ps", F.array().cast(f"array<{kind}>"), lambda used, x: F.concat(used, F.slice(F.array_except(x.gs, used), 1, 1)))
    return lists.select(*group, F.size(taken).cast("long").alias("tp"))


def coverage(matches: DataFrame, group: Sequence[str]) -> DataFrame:
    """From match pairs: tp, the golds that any prediction hits, and ``winners``, the predictions that hit one first."""
    first = matches.groupBy(*group, "g").agg(F.min("p").alias("p"))
    return first.groupBy(*group).agg(F.count("*").alias("tp"), F.count_distinct("p").alias("winners"))


def knowledge_base_counts(gold: DataFrame, predicted: DataFrame, matches: DataFrame, group: Sequence[str], how: str = "greedy", strict_fp: bool = True) -> DataFrame:
    """tp, fp and fn per group by ``greedy`` or ``coverage`` matching of numbered rows. With coverage, a prediction that
    hits only golds that were hit before is a false positive unless ``strict_fp`` is False."""
    size = lambda df, c: df.groupBy(*group).agg(F.count("*").alias(c))
    if how == "greedy":
        hit = greedy(matches, group).withColumn("winners", F.col("tp"))
    else:
        hit = coverage(matches, group)
        if not strict_fp:
            hit = hit.drop("winners").join(matches.groupBy(*group).agg(F.count_distinct("p").alias("winners")), list(group))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    joined = size(gold, "n_gold").join(size(predicted, "n_predicted"), list(group), "full").join(hit, list(group), "left")
    return joined.select(*group, n("tp").alias("tp"), (n("n_predicted") - n("winners")).alias("fp"), (n("n_gold") - n("tp")).alias("fn"))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """A one-to-one assignment of least total cost, by shortest augmenting paths; the smaller side is used up."""
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while of[j]:
            used[j] = True
            row = of[j]
            reach = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reach < least[1:])
            least[1:][better], way[1:][better] = reach[better], j
            open_ = np.where(used[1:], np.inf, least[1:])
            nxt = int(open_.argmin()) + 1
            delta = open_[nxt - 1]
            u[of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
        while j:
            of[j], j = of[way[j]], way[j]
    return sorted((int(of[j]) - 1, j - 1) for j in range(1, m + 1) if of[j])


def assign_sparse(left: np.ndarray, right: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Of scored pairs the places of those that make up the assignment of greatest total score, in memory of the order of
    the pairs. Rows are 0 .. n-1 on either side. Each left row in turn finds its shortest augmenting path among the pairs
    that it reaches; a path may also end in leaving a row of it without a partner. Of several best assignments the order of
    the rows decides, and what lies in other components has no say."""
    n, m = int(left.max(initial=-1)) + 1, int(right.max(initial=-1)) + 1
    by = np.argsort(left, kind="stable")
    start = np.searchsorted(left[by], np.arange(n + 1)).tolist()
    to, gain, place = right[by].tolist(), score[by].astype(float).tolist(), by.tolist()
    u, v = [max(0.0, max(gain[start[i] : start[i + 1]], default=0.0)) for i in range(n)], [0.0] * m  # what rows are worth: u + v >= score
    owner, chosen = [-1] * m, [-1] * n  # of a right row its left row; of a left row its pair
    for first in range(n):
        far, back, seen, heap = {}, {}, {}, []
        reached = {first: 0.0}
        end, row, here = (float("inf"), -1, -1), first, 0.0
        while True:
            if here + u[row] < end[0]:
                end = (here + u[row], row, -1)  # leaves this row alone
            for k in range(start[row], start[row + 1]):
                j = to[k]
                d = here + max(0.0, u[row] + v[j] - gain[k])
                if j not in seen and d < far.get(j, float("inf")):
                    far[j], back[j] = d, (row, k)
                    heapq.heappush(heap, (d, j))
            while heap and heap[0][1] in seen:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end[0]:
                break
            d, j = heapq.heappop(heap)
            if owner[j] < 0:
                end = (d, -1, j)
                break
            seen[j] = d
            row, here = owner[j], d
            reached[row] = d
        total, alone, j = end
        for i, d in reached.items():
            u[i] = max(0.0, u[i] - (total - d)) if d < total else u[i]
        for k, d in seen.items():
            v[k] += total - d
        if alone >= 0:  # its right row goes to the row before it on the path
            if alone == first:
                continue
            j = to[chosen[alone]]
            chosen[alone] = -1
        while True:
            i, k = back[j]
            old, chosen[i], owner[j] = chosen[i], k, i
            if i == first:
                break
            j = to[old]
    return np.array(sorted(place[k] for k in chosen if k >= 0), np.int64)


def auction(scored: DataFrame, by: Sequence[str], step: float = 0.01, rounds: int = 10_000) -> DataFrame:
    """From scored pairs (by.., g, p, score > 0) an assignment whose total is within ``step`` for each assigned pair of the
    greatest. In each round every g without a partner bids for the p of most value to it, what it can gain over its second
    choice and ``step``; a p goes to the highest bid and its price rises to that. A g to which nothing is worth its price
    drops out. Each round is a few joins and aggregates over the bidders' pairs, written to the shared folder."""
    by = list(by)
    all_pairs = settled(scored.select(*by, "g", "p", "score"))
    free = settled(all_pairs.select(*by, "g").distinct())
    held = settled(all_pairs.limit(0).select(*by, "p", F.col("g"), F.col("score").cast("double").alias("price")))
    for _ in range(rounds):
        if free.isEmpty():
            break
        prices = held.select(*by, "p", "price")
        offers = all_pairs.join(free, [*by, "g"], "left_semi").join(prices, [*by, "p"], "left").withColumn("price", F.coalesce("price", F.lit(0.0))).withColumn("value", F.col("score") - F.col("price"))
        order = Window.partitionBy(*by, "g").orderBy(F.desc("value"), "p")
        two = offers.withColumn("nth", F.row_number().over(order)).where("nth <= 2").groupBy(*by, "g").agg(F.max(F.when(F.col("nth") == 1, F.struct("value", "p", "price"))).alias("best"), F.max(F.when(F.col("nth") == 2, F.col("value"))).alias("second"))
        bids = two.where("best.value > 0").select(*by, "g", F.col("best.p").alias("p"), (F.col("best.price") + F.col("best.value") - F.greatest(F.coalesce("second", F.lit(0.0)), F.lit(0.0)) + step).alias("bid"))
        bids = settled(bids)
        won = settled(bids.groupBy(*by, "p").agg(F.min_by("g", F.struct(-F.col("bid"), F.col("g"))).alias("g"), F.max("bid").alias("price")))
        lost = bids.join(won.select(*by, "p", "g"), [*by, "p", "g"], "left_anti").select(*by, "g")
        ousted = held.join(won.select(*by, "p"), [*by, "p"], "left_semi").select(*by, "g")
        held = settled(held.join(won.select(*by, "p"), [*by, "p"], "left_anti").select(*by, "p", "g", "price").union(won.select(*by, "p", "g", "price")))
        free = settled(lost.union(ousted))
    return all_pairs.join(held.select(*by, "g", "p"), [*by, "g", "p"], "left_semi")


def one_to_one(scored: DataFrame, group: Sequence[str], least: float = 0.0, most: int = 100_000, largest: int = 2_000_000, step: float = 0.01) -> DataFrame:
    """From scored pairs (group, g, p, score), missing pairs scoring 0: the assignment of greatest total score, rows with
    at least ``least``. Pairs that are each other's only partner are settled in Spark. Python sees the rest, many groups at a
    time, about ``most`` pairs, in memory of the order of these; groups of more than ``most`` pairs are first cut into the components that
    positive scores connect, which changes nothing in what comes out. A component of more than ``largest`` pairs is no
    single task's work: it is settled by an ``auction``, within ``step`` a pair of the greatest total."""
    columns = [*group, "g", "p", "score"]
    scored = scored.where("score > 0").select(*columns)
    for c in (*group, "g", "p"):
        scored = scored.where(F.col(c).isNotNull())
    of = lambda *by: F.count("*").over(Window.partitionBy(*group, *by))
    counted = scored.withColumn("__g", of("g")).withColumn("__p", of("p")).withColumn("__alone", (F.col("__g") == 1) & (F.col("__p") == 1))
    counted = settled(counted.withColumn("__n", F.count_if(~F.col("__alone")).over(Window.partitionBy(*group))).select(*columns, "__alone", "__n"))
    rest = counted.where("not __alone")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[columns].sort_values([*group, "g", "p"], kind="stable")
        sides = [pdf.groupby([*group, c], sort=True, dropna=False).ngroup().to_numpy() for c in ("g", "p")]
        return pdf.iloc[assign_sparse(*sides, pdf["score"].to_numpy())]

    def in_tasks(pairs: DataFrame, *together: str) -> DataFrame:
        """What is connected has the same values of ``together``."""
        parts = max(1, -(-pairs.count() // most))
        return pairs.select(*columns, F.pmod(F.xxhash64(*together), F.lit(parts)).alias("__task")).groupBy("__task").applyInPandas(settle, scored.schema)

    found = counted.where("__alone").select(*columns).unionByName(in_tasks(rest.where(F.col("__n") <= most), *group))
    large = rest.where(F.col("__n") > most)
    if not large.isEmpty():
        # equal hashes of two ends would only keep two components together
        ends = settled(large.withColumns({"__a": F.xxhash64(*group, F.lit("g"), "g"), "__b": F.xxhash64(*group, F.lit("p"), "p")}))
        labels = graph.components(ends.select(F.col("__a").alias("a"), F.col("__b").alias("b")))
        cut = settled(split_join(ends.withColumnRenamed("__a", "id"), labels, "id", F.col("__b")).select(*columns, F.col("component").alias("__part")))
        huge = settled(cut.groupBy("__part").agg(F.count("*").alias("__n")).where(F.col("__n") > largest).select("__part"))
        if not huge.isEmpty():
            found = found.unionByName(auction(cut.join(huge, "__part", "left_semi"), group, step).select(*columns))
            cut = cut.join(huge, "__part", "left_anti")
        found = found.unionByName(in_tasks(cut, "__part"))
    return found.where(F.col("score") >= least)


def soft_counts(gold: DataFrame, predicted: DataFrame, group: Sequence[str], text: str = "text", least: float = 0.8) -> DataFrame:
    """tp, fp and fn per group of bags of texts: best one-to-one pairs by token Jaccard, a pair counts from ``least``.
    Rows carry an ``id`` that is unique in their group."""
    joined = gold.select(*group, F.col("id").alias("g"), F.col(text).alias("a")).join(predicted.select(*group, F.col("id").alias("p"), F.col(text).alias("b")), list(group))
    hits = one_to_one(joined.select(*group, "g", "p", token_jaccard(F.col("a"), F.col("b")).alias("score")), group, least).groupBy(*group).agg(F.count("*").alias("tp"))
    size = lambda df, c: df.groupBy(*group).agg(F.count("*").alias(c))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_ = size(gold, "ng").join(size(predicted, "np"), list(group), "full").join(hits, list(group), "left")
    return all_.select(*group, n("tp").alias("tp"), (n("np") - n("tp")).alias("fp"), (n("ng") - n("tp")).alias("fn"))


def best_gold(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """From scored pairs (group, g, p, score): for each prediction the gold that scores best, above 0, the earliest on ties."""
    return scored.where("score > 0").groupBy(*group, "p").agg(F.max_by("g", F.struct("score", -F.col("g"))).alias("g"), F.max("score").alias("score"))


def token_alignment(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """(pair, score): the best one-to-one assignment of token vectors (pair, idx, vec) by cosine, its sum over the longer
    side's number of tokens."""
    size = lambda df, c: df.groupBy("pair").agg(F.count("*").alias(c))
    chosen = one_to_one(token_scores(predicted, reference).withColumnRenamed("r", "g"), ["pair"]).groupBy("pair").agg(F.sum("score").alias("s"))
    both = size(predicted, "n").join(size(reference, "m"), "pair", "full").join(chosen, "pair", "left")
    longer = F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))
    return both.select("pair", F.coalesce(F.col("s") / longer, F.lit(0.0)).alias("score"))


def embedding_match(scored: DataFrame, gold: DataFrame, predicted: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per group with rows on both sides: the mean precision, recall and F1 of the pairs (g, p, precision, recall, f1) of
    the assignment of greatest F1; 0 where a group has one side only."""
    sides = gold.select(*group).distinct().withColumn("a", F.lit(1)).join(predicted.select(*group).distinct().withColumn("b", F.lit(1)), list(group), "full")
    chosen = one_to_one(scored.withColumn("score", F.col("f1")), group).select(*group, "g", "p").join(scored, [*group, "g", "p"])
    means = chosen.groupBy(*group).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return sides.join(means, list(group), "left").select(*group, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def aligned_values(pairs: DataFrame, gold: DataFrame, predicted: DataFrame, group: Sequence[str]) -> DataFrame:
    """From paired records (group, g, p) and their leaves (group, g or p, nth, path, value): values that stand at the same
    path on both sides, the first of each path."""
    first = lambda df, side, name: df.groupBy(*group, side, "path").agg(F.min_by("value", "nth").alias(name))
    left, right = first(gold, "g", "gold_value"), first(predicted, "p", "value")
    return pairs.select(*group, "g", "p").join(left, [*group, "g"]).join(right, [*group, "p", "path"]).select(*group, "g", "p", "path", "gold_value", "value")


def matches_by(gold: DataFrame, predicted: DataFrame, group: Sequence[str], ids_of: Callable[[Column], Column], agree: Callable[[Column, Column], Column], field: str = "field") -> DataFrame:
    """(group, p, g): match pairs by two functions of the caller, on columns: ``ids_of`` a predicted field gives an array of
    identifiers, and one of them ``agree``s with a gold field. Pairs meet within their group only."""
    a = gold.select(*group, "g", F.col(field).alias("__gold"))
    b = predicted.select(*group, "p", F.explode(ids_of(F.col(field))).alias("__id")).distinct()
    return b.join(a, list(group)).where(agree(F.col("__id"), F.col("__gold"))).select(*group, "p", "g").distinct()
