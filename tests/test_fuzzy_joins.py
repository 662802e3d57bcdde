"""Joins on similar texts against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from loomery.functions.similarity import common_subsequence
from loomery.operators import link

WORDS = "amber azure brass coral cream dodger frosted gainsboro honeydew indigo khaki lace lemon linen m of the tin zinc oxide tri methyl".split()


def ratio(a, b):
    return 100.0 if a == b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def edited(rng, name, most):
    chars = list(name)
    for _ in range(rng.randrange(most + 1)):
        at = rng.randrange(len(chars) + 1)
        if chars and rng.random() < 0.5:
            del chars[min(at, len(chars) - 1)]
        else:
            chars.insert(at, rng.choice("abcdefgh xyz"))
    return "".join(chars)


def names(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randrange(1, 6))) for _ in range(n)]


def column(spark, texts, name):
    return spark.createDataFrame([(t,) for t in texts], f"{name} string")


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_segments_lose_no_pair(spark, percent):
    rng = random.Random(percent)
    kb = sorted({*names(1, 150), "", "a", "ab", "é" * 9})
    asked = sorted({edited(rng, n, 6) for n in kb} | {"", "b", "é" * 8})
    found = {(r.mention, r.low) for r in link.blocked(column(spark, asked, "mention"), column(spark, kb, "synonym").withColumn("id", F.lit(1)), percent).collect()}
    want = {(a, k.lower()) for a in asked for k in kb if ratio(a, k.lower()) >= percent}
    assert want <= found and len(found) < {60: 1, 85: 0.5, 95: 0.2}[percent] * len(asked) * len(kb)


def test_fuzzy_takes_the_first(spark):
    rng = random.Random(2)
    kb = sorted(set(names(3, 200)))
    asked = sorted({edited(rng, n, 3) for n in kb[:120]})
    base = spark.createDataFrame([(k, str(i)) for i, k in enumerate(kb)], "synonym string, id string")
    got = {r.mention: r.ids for r in link.fuzzy(column(spark, asked, "mention"), base).collect()}
    assert got == {a: [str(kb.index(min(hits)))] for a in asked if (hits := [k for k in kb if ratio(a, k) >= 85])}


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and (x <= y or y <= x):
        return 100.0
    one, two = " ".join(both + sorted(x - y)), " ".join(both + sorted(y - x))
    return max(ratio(one, two), *((ratio(" ".join(both), one), ratio(" ".join(both), two)) if both else ()), 0.0)


@pytest.mark.parametrize("percent", [75, 90])
def test_best_is_complete(spark, percent):
    rng = random.Random(percent)
    kb = sorted(set(names(5, 400)))
    asked = set()
    for n in names(6, 60) + kb[:200]:
        ws = edited(rng, n, 3).split()
        rng.shuffle(ws)
        asked.add(" ".join(ws + rng.choices(WORDS, k=rng.randrange(2))))
    asked = sorted(asked - {""}) + ["  ", "m xpple", "the"]
    base = spark.createDataFrame([(k, str(i)) for i, k in enumerate([*kb, "m apple"])], "synonym string, id string")
    got = {r.mention: (r.synonym, round(r.score, 6)) for r in link.best(column(spark, asked, "mention"), base, percent).collect()}
    want = {}
    for a in asked:
        scored = []
        for k in [*kb, "m apple"]:
            s = 100.0 if a.lower() in k.lower() else ratio(a, k)
            if s < percent:
                s = token_set(a, k)
            if s >= percent:
                scored.append((-round(s, 9), k))
        if scored:
            want[a] = (min(scored)[1], round(-min(scored)[0], 6))
    assert got == want


def test_common_words_that_sort_apart(spark):
    """Sorted, these two differ more than with their common word put first."""
    base = spark.createDataFrame([("m apple", "1")], "synonym string, id string")
    assert [(r.synonym, round(r.score)) for r in link.best(column(spark, ["xpple m"], "mention"), base, 85).collect()] == [("m apple", 86)]


def test_fuzzy_joins_of_nothing(spark):
    base, none = spark.createDataFrame([("x", "1")], "synonym string, id string"), column(spark, [], "mention")
    assert link.fuzzy(none, base).count() == link.best(none, base).count() == link.fuzzy(column(spark, ["x"], "mention"), base.limit(0)).count() == 0
    assert link.fuzzy(column(spark, [None], "mention"), base).count() == 0
