"""Assignments over sparse pairs against the dense solver."""

import random
import time

import numpy as np
import pytest

from loomery.operators import matching


def dense(left, right, score):
    table = np.zeros((left.max() + 1, right.max() + 1))
    np.maximum.at(table, (left, right), score)
    return sum(table[i, j] for i, j in matching.assign(-table))


@pytest.mark.parametrize("seed", range(40))
def test_sparse_total_is_the_dense_total(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 25, 2)
    pairs = [(i, j) for i in range(n) for j in range(m) if rng.random() < rng.choice([0.1, 0.3, 0.8])] or [(0, 0)]
    left, right = np.array(pairs).T
    score = rng.choice([rng.random(len(pairs)), rng.integers(1, 4, len(pairs)) / 3])
    got = matching.assign_sparse(left, right, score)
    assert len(set(left[got])) == len(set(right[got])) == len(got)
    assert score[got].sum() == pytest.approx(dense(left, right, score), abs=1e-9)


def test_sparse_takes_its_time_and_memory_from_the_pairs():
    n = 50_000
    left, right = np.repeat(np.arange(n), 2), np.minimum(np.repeat(np.arange(n), 2) + np.tile([0, 1], n), n - 1)
    score = np.tile([0.9, 1.0], n)
    began = time.perf_counter()
    got = matching.assign_sparse(left[:-1], right[:-1], score[:-1])  # a chain: 99,999 pairs in one component
    assert time.perf_counter() - began < 20 and len(got) == n - 1
    assert score[got].sum() == pytest.approx(n - 1)  # all but the last take the better of two


def test_ways_of_settling_agree(spark):
    rng = random.Random(3)
    rows = [(d, i, j, rng.choice([0.25, 0.5, 0.75, 1.0])) for d in range(4) for i in range(14) for j in range(14) if rng.random() < 0.2]
    df = spark.createDataFrame(rows, "doc long, g long, p long, score double")
    whole = sorted(map(tuple, matching.one_to_one(df, ["doc"]).collect()))
    assert sorted(map(tuple, matching.one_to_one(df, ["doc"], most=3).collect())) == whole  # ties too
    near = matching.one_to_one(df, ["doc"], most=3, largest=5, step=0.001).collect()
    for d in range(4):
        left, right, score = (np.array(x) for x in zip(*[r[1:] for r in rows if r[0] == d], strict=True))
        best, of = dense(left, right, score), [r for r in near if r.doc == d]
        assert sum(r[3] for r in whole if r[0] == d) == pytest.approx(best)
        assert len({r.g for r in of}) == len({r.p for r in of}) == len(of) and best - 0.001 * len(of) - 1e-9 <= sum(r.score for r in of) <= best + 1e-9


def test_empty_and_lonely(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.0), (2, 1, 1, 0.5)], "doc long, g long, p long, score double")
    assert [tuple(r) for r in matching.one_to_one(df, ["doc"]).collect()] == [(2, 1, 1, 0.5)]
    assert matching.one_to_one(df.limit(0), ["doc"]).count() == 0
