"""Hard negatives and whitening against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key string, id long, n int, x string, index int, nth int"
EXTRA = ("k", 7, 3, "x", 1, 2)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def sound(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def mined(rows, every, positives=5, n=3):
    """All anchors against all rows."""
    have = sorted({(i, l, tuple(math.floor(256 * c) for c in v)) for i, v, l in rows if i is not None and l is not None and sound(v)})
    out = set()
    for a, label, q in have:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, l) for i, l, v in have)
        for p, i, _ in [s for s in scored if s[2] == label and s[1] != a][:positives]:
            for rank, (m, j, _) in enumerate([s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:n], 1):
                out.add((a, i, rank, j, -p, -m))
    return out


def result(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def vectors(kind, n, seed=2):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        x = rng.normal(size=(12, 8))[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, 8))
    elif kind == "copies":
        x = np.where(rng.random((n, 1)) < 0.4, np.ones((1, 8)) / 8, rng.normal(size=(n, 8)))
    else:
        x = np.round(rng.normal(size=(n, 7)) * rng.choice([0.1, 1, 10], (n, 1)), 1)  # an odd dimension, mixed lengths, many ties
    return [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["clusters", "copies", "mixed"])
def test_negatives_equal_brute_force(spark, kind):
    rows = vectors(kind, 400)
    got = result(negatives.mine(table(spark, rows), F.col("vec_id") % 8 == 0, F.col("label"), sample=100, cell=4))
    assert got == sorted(mined(rows, 8)) and got


def test_negatives_in_pieces(spark):
    rows = vectors("copies", 150)
    whole = F.transform("embedding", lambda v: F.floor(256 * v).cast("long")).alias("vec")
    entries = table(spark, rows).select(F.col("vec_id").cast("string").alias("key"), whole, F.col("label").cast("long").alias("label"), F.array("vec_id").alias("ids")).withColumn("packed", negatives._packed("vec"))
    index, held = negatives.build(entries, 8, 50, 20)
    asked = entries.where("label = 1").select("key", "packed", "label", F.array(F.struct(F.lit(0).alias("w"), F.lit(-(10**9)).cast("long").alias("low"), F.lit(10**9).cast("long").alias("high"))).alias("windows"))
    whole = {r.key: r.found for r in negatives.hunt(held, index, asked, 8, 4, True).collect()}
    assert whole == {r.key: r.found for r in negatives.hunt(held, index, asked, 8, 4, True, piece=8).collect()} and len(whole) == asked.count()


def test_negatives_of_odd_rows(spark):
    v = [0.5, 0.25, 0.125, -0.5]
    rows = [(0, v, 0), (0, v, 0), (None, v, 0), (1, None, 0), (2, [0.5, None, 1.0, 1.0], 0), (3, [math.nan, 0.0, 0.0, 0.0], 0), (4, [math.inf, 0.0, 0.0, 0.0], 1), (5, v, None), (6, v, 0), (7, v, 1), (8, [c * 0.9 for c in v], 1), (9, [c * 0.9 for c in v], 2), (10, [0.0] * 4, 2), (11, [-c for c in v], 0), (50, [0.0] * 4, 1), (0, [c * 0.8 for c in v], 1), (100, [c * 0.6 for c in v], 0)]
    assert result(negatives.mine(table(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"))) == sorted(mined(rows, 50))
    assert negatives.mine(table(spark, []), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0
    assert negatives.mine(table(spark, rows[:1]), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


def test_negatives_cells_come_by_falling_bound():
    rng = np.random.default_rng(5)
    codes = tuple(rng.integers(-50, 50, (6, 3)) for _ in range(2))
    index = negatives.Index(codes, (rng.random(6) * 20, rng.random(6) * 20), np.ones((6, 6), bool))
    q = rng.integers(-50, 50, 6)
    (_, up1), (_, up2) = index.bounds(q)
    bound = lambda c: up1[c // 6] + up2[c % 6]
    cells, until = index.cells(q, None, -(10**9), 10**9, None)
    assert sorted(cells) == list(range(36)) and [bound(c) for c in cells] == sorted(map(bound, cells), reverse=True) and until == negatives._NEVER
    first, until = index.cells(q, None, -(10**9), 10**9, 10)
    assert cells[: len(first)] == first and 10 <= len(first) < 36 and cells[len(first) :] == index.cells(q, until, -(10**9), 10**9, None)[0]


def white(rows):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows if sound(v)]
    x, fit = np.array([v for _, v in kept]), np.array(sorted({tuple(v) for _, v in kept}))
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return kept, n, ((n * x - s).astype(object) ** 2).sum(1), (n * x - s) / n, values[::-1], vectors[:, ::-1]


def check(df, rows, most=16):
    got = whitening.whiten(df).collect()
    kept, n, deviation, off, values, vectors = white(rows)
    r = min(most, off.shape[1])
    assert len(got) == r * len(kept) and {x.n for x in got} == {n} and {x.component for x in got} == set(range(1, r + 1))
    at, sign = {i: k for k, (i, _) in enumerate(kept)}, {}
    for x in got:
        k = at[x.vec_id]
        assert x.deviation == deviation[k] and math.isclose(x.explained, values[x.component - 1] / values.sum(), rel_tol=1e-9, abs_tol=1e-12)
        if values[x.component - 1] <= 1e-12 * values[0]:
            assert x.whitened is None
            continue
        want = off[k] @ vectors[:, x.component - 1] / math.sqrt(values[x.component - 1])
        if abs(want) > 1e-6:
            assert sign.setdefault(x.component, np.sign(want * x.whitened)) == np.sign(want * x.whitened)
        assert math.isclose(abs(x.whitened), abs(want), rel_tol=1e-7, abs_tol=1e-8)
    assert len({x.identity_error for x in got}) == 1 and got[0].identity_error < 1e-9
    return got


def test_whitening_of_all_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(df, [(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_whitening_with_copies_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_ROWS", 16)
    rows = vectors("copies", 300)
    check(table(spark, rows), rows)


def test_whitening_of_odd_rows(spark):
    rows = [*vectors("clusters", 30), (40, None, 1), (41, [0.5] * 7 + [None], 1), (42, [math.nan] * 8, 1), (43, [-math.inf] * 8, 1), (44, vectors("clusters", 1)[0][1], None)]
    flat = [(i, [*v[:7], 0.25] if v else v, l) for i, v, l in rows]
    check(table(spark, rows), rows)
    assert any(x.whitened is None for x in check(table(spark, flat), flat))
    short = whitening.whiten(table(spark, [*rows, (50, [1.0, 2.0], 0), (51, [], 0)])).collect()
    assert {x.vec_id for x in short} == set(range(30)) | {44}
    assert {x.vec_id for x in whitening.whiten(table(spark, [(None, r[1], 1) for r in rows[:30]])).collect()} == {None}
    one = whitening.whiten(table(spark, rows[:1])).collect()
    assert [(x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in one] == [(1, 0, None, 0.0, 0.0)] * 8
    assert whitening.whiten(table(spark, [])).count() == 0
    huge = whitening.whiten(table(spark, [(1, [3e38, 1.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert len(huge) == 4
