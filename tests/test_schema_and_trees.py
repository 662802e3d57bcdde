"""Schemas against hand-made failures, trees taken apart and put together, clusters by blocks and common subsequences."""

import itertools
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions.similarity import common_subsequence
from loomery.operators import cluster, graph, nested, skewed, validate


def failures(spark, schema, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, j string")
    return sorted((r.doc, r.path, r.rule) for r in validate.schema_violations(df, "doc", "j", schema).collect())


def test_schema_rules(spark):
    schema = {
        "type": "object", "required": ["a", "b"], "additionalProperties": False,
        "properties": {"a": {"type": ["integer", "null"], "minimum": 1, "exclusiveMaximum": 9}, "b": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/item"}}, "c": {"const": {"x": [1, "y"]}}, "d": {"oneOf": [{"type": "string", "maxLength": 2}, {"enum": ["abc", 1, True]}]}},
        "$defs": {"item": {"type": "object", "required": ["n"], "properties": {"n": {"type": "string", "pattern": "^[a-z]+$"}, "more": {"type": "array", "items": {"type": "number"}}}, "additionalProperties": {"type": "boolean"}}},
    }
    good = ['{"a": 1, "b": [{"n": "x"}]}', '{"a": null, "b": [{"n": "x", "more": [1, 2.5], "z": true}], "c": {"x": [1.0, "y"]}, "d": "ab"}', '{"a": 3.0, "b": [{"n": "q"}], "d": "abc"}', '{"a": 3, "b": [{"n": "q"}], "d": 1.0}']
    bad = ['{"b": [], "e": 1}', '{"a": 9, "b": [{"n": "x"}, {"n": "X", "more": ["1", 2]}, {"z": 1}, 7]}', '{"a": 0.5, "b": {}, "c": {"x": [1]}, "d": "abcd"}', "[]", "null", "no json"]
    assert failures(spark, schema, *good[:1], *good[2:]) == []
    assert failures(spark, schema, *bad) == sorted([
        (0, "a", "required"), (0, "b", "minItems"), (0, "e", "extra"), (1, "a", "exclusiveMaximum"), (1, "b[1].more[0]", "type"), (1, "b[1].n", "pattern"), (1, "b[2].n", "required"), (1, "b[2].z", "type"), (1, "b[3]", "type"),
        (2, "a", "type"), (2, "a", "minimum"), (2, "b", "type"), (2, "c", "const"), (2, "d", "oneOf"), (3, "", "type"), (4, "", "type"), (5, "", "json"),
    ])
    df = spark.createDataFrame([(1, good[0]), (1, bad[0]), (2, good[2]), (3, None)], "doc long, j string")
    assert {r.doc: r.valid for r in validate.schema_valid(df, "doc", "j", schema).collect()} == {1: False, 2: True, 3: False}
    assert {r.doc: r.valid for r in validate.schema_valid(df.withColumn("j", F.try_parse_json("j")), "doc", "j", schema).collect()} == {1: False, 2: True, 3: False}
    assert validate.schema_violations(df.limit(0), "doc", "j", schema).count() == 0


@pytest.mark.parametrize("schema", [{"not": {}}, {"$ref": "#"}, {"properties": {"a": {"$ref": "#/definitions/t"}}, "definitions": {"t": {"items": {"$ref": "#/definitions/t"}}}}, {"items": [{}]}])
def test_schema_that_is_not_understood(schema, spark):
    with pytest.raises(ValueError):
        validate.schema_failures(F.parse_json(F.lit("{}")), schema)


def test_trees_come_back(spark):
    records = ['{"a": {"b": [1, 2.5, null, "x"], "e": []}, "t": true, "d": "[1]"}', '{"a": {"b": [], "e": [[{"k": "v"}, {"k": null}], [], [{"k": "w"}]]}, "t": false}', '{"d": ""}', "{}", '{"a": {}}']
    schema = "struct<a: struct<b: array<string>, e: array<array<struct<k: string>>>>, t: boolean, d: string>"
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id long, j string").withColumn("r", F.from_json("j", schema))
    back = {r.id: json.loads(r.j) for r in nested.rebuild(nested.leaves(df, "r", "id"), "id").select("id", F.to_json("record").alias("j")).collect()}
    drop = lambda x: {k: drop(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [drop(v) for v in x] if isinstance(x, list) else x
    want = {r.id: drop(json.loads(r.j)) for r in df.select("id", F.to_json("r").alias("j")).collect()}
    assert back == want


def test_rebuild_from_hand_made_leaves(spark):
    rows = [(1, "a.[0].x", "1", 0), (1, "a.[10].x", "2", 1), (1, "a.[2].x", '"3"', 2), (1, "p", "1", 3), (1, "p", "2", 4), (1, "q", "7", 5), (1, "q.z", "true", 6), (2, "(root)", "5", 0), (3, "[1]", "2", 0), (3, "[0]", "1", 1), (4, "n", None, 0)]
    df = spark.createDataFrame(rows, "id long, path string, value string, nth int")
    got = {r.id: json.loads(r.j) for r in nested.rebuild(df, "id").select("id", F.to_json("record").alias("j")).collect()}
    assert got == {1: {"a": [{"x": 1}, {"x": "3"}, {"x": 2}], "p": [1, 2], "q": {"z": True}}, 2: 5, 3: [1, 2]}
    assert nested.rebuild(df.limit(0), "id").count() == 0
    plan = nested.rebuild(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_common_subsequence():
    rng = random.Random(4)

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b, 1):
                row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choices("abcä\U0001f600", k=rng.randrange(70))) for _ in range(2))
        assert common_subsequence(a, b) == table(a, b) == common_subsequence(list(b), list(a))
    long = ["".join(rng.choices("abcdefgh ", k=1000)) for _ in range(40)]
    began = time.perf_counter()
    for a, b in itertools.pairwise(long):
        common_subsequence(a, b)
    assert time.perf_counter() - began < 39 * 1000 * 4e-6  # by numpy, a row at a time, it took over 4 microseconds a character


@pytest.mark.parametrize("eps", [0.05, 0.3, 1.2])
def test_cover_loses_no_near_pair(eps):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(200, 5)), rng.normal(size=(10, 5))[rng.integers(0, 10, 200)] + 0.05 * rng.normal(size=(200, 5))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    blocks = cluster.Cover(x[::20], float(np.arccos(1 - eps)))
    home, angle = blocks.home(x)
    np.maximum.at(blocks.radius, home, angle)
    at = [set(b.tolist()) for b in blocks.blocks(x, home)]
    near = x @ x.T >= 1 - eps
    for i, j in zip(*np.nonzero(near), strict=True):
        assert max(home[i], home[j]) in at[i] & at[j]
    if eps < 0.1:
        assert sum(map(len, at)) < 0.5 * len(x) * len(blocks.pivots)


def test_clusters_by_blocks_and_tiles(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(12, 6))[rng.integers(0, 12, 150)] + 0.15 * rng.normal(size=(150, 6)), rng.normal(size=(60, 6))])
    odd = [(1000, [0.0] * 6), (1001, None), (1002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1003, [1.0, 2.0]), (1004, [float("nan")] * 6)]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *odd], "id long, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for eps, least in ((0.1, 3), (0.3, 2)):
        near = u @ u.T >= 1 - eps
        cores = near.sum(1) >= least
        label = np.arange(len(x))
        for _ in range(len(x)):
            label = np.where(cores, [label[near[i] & cores].min() if cores[i] else i for i in range(len(x))], label)
        rank = {v: n for n, v in enumerate(sorted(set(label[cores].tolist())))}
        want = {i: rank[label[i]] if cores[i] else min((rank[label[j]] for j in np.flatnonzero(near[i] & cores)), default=-1) for i in range(len(x))}
        got = {r.id: r.cluster for r in cluster.density_clusters(df, eps, least, size=16, tile=8).collect()}
        assert got == want | {i: -1 for i, _ in odd}
    assert cluster.density_clusters(df.limit(0)).count() == 0 and {r.cluster for r in cluster.density_clusters(df.where("id > 1003")).collect()} == {-1}


def test_split_join_equals_join(spark):
    many = spark.createDataFrame([(i, None if i % 50 == 0 else i % 3 if i % 2 else i) for i in range(3000)], "v long, k long")
    one = spark.createDataFrame([(k, f"{k}-{n}") for k in range(0, 200) for n in range(1 + k % 2)], "k long, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        split = skewed.split_join(many, one, "k", F.col("v"), how, most=50)
        assert "__pieces" in split._jdf.queryExecution().toString() or "__salt" in split._jdf.queryExecution().toString()
        assert sorted(map(str, split.collect())) == sorted(map(str, many.join(one, "k", how).collect()))


def test_components_of_a_hub_and_a_path(spark):
    edges = [(7, i) for i in range(100, 1500)] + [(i, i + 1) for i in range(5000, 5100)] + [(9, 9)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {7: 7, 9: 9} | {i: 7 for i in range(100, 1500)} | {i: 5000 for i in range(5000, 5101)}
