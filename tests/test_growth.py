"""What copies and long inputs must not multiply: rows that operators make, jobs that they run, work that they repeat."""

import collections
import json
import os
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomery.functions import similarity
from loomery.functions import text as X
from loomery.operators import cluster, link, matching, nested, stats, validate
from loomery.plans import linking
from loomery.sources import sinks
from loomery.sources.ledger import Ledger


def rows_made(df):
    """The most rows that an operator of the plan made, from the metrics of the run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            plan.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return most


def test_two_branches_multiplies_no_copies(spark):
    """300 equal mentions and 300 synonyms of that name: 300 links, not 90,000."""
    mentions = spark.range(300).select(F.lit("a").alias("mention"), F.lit("f").alias("formula"))
    names = spark.range(300).select(F.lit("a").alias("synonym"), F.col("id").cast("string").alias("id"))
    formulas = names.select(F.lit("f").alias("synonym"), F.concat(F.lit("f"), "id").alias("id"))
    df = link.two_branches(mentions, names, formulas)
    assert df.first().ids == sorted([str(i) for i in range(300)] + [f"f{i}" for i in range(300)])
    assert rows_made(df) <= 1000


def test_in_place_gathers_no_shared_ids_by_record(spark):
    """Ids that many records share are put in where they are met; before, each record's map of them was exchanged and sorted."""
    base = spark.createDataFrame([(n, f"{n}{i}") for n in "abc" for i in range(4)], "synonym string, id string")
    rows = [(i, random.Random(i).choice(["a", "b", "x", None]), "c" if i % 2 else None, [("b",), ("y",), (None,), ("a",)][: i % 5] if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, x string, y string, z array<struct<n:string>>").select("k", F.struct("x", F.struct("y").alias("in"), "z").alias("r"))
    ids = lambda v: [f"{v}{i}" for i in range(4)] if v in ("a", "b", "c") else []
    got = link.in_place(df, "k", "r", ["x", "in.y", "z[*].n", "z[1].n"][:3], lambda m: link.exact(m, base))
    assert got.columns == ["k", "r"]
    told = {r.k: ((r.r.x.value, r.r.x.sameAs), (r.r["in"].y.value, r.r["in"].y.sameAs), None if r.r.z is None else [(m.n.value, m.n.sameAs) for m in r.r.z]) for r in got.collect()}
    assert told == {k: ((x, ids(x)), (y, ids(y)), None if z is None else [(n, ids(n)) for (n,) in z]) for k, x, y, z in rows}
    plain = link.in_place(df, "k", "r", ["x", "in.y"], lambda m: link.exact(m, base))
    assert "map_from_entries" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_in_place_puts_heavy_mentions_apart(spark, sf, monkeypatch):
    """A task puts out the ids of one heavy mention; before, a Parquet writer met the long ids of several in one task, behind
    rows without any, and held thousands of them. The text of the ids is made once for a mention; before, in each record."""
    monkeypatch.setattr(link, "SHARE", 20)
    base = spark.createDataFrame([(n, f"{n}{i}") for n in "abcdef" for i in range(4)], "synonym string, id string")
    names = [*"abcdef", "x", "y", None]
    rows = [(i, names[i % 9]) for i in range(900)] + [(900 + i, f"few{i % 10}") for i in range(50)] + [(950, "f"), (951, "a")]
    df = spark.createDataFrame(rows, "k long, x string").select("k", F.struct("x").alias("r"))
    ids = lambda v: [f"{v}{i}" for i in range(4)] if v and v in "abcdef" else []
    text = lambda c: F.array_join(c, ",")
    for more, of in (({}, ids), ({"form": text}, lambda v: ",".join(ids(v)))):
        done = link.in_place(df, "k", "r", ["x"], lambda m: link.exact(m, base), **more)
        assert done.columns == ["k", "r"]
        got = done.withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.k, r.r.x.value, r.r.x.sameAs) for r in got) == [(k, x, of(x)) for k, x in rows]
        tasks = collections.defaultdict(set)
        for r in got:
            if r.r.x.sameAs:
                tasks[r.task].add(r.r.x.value)
        assert len(tasks) > 6 and all(len(t) == 1 for t in tasks.values())
    assert "array_join" not in linking.in_place(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_best_looks_at_each_synonym_once(spark):
    """Copies of a synonym under other ids change nothing and are not compared again."""
    base = spark.createDataFrame([("zinc oxide", "1"), ("red bolt", "2")], "synonym string, id string")
    many = base.crossJoin(spark.range(200).select(F.col("id").alias("n"))).select("synonym", F.col("n").cast("string").alias("id"))
    asked = spark.createDataFrame([("zinc oxid",), ("bolt red",), ("red bolts",)], "mention string")
    one, two = link.best(asked, base, 85), link.best(asked, many, 85)
    assert collections.Counter(one.collect()) == collections.Counter(two.collect()) and one.count() == 3
    assert rows_made(two) <= 100


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_to_one_takes_many_groups_at_a_time(spark):
    """Python gets 500 small groups together, not one by one; each is settled as it is by itself."""
    rng = random.Random(4)
    rows = [(k, g, p, rng.choice([0.0, 0.25, 0.5, 0.75, 1.0])) for k in range(500) for g in range(3) for p in range(2)]
    scored = spark.createDataFrame(rows, "k long, g long, p long, score double")
    got = matching.one_to_one(scored, ["k"])
    assert "FlatMapGroupsInPandas [__task" in optimized(got)
    best = collections.defaultdict(float)
    for k in range(500):
        s = {(g, p): x for j, g, p, x in rows if j == k}
        best[k] = max(s[a, 0] + s[b, 1] for a in range(3) for b in range(3) if a != b)
    found = collections.defaultdict(float)
    for r in got.collect():
        found[r.k] += r.score
    assert all(abs(found[k] - best[k]) < 1e-9 for k in range(500))


def test_ledger_asks_in_one_job(spark, tmp_path):
    """Twenty portions are one run: before, each was a job that read all that was left."""
    model = lambda frames: (pd.DataFrame({"k": f["k"], "reply": f["k"].astype(str)}) for f in frames)
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", "k long", "reply string", portion=10)
    assert {(r.k, r.reply) for r in ledger.ask(spark.range(200).toDF("k"), model).collect()} == {(i, str(i)) for i in range(200)}
    assert len([x for x in os.listdir(tmp_path / "ledger") if x.startswith("run=")]) == 1


def test_chunks_split_a_text_once(spark):
    df = spark.createDataFrame([("a b c d e",), ("",), (None,)], "t string").select(X.token_chunks(F.filter(F.split("t", " "), lambda w: w != ""), 6).alias("c"))
    assert [r.c for r in df.collect()] == [[["a", "b"], ["c", "d"], ["e"]], None, None] and optimized(df).count("split(") == 1


def exchanged(df):
    """Columns that the plan's exchanges of rows carry, by node."""
    df.collect()
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning" in x]


def test_leaves_dealt_by_record_stay(spark):
    """Leaves of records that are dealt by their key are not exchanged again to become a wide table."""
    records = spark.range(40).repartition("id")
    leaves = records.select("id", F.explode(F.expr("array(struct('a' as path, 1 as nth, 'x' as value), struct('a' as path, 0 as nth, null as value), struct('b' as path, 0 as nth, 'z' as value), struct('c' as path, 0 as nth, 'z' as value))")).alias("x")).select("id", "x.*")
    leaves = leaves.where("path <> 'b' or id % 2 = 0")
    df = sinks.wide(leaves, ["id"], ["a", "b"])
    assert sorted(df.collect()) == [(i, ", x", "z" if i % 2 == 0 else "") for i in range(40)]
    assert len(exchanged(df)) == 1


def test_statistics_expand_no_rows(spark):
    """Distinct values beside each other are counted without a copy of every row for each of them."""
    leaves = spark.createDataFrame([("p", 1, "x"), ("p", 1, "x"), ("p", 2, "3"), ("q", 1, "4"), ("q", None, "y"), ("p", 3, "")], "path string, doc int, value string")
    df = stats.property_statistics(leaves, list_most=5)
    assert sorted(df.collect()) == [("p", 2, 3, 1, 3.0, 3.0, ["x"]), ("q", 1, 2, 1, 4.0, 4.0, ["y"])]
    assert "Expand" not in optimized(df)


def test_points_without_clusters_are_copied_a_bounded_number_of_times(spark):
    """Every point near to some and to none: each visits most blocks of a cover, so all stand in one, dealt in few tiles.
    Before, the tiles' number grew with the points, and with it the copies of each."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 24))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    for eps, least in ((0.4, 2), (0.45, 4)):
        near = u @ u.T >= 1 - eps
        cores = near.sum(1) >= least
        label = np.arange(len(x))
        for _ in range(60):
            label = np.where(cores, [label[near[i] & cores].min() if cores[i] else i for i in range(len(x))], label)
        rank = {v: n for n, v in enumerate(sorted(set(label[cores].tolist())))}
        want = {i: rank[label[i]] if cores[i] else min((rank[label[j]] for j in np.flatnonzero(near[i] & cores)), default=-1) for i in range(len(x))}
        assert {r.id: r.cluster for r in cluster.density_clusters(df, eps, least, size=16, tile=16).collect()} == want
    reach = float(np.arccos(1 - 0.4))
    found, placed = cluster.cover(df.withColumn("h", F.xxhash64("id")), reach, 16)
    blocks, placed = cluster.thrifty(placed, found, 16, 24)
    points = placed.select("id", "vec", "home", F.lit(1).alias("w"), F.lit(0).alias("c"))
    assert rows_made(cluster.meet(points, blocks, 0.4, cluster._Weights, "id long, k long", 16, 32)) <= (cluster.TILES + 1) * len(x)


def test_rebuild_meets_once_and_levels_need_no_pass(spark):
    """Deep trees, keys that look odd, values that repeat, records larger than a batch: one window, no aggregation by level."""
    rows = [(i, f"a.b[{j}].c[{k}].d", str(100 * i + 10 * j + k)) for i in range(30) for j in range(i % 4) for k in range(1 + j)]
    rows += [(50, f"l[{j}].x", str(j)) for j in range(25_000)] + [(51, "m.[0]", "1"), (51, "m.k", "2"), (51, 'p%s"q', '"5%"'), (51, "w[1].v", "4"), (51, "w.[1].v", "3"), (51, "u", "1"), (51, "u", "0"), (51, "u.t", "null"), (51, "", "7")]
    df = spark.createDataFrame(rows, "id long, path string, value string").repartition(3)
    made = nested.rebuild(df, "id")
    got = {r.id: json.loads(r.j) for r in made.select("id", F.to_json("record").alias("j")).collect()}
    want = {i: {"a": {"b": [{"c": [{"d": 100 * i + 10 * j + k} for k in range(1 + j)]} for j in range(i % 4)]}} for i in range(30) if i % 4}
    assert got == want | {50: {"l": [{"x": j} for j in range(25_000)]}, 51: {"m": {"k": 2, "[0]": 1}, 'p%s"q': "5%", "w": [{"v": [3, 4]}], "u": {"t": None}, "": 7}}
    texts = spark.createDataFrame([(None, "a", 'x"\\\n'), (None, "b", "ä"), (1, "a", "2")], "id long, path string, value string")
    assert {r.id: json.loads(r.j) for r in nested.rebuild(texts, "id", texts=True).select("id", F.to_json("record").alias("j")).collect()} == {None: {"a": 'x"\\\n', "b": "ä"}, 1: {"a": "2"}}
    assert "Aggregate" not in optimized(made) and optimized(made).count("Window") == 1


def test_leaves_work_out_each_part_once(spark):
    """What stands in a record is named once in the expression; before, each level named all below it twice."""
    schema = "struct<a: struct<b: struct<c: struct<d: struct<x: double, y: float, z: bigint, t: boolean, s: string>>>>, l: array<array<double>>>"
    texts = ['{"a": {"b": {"c": {"d": {"x": 1e10, "y": 0.1, "z": 7, "t": false, "s": "q\\"\\\\\\n"}}}}, "l": [[1.5, null], [], null]}', '{"a": {"b": {"c": {}}}, "l": []}', "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, j string").withColumn("r", F.from_json("j", schema))
    made = nested.leaves(df, "r", "id")
    assert sorted(map(tuple, made.collect())) == sorted([
        (0, "a.b.c.d.x", "1.0E10"), (0, "a.b.c.d.y", "0.1"), (0, "a.b.c.d.z", "7"), (0, "a.b.c.d.t", "false"), (0, "a.b.c.d.s", '"q\\"\\\\\\n"'), (0, "l[0][0]", "1.5"), (0, "l[0][1]", "null"), (0, "l[1]", "[]"), (0, "l[2]", "null"),
        (1, "a.b.c", "{}"), (1, "l", "[]"), (2, "(root)", "{}")])
    assert 0 < made._jdf.queryExecution().analyzed().toString().count(".d.z") <= 4


def test_a_pair_of_texts_is_scored_once_a_task(spark, tmp_path):
    """Equal pairs that come again are remembered; token sets are as before."""
    asked = tmp_path / "asked"

    def score(p, q):
        with asked.open("a") as f:
            f.write("x")
        return 1.0 if p == q else None

    df = spark.range(3000, numPartitions=1).select((F.col("id") % 2).cast("string").alias("a"), F.when(F.col("id") % 3 > 0, "1").alias("b"))
    assert df.where(similarity._by_pair(score)("a", "b") == 1.0).count() == 1000 and len(asked.read_text()) == 4
    texts = ["a b", "b  a c", "zinc oxide", "oxide zinc film", "zinc oxid", "", " \t", None, "a b"]
    pairs = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string")
    got = {(r.a, r.b): r.s for r in pairs.withColumn("s", similarity.token_set_ratio(F.col("a"), F.col("b"))).collect()}
    assert got["a b", "b  a c"] == 100.0 and got["", None] == got[" \t", "a b"] == 0.0 and got[None, "a b"] is got[None, None] is None
    assert got["zinc oxid", "oxide zinc film"] == 200.0 * 9 / 24  # "zinc oxid" in "zinc film oxide"


def test_schema_asks_only_for_what_it_needs(spark):
    """A field that must be a whole number is not taken apart as an object and a list."""
    df = spark.createDataFrame([(1, '{"a": 1, "e": "x", "n": 2}'), (2, '{"a": "1", "e": true, "n": [2]}'), (3, '{"a": {"b": 1}, "e": null, "n": 1.5}')], "doc int, j string")
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "e": {"enum": ["x", 3, None]}, "n": {"anyOf": [{"const": 2}, {"type": "array"}]}}}
    made = validate.schema_violations(df, "doc", "j", schema)
    assert sorted((r.doc, r.path, r.rule) for r in made.collect()) == [(2, "a", "type"), (2, "e", "enum"), (3, "a", "type"), (3, "n", "anyOf")]
    assert made._jdf.queryExecution().analyzed().toString().count("variant_get(") <= 6  # before: 28


def test_profile_copies_no_rows(spark):
    """Documents and ids are counted by type and over all types without copies of the rows; nulls are groups, not values."""
    rows = [("s", "a", 1, "x", True), ("s", "b", 1, "x", False), ("s", None, 2, None, None), ("t", "a", None, "y", True), ("t", "a", 3, "z", True), ("t", "a", 3, "z", False)]
    df = spark.createDataFrame(rows, "split string, kind string, doc int, id string, new boolean")
    made = stats.dataset_profile(df, "split", "kind", "doc", "id", F.col("new"))
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, [("s", "a", 1, 1, 1, 1.0), ("s", "b", 1, 1, 1, 0.0), ("s", None, 1, 1, 0, None), ("s", "all", 2, 3, 1, 0.5), ("t", "a", 1, 3, 2, 0.666667), ("t", "all", 1, 3, 2, 0.666667)]))
    assert "Expand" not in optimized(made)
