"""Ledgers of model calls, running tables of feeds, sketches, and the similarity branch of the evaluation by ids."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomery.operators import idmatch, judge, sketches, stats
from loomery.plans import mechanisms
from loomery.sources import records
from loomery.sources.ledger import Ledger
from loomery.streaming import feed
from tests.test_more_operators import set_ratio


def counting(folder, broken=None):
    """A judge that leaves a mark for each call, and breaks at one document."""

    def model(frames):
        for f in frames:
            for i, r in zip(f["doc_id"], f["rubric"], strict=True):
                if i == broken:
                    raise RuntimeError("the model went away")
                with open(f"{folder}/{i}-{r}", "a") as out:
                    out.write("x")
            yield pd.DataFrame({"doc_id": f["doc_id"], "rubric": f["rubric"], "rating": (f["doc_id"] % 5).where(f["doc_id"] != 3).astype("Int32"), "rationale": "r"})

    return model


def calls(folder):
    return {name: os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder)}


def test_ledger_repeats_no_call(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    docs = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    rubrics = spark.createDataFrame([("a", "", True), ("b", "", True), ("c", "", False)], "rubric string, description string, enabled boolean")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", "doc_id long, rubric string, judge string", "rating int, rationale string", portion=20)
    with pytest.raises(Exception):  # noqa: B017  in the midst of the portions
        judge.rate(docs, rubrics, [("one", counting(marks, broken=17))], ledger).count()
    done = ledger.known().count()
    assert done < 78
    before = calls(marks)
    first = judge.rate(docs, rubrics, [("one", counting(marks))], ledger)
    assert first.count() == 78 and first.count() == 78  # a second action
    after = calls(marks)
    kept = sum(1 for name in before if after[name] == before[name])
    assert kept >= done and all(n == 1 for name, n in after.items() if name not in before)
    asked_again = judge.rate(docs, rubrics, [("one", counting(marks))], ledger)
    assert asked_again.count() == 78
    assert {name for name, n in calls(marks).items() if n != after[name]} == {"3-a", "3-b"}  # failed ones are asked again
    two = judge.rate(docs, rubrics, [("one", counting(marks)), ("two", counting(marks))], ledger)
    assert two.groupBy("judge").count().collect() and {r.judge: r["count"] for r in two.groupBy("judge").count().collect()} == {"one": 78, "two": 78}


def test_rate_without_ledger_calls_once(spark, tmp_path):
    docs = spark.createDataFrame([(i,) for i in range(4, 9)], "doc_id long")
    rubrics = spark.createDataFrame([("a", "", True)], "rubric string, description string, enabled boolean")
    got = judge.rate(docs, rubrics, [("one", counting(tmp_path))])
    assert got.count() == got.count() == 5 and set(calls(tmp_path).values()) == {1}


def test_ledger_of_nothing(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/none", "doc_id long", "reply string")
    assert ledger.known().count() == ledger.ask(spark.createDataFrame([], "doc_id long"), counting(tmp_path)).count() == 0


def test_replayed_batch_counts_once(spark, tmp_path):
    target = f"file://{tmp_path}/running"
    assert feed.running(spark, target) is None
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    table = lambda: {r.k: (r.n, r.total, r.least, r.most) for r in feed.running(spark, target).collect()}
    feed.merge_counts(batch(("a", 1), ("a", 5), ("b", None)), 0, ["k"], "v", target)
    feed.merge_counts(batch(("a", 2), ("c", 7)), 1, ["k"], "v", target)
    want = {"a": (3, 8, 1, 5), "b": (0, None, None, None), "c": (1, 7, 7, 7)}
    assert table() == want
    feed.merge_counts(batch(("a", 2), ("c", 7)), 1, ["k"], "v", target)  # the batch comes again
    assert table() == want
    feed.merge_counts(batch(("c", 1)), 2, ["k"], "v", target)
    feed.merge_counts(batch(("c", 1)), 3, ["k"], "v", target)
    assert table()["c"] == (3, 9, 1, 7) and sorted(p for p in os.listdir(tmp_path / "running")) == ["version=2", "version=3"]


def test_feed_takes_files_once_and_batch_by_batch(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"file://{tmp_path}/running"
    write = lambda *rows: spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(source)
    run = lambda: feed.running_counts(spark, source, "k string, v int", lambda b: b.where("v > 0"), ["k"], "v", target, f"{tmp_path}/log", files=1).awaitTermination()
    write(("a", 1), ("a", -1)), write(("b", 2))
    run()
    write(("a", 4))
    run(), run()
    assert {r.k: (r.n, r.total) for r in feed.running(spark, target).collect()} == {"a": (2, 5), "b": (1, 2)}
    assert feed._versions(spark, target)[-1] == 2


def test_sketches_merge_and_replace(spark):
    df = spark.range(40_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 9000).alias("v"), F.lit("x").alias("k"))
    daily = sketches.distinct_sketches(df, ["k", "day"], "v")
    assert abs(sketches.merged(daily).select(sketches.estimate("sketch")).first()[0] / 9000 - 1) < sketches.error_bound(14)
    again = sketches.distinct_sketches(df.where("day = 3").limit(10), ["k", "day"], "v")
    kept = {r.day: r.n for r in sketches.replaced(daily, again, "day").select("day", sketches.estimate("sketch").alias("n")).collect()}
    assert len(kept) == 7 and kept[3] == 10 and kept[2] > 1000
    assert sketches.error_bound(14) < 0.03 and sketches.merged(sketches.distinct_sketches(df.limit(0), ["k"], "v"), "k").count() == 0


def test_similar_ids_equal_brute_force(spark, sf):
    part = {r.p_partkey: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    key = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag = 'R' or l_discount >= 0.05").collect()
    gold, predicted, n_gold = {}, {}, 0  # by line number, which some orders have twice
    for r in (r for r in lines if r.l_partkey in part):
        at, name = (r.l_orderkey, r.l_linestatus), part[r.l_partkey].p_name
        if r.l_returnflag == "R":
            n_gold += 1
            gold.setdefault(at, {}).setdefault(r.l_linenumber, []).append(key((name := name.upper())[:2] + name[3:]))
        if r.l_discount >= 0.05:
            p = part[r.l_partkey]
            predicted.setdefault(at, {}).setdefault(r.l_linenumber, []).extend(key(s) for s in (p.p_type, p.p_brand, p.p_name))
    near = {}

    def hit(golds, names):
        return any(near.setdefault((g, n), set_ratio(g, n)) >= 85 for g in golds for n in names)

    tp = 0
    for at, golds in gold.items():
        said = sorted(predicted.get(at, {}).items())
        if at[1] == "O":
            free = sorted(golds)
            for _, names in said:
                if (found := next((g for g in free if hit(golds[g], names)), None)) is not None:
                    free.remove(found)
                    tp += 1
        else:
            tp += sum(any(hit(g, names) for _, names in said) for g in golds.values())
    overall = {r.category: r for r in mechanisms.similar_ids(spark, sf).collect()}["overall"]
    assert overall.tp == tp > 0 and overall.tp + overall.fn == n_gold


def test_more_synonyms_than_are_compared(spark):
    known = spark.createDataFrame([("1", "q", None, [f"other {i}" for i in range(200)] + ["zinc oxide"])], "id string, name string, formula string, synonyms array<string>")
    gold = spark.createDataFrame([(1, 0, "zinc oxid")], "doc long, g long, text string")
    predicted = spark.createDataFrame([(1, 0, ["1"], None)], "doc long, p long, ids array<string>, value string")
    assert idmatch.name_matches(gold, predicted, known, ["doc"], 85).count() == 0 and idmatch.name_matches(gold, predicted, known, ["doc"], 85, synonyms=None).count() == 1


def test_documents_of_one_name(spark):
    docs = spark.createDataFrame([("a", "x/a.md", "one"), ("a", "w/a.txt", "two"), ("b", "x/b.md", None)], "stem string, path string, text string")
    found = spark.createDataFrame([("m/a.json",), ("m/b.json",), ("m/c.json",), (None,)], "path string")
    assert {r.path: r.text for r in records.of_document(found, docs, "left").collect()} == {"m/a.json": "two", "m/b.json": None, "m/c.json": None, None: None}
    assert records.of_document(found, docs).count() == 2


def test_relations_by_arity(spark):
    df = spark.createDataFrame([("s", "k", 1, "a", "b", None, True), ("s", "k", 1, "a", "b", "c", False), ("s", "l", 2, "a", None, None, True), ("s", "l", 2, "a", "b", None, False)], "split string, kind string, doc long, x string, y string, z string, novel boolean")
    got = {(r.kind, r.arity): (r.relations, r.docs, r.novel) for r in stats.relation_profile(df, "split", "kind", "doc", ["x", "y", "z"], F.col("novel")).collect()}
    assert got == {("k", 2): (1, 1, 1.0), ("k", 3): (1, 1, 0.0), ("l", 2): (1, 1, 0.0), ("all", 2): (2, 2, 0.5), ("all", 3): (1, 1, 0.0)}
