"""Matching by ids, assignments, linking and clustering against brute force; small readers and sinks."""

import itertools
import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions import similarity as S
from loomery.functions import text as X
from loomery.operators import choose, cluster, evaluate, graph, idmatch, judge, link, matching, nested, stats
from loomery.plans import texts
from loomery.sources import corpora, kb, records, sinks
from loomery.streaming import feed


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 100.0 if a == b else 200 * lcs(a, b) / (len(a) + len(b))


def set_ratio(a, b):
    x, y = sorted(set(a.split())), sorted(set(b.split()))
    if not x or not y:
        return 0.0
    both = [t for t in x if t in y]
    if both and len(both) in (len(x), len(y)):
        return 100.0
    one, two = (" ".join(both + [t for t in s if t not in both]) for s in (x, y))
    c = " ".join(both)
    return max([ratio(one, two)] + ([ratio(c, one), ratio(c, two)] if both else []))


def test_edit_and_set_ratio_equal_brute_force(spark, sf):
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    for r in texts.edit_ratios(spark, sf).collect():
        a, b = names[r.p_partkey], names[r.other]
        assert abs(r.ratio - ratio(a, b)) < 1e-5 and abs(r.set_ratio - set_ratio(a, b)) < 1e-5
    rows = [("zinc oxide film", "oxide zinc"), ("a b c", "a b d"), ("", "x"), ("one two", "three four"), ("abc def", "abd def")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.token_set_ratio(F.col("a"), F.col("b")).alias("r"))
    assert all(abs(r.r - set_ratio(r.a, r.b)) < 1e-9 for r in df.collect())


def test_rouge_l_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choices("abcd", k=rng.randint(0, 9))), " ".join(rng.choices("abcd", k=rng.randint(0, 9)))) for _ in range(60)]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", S.rouge_l(F.col("a"), F.col("b")).alias("r")).collect():
        n, a, b = lcs(r.a.split(), r.b.split()), len(r.a.split()), len(r.b.split())
        assert abs(r.r.precision - (n / a if a else 0)) < 1e-12 and abs(r.r.recall - (n / b if b else 0)) < 1e-12


def test_unicode_query_equals_python(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.n_decomposed == len(unicodedata.normalize("NFKD", docs[r.doc_id])) for r in texts.unicode_keys(spark, sf).collect())


def test_best_equals_brute_force(spark):
    synonyms = ["zinc oxide", "oxide of zinc", "indium oxide", "trimethylaluminium", "Zn", "water", "ozone", "di ethyl zinc", "zinc acetate dihydrate"]
    asked = ["zinc oxid", "oxide zinc", "ZN", "trimethyl aluminium", "trimethylaluminum", "wat", "zinc oxide of an unknown sort", "dihydrate zinc acetate", "nothing", "", "ozone", "diethyl zinc"]
    base = spark.createDataFrame([(s, str(i)) for i, s in enumerate(synonyms)], "synonym string, id string")
    got = {r.mention: (r.synonym, round(r.score, 6)) for r in link.best(spark.createDataFrame([(a,) for a in asked], "mention string"), base, 85).collect()}
    expected = {}
    for a in filter(None, asked):
        scored = []
        for s in synonyms:
            score = 100.0 if a.lower() in s.lower() else ratio(a, s)
            score = score if score >= 85 else set_ratio(a, s)
            if score >= 85:
                scored.append((-round(score, 6), s))
        if scored:
            expected[a] = (min(scored)[1], -min(scored)[0])
    assert got == expected


def test_cascade_equals_brute_force(spark, sf):
    from loomery.plans import linking

    base = [(r.synonym, r.id) for r in linking._kb(spark, sf).collect()]
    expected = {}
    for a in {r.mention for r in linking._mentions(spark, sf).collect()}:
        ids = {i for s, i in base if s == a}
        stage = "exact"
        if not ids:
            near = [s for s, _ in base if ratio(a, s.lower()) >= 90]
            ids, stage = ({i for s, i in base if s == min(near)}, "fuzzy") if near else (set(), "none")
        expected[a] = (",".join(sorted(ids)), stage)
    assert {r.mention: (r.ids, r.stage) for r in linking.cascade(spark, sf).collect()} == expected


def test_soft_match_has_the_greatest_total(spark):
    rng = random.Random(8)
    words = "red blue big small ring bolt".split()
    rows = [(d, i, side, " ".join(rng.sample(words, 2))) for d in range(12) for side in "gp" for i in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "doc long, id long, side string, text string")
    gold, predicted = (df.where(F.col("side") == x).drop("side") for x in "gp")
    got = {r.doc: (r.tp, r.fp, r.fn) for r in matching.soft_counts(gold, predicted, ["doc"]).collect()}
    alike = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    for d in range(12):
        g, p = ([t for doc, _, side, t in rows if doc == d and side == x] for x in "gp")
        short, long_ = sorted((g, p), key=len)
        ways = [[alike(a, long_[j]) for a, j in zip(short, way, strict=True)] for way in itertools.permutations(range(len(long_)), len(short))]
        best = max(map(sum, ways))
        hits = {sum(x >= 0.8 for x in w) for w in ways if abs(sum(w) - best) < 1e-9}
        assert got[d][0] in hits and got[d][1:] == (len(p) - got[d][0], len(g) - got[d][0])


def test_lookup_narrows_substrings(spark):
    base = spark.createDataFrame([("zinc oxide", "1"), ("zinc", "2"), ("Z", "3")], "synonym string, id string")
    asked = spark.createDataFrame([("Zinc Oxides",), ("zinc",), (None,), ("q",)], "mention string")
    assert {(r.mention, r.id) for r in link.lookup(asked, base).collect()} == {("Zinc Oxides", "1"), ("Zinc Oxides", "2"), ("Zinc Oxides", "3"), ("zinc", "2")}
    assert {(r.mention, r.id) for r in link.lookup(asked, base, 70).collect()} == {("Zinc Oxides", "1"), ("zinc", "2")}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7000, 7000)]
    up = {x: x for e in edges for x in e}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def test_assignment_by_components_equals_whole_groups(spark):
    rng = random.Random(5)
    rows = [(d, g, p, round(rng.random(), 3)) for d in range(3) for g in range(12) for p in range(12) if rng.random() < 0.15]
    df = spark.createDataFrame(rows, "doc long, g long, p long, score double")
    total = lambda x: round(sum(r.score for r in x.collect()), 6)
    assert total(matching.one_to_one(df, ["doc"])) == total(matching.one_to_one(df, ["doc"], most=3))


def test_token_alignment_and_embedding_match(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(3, 4)), rng.normal(size=(4, 4))
    df = lambda x: spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "pair long, idx long, vec array<double>")
    cos = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    best = max(sum(max(cos[i, j], 0) for i, j in enumerate(p)) for p in itertools.permutations(range(4), 3))
    assert abs(matching.token_alignment(df(a), df(b)).first().score - best / 4) < 1e-9
    scored = spark.createDataFrame([(1, 0, 0, 0.9, 0.5, 0.6), (1, 0, 1, 0.8, 0.9, 0.8), (1, 1, 0, 0.1, 0.2, 0.15)], "doc long, g long, p long, precision double, recall double, f1 double")
    side = lambda *d: spark.createDataFrame([(x,) for x in d], "doc long")
    rows = {r.doc: (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6)) for r in matching.embedding_match(scored, side(1, 1, 2), side(1, 1), ["doc"]).collect()}
    assert rows == {1: (0.45, 0.55, 0.475), 2: (0, 0, 0)}


def test_evaluation_by_ids(spark):
    folders = spark.createDataFrame([(1, "ZnO", ["DEZ", "H2O"]), (2, "IGZO", ["InMe3", "GaMe3", "ZnEt2", "O3"]), (3, "ZnO", ["DEZ"])], "doc long, material string, annotations array<string>")
    gold = idmatch.annotated(folders, ["doc"], "material", "annotations")
    said = {(r.doc, r.category, r.text) for r in gold.collect()}
    assert said == {(1, "material", "ZnO"), (1, "precursor", "DEZ"), (1, "coreactant", "H2O"), (2, "material", "IGZO"), (2, "precursor", "InMe3"), (2, "precursor", "GaMe3"), (2, "precursor", "ZnEt2"), (2, "coreactant", "O3"), (3, "material", "ZnO")}
    known = spark.createDataFrame([("1", "zinc oxide", "ZnO", ["Zn O"]), ("2", "diethylzinc", "C4H10Zn", ["DEZ", "ZnEt2"]), ("3", "trimethylindium", None, None)], "id string, name string, formula string, synonyms array<string>")
    predicted = spark.createDataFrame([(1, "material", 0, ["1"], None), (1, "precursor", 0, ["2"], "x"), (1, "precursor", 1, [], "dez!"), (1, "coreactant", 0, [], "water"), (2, "precursor", 0, ["2", "9"], None), (2, "precursor", 1, [], "InMe-3"), (3, "precursor", 0, ["2"], None), (3, "coreactant", 0, ["2"], None)], "doc long, category string, p long, ids array<string>, value string")
    how = {"material": "greedy", "precursor": "coverage", "coreactant": "greedy"}
    rows = {r.category: (r.tp, r.fp, r.fn) for r in idmatch.by_ids(gold, predicted, known, ["doc"], how).collect()}
    assert rows == {"material": (1, 0, 2), "precursor": (3, 1, 1), "coreactant": (0, 2, 2), "overall": (4, 3, 5)}
    near = spark.createDataFrame([(1, "material", 0, ["3"], None)], predicted.schema)
    asked = spark.createDataFrame([(1, "material", 0, "trimethyl-indiun")], "doc long, category string, g long, text string")
    assert idmatch.name_matches(asked, near, known, ["doc", "category"], None).count() == 0 and idmatch.name_matches(asked, near, known, ["doc", "category"], 85).count() == 1


def test_clusters_of_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 8))
    vectors = [c + 0.05 * rng.normal(size=8) for c in centres for _ in range(4)] + [np.array([5.0, *[0.0] * 7])] * 3 + [np.zeros(8)] * 3 + [rng.normal(size=8) * 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<double>")
    x = np.array(vectors)
    norm = np.linalg.norm(x, axis=1)
    for least in (1, 2, 3):
        near = [{j for j in range(len(x)) if norm[i] and norm[j] and x[i] @ x[j] / norm[i] / norm[j] >= 0.8 - 1e-12} | {i} for i in range(len(x))]
        cores = [i for i in range(len(x)) if len(near[i]) >= least]
        label = {i: i for i in cores}
        for _ in cores:
            label = {i: min(label[j] for j in near[i] if j in label) for i in cores}
        rank = {v: n for n, v in enumerate(sorted(set(label.values())))}
        expected = {i: rank[label[i]] if i in label else min((rank[label[j]] for j in near[i] if j in label), default=-1) for i in range(len(x))}
        assert {r.id: r.cluster for r in cluster.density_clusters(df, 0.2, least).collect()} == expected


def test_choosing(spark):
    assert choose.names("abcd", "abd", "b") == ["a", "d"] and choose.names("ab") == ["a", "b"]
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    assert [r.c for r in df.select(choose.linked_or_raw(F.col("b"), F.lit("raw")).alias("c")).collect()] == ["x", "raw"]
    assert choose.where_given(df, a=None, b="x").count() == 1
    assert [r.m for r in df.select(X.matching(F.array(F.lit("Abc"), F.lit("d")), F.lit("B")).alias("m")).limit(1).collect()] == [["Abc"]]
    assert [r.p for r in df.orderBy("a").select(X.printable(F.col("b")).alias("p")).collect()] == ["x", ""]


def test_sinks(spark, tmp_path):
    raw = spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "text string")
    good, bad = sinks.parsed_or_rejects(raw, "text")
    assert (good.count(), bad.count()) == (1, 2)
    ratings = spark.createDataFrame([(1, 0, 0, 1.0, 1.0, 1.0)], "tp long, fp long, fn long, precision double, recall double, f1 double")
    sinks.write_ratings(ratings, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().f1 == 1.0
    for wrong in (ratings.drop("f1"), ratings.withColumn("f1", F.lit(2.0)), ratings.withColumn("tp", F.lit("x"))):
        with pytest.raises(ValueError):
            sinks.write_ratings(wrong, str(tmp_path / "w"))
    sinks.write_documents(spark.createDataFrame([("m", 1), ("n", 2)], "model string, x long"), str(tmp_path / "d"), "model")
    assert {(r.model, r.x) for r in spark.read.json(str(tmp_path / "d")).collect()} == {("m", 1), ("n", 2)}


def test_readers(spark, tmp_path):
    rows = spark.createDataFrame([(["a", "b", "c"], [1, 2], ["x"])], "t array<string>, two array<int>, one array<string>")
    r = rows.select(corpora.span_text(F.col("t"), F.lit(1), F.lit(3)).alias("s"), corpora.relation_tuple(F.col("two"), ["a", "b", "c"]).alias("r"), corpora.relation_tuple(F.col("one"), ["a", "b"]).alias("n")).first()
    assert r.s == "b c" and (r.r.a, r.r.b, r.r.c) == (1, 2, None) and r.n is None
    (tmp_path / "papers.csv").write_text('Paper No.,Title,Authors,DOI\n1,"On x, y","A; B",10.1/x\n')
    assert records.read_papers(spark, str(tmp_path / "papers.csv")).count() == 1
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.md").write_text("# text")
    assert records.read_documents(spark, str(tmp_path / "docs")).count() == 1
    table = spark.createDataFrame([("a", "1"), ("b", "2")], "synonym string, id string")
    assert table.select(F.explode(kb.curated(F.lit('{"z": "1, 2"}'))).alias("x")).distinct().count() == 2


def test_bioc_keeps_first_of_equal_places(spark):
    place = lambda o, n: {"offset": o, "length": n}
    note = lambda t, i, *at: {"text": t, "infons": {"identifier": i, "type": "G"}, "locations": list(at)}
    doc = {"id": "d", "passages": [{"offset": 5, "text": "two", "annotations": [note("b", "I", place(1, 1)), note("c", None, place(1, 1))]}, {"offset": 0, "text": "one", "annotations": [note("a", "I", place(1, 1), place(2, 1)), note("e", None, place(1, 1))]}], "relations": []}
    docs = spark.createDataFrame([(json.dumps({"documents": [doc]}),)], "j string").select(F.explode(F.from_json("j", corpora.BIOC).documents).alias("d")).select("d.*")
    r = corpora.parse_bioc(docs).first()
    assert [(e.text, e.identifier, e.offset) for e in r.entities] == [("b", "I", 1), ("c", None, 1), ("a", "I", 2)] and r.text == "one two"


def test_variants_of_any_depth(spark):
    rows = [(1, '{"a": {"b": [1, {"c": "x"}], "d": []}, "e": [1, 2], "f": null}'), (2, "[1, [2, 3]]"), (3, "5")]
    df = spark.createDataFrame(rows, "id long, j string").select("id", F.try_parse_json("j").alias("v"))
    got = sorted((r.id, r.path, r.value) for r in nested.flatten_variant(df, "v", "id").collect() if r.value is not None)
    assert got == [(1, "a.b.[0]", "1"), (1, "a.b.[1].c", "x"), (1, "e", "1"), (1, "e", "2"), (2, ".[0]", "1"), (2, ".[1]", "2"), (2, ".[1]", "3"), (3, "(root)", "5")]
    assert nested.items(df, "v", "id").count() == 1


def test_field_scores_by_material(spark):
    gold = spark.createDataFrame([(1, "ZnO", "a"), (2, "IGZO", "b")], "doc long, material string, x string")
    rows = {(r.material, r.field): (r.tp, r.fp, r.fn) for r in evaluate.field_scores(gold, gold.withColumn("x", F.lit("a")), ["doc", "material"], ["x"], by="material").collect()}
    assert rows == {("ZnO", "x"): (1, 0, 0), ("IGZO", "x"): (0, 1, 1), ("all", "x"): (1, 1, 1), ("ZnO", "overall"): (1, 0, 0), ("IGZO", "overall"): (0, 1, 1), ("all", "overall"): (1, 1, 1)}


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "variant string, n long")
    assert [tuple(r) for r in stats.relation_statistics(none, "variant", "n", ["a"]).collect()] == [("a", 0, 0.0, 0, 0)]
    one = spark.createDataFrame([("m", "p", None)], "model string, paper string, n long")
    assert tuple(stats.extraction_statistics(one, "model", "paper", "n").first()) == ("m", 0, 0.0, 0, 0.0)


def test_stored_knowledge_base_needs_no_exchange(spark, tmp_path):
    table = spark.createDataFrame([(f"s{i % 50}", str(i)) for i in range(200)], "synonym string, id string")
    kb.store(table, "stored_kb", 4, str(tmp_path / "kb"))
    asked = spark.range(60).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("mention"))
    found = link.exact(asked, spark.table("stored_kb"))
    assert {r.mention: len(r.ids) for r in found.collect()} == {f"s{i}": 4 for i in range(50)}
    joined = spark.table("stored_kb").hint("merge").join(asked.withColumnRenamed("mention", "synonym").hint("merge"), "synonym")
    assert joined._jdf.queryExecution().toString().count("Exchange hashpartitioning(synonym") <= 1
    spark.sql("DROP TABLE stored_kb")


def test_batches_of_a_feed(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string").coalesce(1).write.parquet(str(source))
    counts = lambda df, n: df.groupBy("k").count().write.mode("overwrite").parquet(f"{target}/{n}")
    for _ in range(2):  # the second run finds nothing new
        feed.batches(spark, str(source), "k long, v string", counts, str(tmp_path / "log")).awaitTermination()
    assert {(r.k, r["count"]) for r in spark.read.parquet(f"{target}/*").collect()} == {(1, 2), (2, 1)}


def test_linking_skips_paths(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "synonym string, id string")
    df = spark.createDataFrame([(1, "a", "b")], "k long, x string, y string").select("k", F.struct("x", "y").alias("r"))
    done = link.in_place(df, "k", "r", ["x", "y"], lambda m: link.exact(m, base), skip=["y"]).first()
    assert (done.r.x.value, done.r.x.sameAs, done.r.y) == ("a", ["1"], "b") and len(link.COMPOUND_PATHS) == 9


def test_steps_in_their_order(spark):
    df = spark.createDataFrame([(1, "x")], "k long, v string")
    add = lambda mark: lambda d: d.withColumn("v", F.concat("v", F.lit(mark)))
    assert [judge.finished(df, add("v"), *more).first().v for more in ((), (add("l"),), (None, add("c")), (add("l"), add("c")))] == ["xv", "xvl", "xvc", "xvlc"]
