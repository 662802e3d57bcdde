"""Small cases for the operators, quirks included."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomery.functions import similarity, text
from loomery.operators import cluster, evaluate, judge, link, matching, metrics, nested, validate
from loomery.sources import corpora, kb, records, sinks
from loomery.streaming import feed


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_numbers(spark):
    cases = {"1,200": 1200.0, "5%": 0.05, "abc%": None, "true": 1.0, "nan": None, "inf": None, "": None, "-1.5e2": -150.0}
    assert {k: one(spark, text.to_number(F.col("c")), c=k) for k in cases} == pytest.approx(cases)


def test_strings(spark):
    assert one(spark, text.lenient(F.col("c")), c=" Ｆｏｏ\t Bar ") == "foo bar"
    assert one(spark, text.key_form(F.col("c")), c="Zn(O)-é 2") == "zno2"
    assert one(spark, text.unescaped(F.col("c")), c="a\\u00e9\\ud83d\\ude00") == "aé😀"
    assert one(spark, text.unquoted(F.col("c")), c="'x y\"") == "x y"
    assert one(spark, text.plain_dashes(F.col("c")), c="a–b—c") == "a-b-c"
    assert one(spark, text.label_with_ids(F.col("c"), F.array(F.lit("1"), F.lit("2"))), c="X") == "X [CID:1, 2]"
    assert one(spark, text.ids_of_label(F.col("c")), c="X [CID:1, 2]") == ["1", "2"]
    assert one(spark, text.token_chunks(F.array(*map(F.lit, "abcde")), 6), c="") == [["a", "b"], ["c", "d"], ["e"]]


def test_similarities(spark):
    assert one(spark, similarity.token_jaccard(F.col("a"), F.col("b")), a="", b=" ") == 1
    assert one(spark, similarity.token_jaccard(F.col("a"), F.col("b")), a="x y", b="y z") == pytest.approx(1 / 3)
    assert one(spark, similarity.edit_ratio("a", "b"), a="abcd", b="abd") == pytest.approx(600 / 7)
    assert one(spark, similarity.token_set_ratio(F.col("a"), F.col("b")), a="zinc oxide", b="oxide film zinc") == 100
    assert one(spark, similarity.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), a=1) is None


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert similarity.common_subsequence(a, b) == table[-1, -1]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_best(n, m, seed):
    from itertools import permutations

    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    got = matching.assign(cost)
    small, large = (cost, m) if n <= m else (cost.T, n)
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in permutations(range(large), min(n, m)))
    assert len(got) == min(n, m) and sum(cost[i, j] for i, j in got) == best


def test_set_match_cases(spark):
    gold = spark.createDataFrame([(1, "Aspirin", "Chemical"), (1, "headache", "Symptom"), (2, "a", None), (3, "only gold", "x")], "doc int, text string, type string")
    predicted = spark.createDataFrame([(1, "Aspirin", "Chemical"), (1, "headache", "Disease"), (1, "Aspirin", "Chemical"), (2, "a", None)], "doc int, text string, type string")
    counts = matching.set_counts(gold, predicted, ["doc"], ["text", "type"])
    assert sorted(map(tuple, counts.collect())) == [(1, 1, 1, 1), (2, 1, 0, 0)]
    assert matching.set_counts(gold, predicted, ["doc"], ["text", "type"], "count").count() == 3
    total = metrics.micro(spark.createDataFrame([(2, 0, 2), (1, 1, 0)], "tp int, fp int, fn int")).first()
    assert (total.precision, total.recall, round(total.f1, 4)) == (0.75, 0.6, 0.6667)
    assert metrics.micro(spark.createDataFrame([], "tp int, fp int, fn int")).first().f1 == 0


def test_published_ratings(spark):
    """Golden values: tp, fp, fn with the precision, recall and F1 that were published for them."""
    rows = [(3174, 1040, 1487, 0.753204, 0.680970, 0.715268), (3422, 799, 1239, 0.810708, 0.734177, 0.770547), (300, 654, 863, 0.314465, 0.257954, 0.283420), (0, 834, 1066, 0, 0, 0)]
    got = metrics.prf(spark.createDataFrame([r[:3] for r in rows], "tp long, fp long, fn long")).collect()
    assert [(round(r.precision, 6), round(r.recall, 6), round(r.f1, 6)) for r in got] == [r[3:] for r in rows]


def test_greedy_and_coverage(spark):
    ids = lambda name, values: spark.createDataFrame([(1, v) for v in values], f"doc int, {name} int")
    pairs = lambda *ps: spark.createDataFrame([(1, p, g) for p, g in ps], "doc int, p int, g int")
    run = lambda gold, predicted, match, how: tuple(matching.knowledge_base_counts(ids("g", gold), ids("p", predicted), match, ["doc"], how).first())[1:]
    assert run([1, 2], [1], pairs((1, 1), (1, 2)), "greedy") == (1, 0, 1)
    assert run([1, 2], [1], pairs((1, 1), (1, 2)), "coverage") == (2, 0, 0)
    assert run([1], [1, 2], pairs((1, 1), (2, 1)), "coverage") == (1, 1, 0)


def test_soft_match(spark):
    gold = spark.createDataFrame([(1, 1, "zinc oxide thin film layer"), (1, 2, "water")], "doc int, id int, text string")
    predicted = spark.createDataFrame([(1, 1, "zinc oxide film layer"), (1, 2, "zinc oxide thin film layer"), (1, 3, "ozone")], "doc int, id int, text string")
    assert tuple(matching.soft_counts(gold, predicted, ["doc"]).first()) == (1, 1, 2, 1)


RECORDS = [{"v": [{"c": 1}, {"c": None}], "a": [], "c": None, "q": {"n": "Not Found", "l": ["Not Found", "x"]}, "e": ""}, {"v": [], "a": ["s", "t"], "c": 5, "q": None, "e": "z"}]
SCHEMA = "id int, r struct<v:array<struct<c:int>>, a:array<string>, c:int, q:struct<n:string,l:array<string>>, e:string>"


@pytest.fixture
def nests(spark):
    return spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS)], SCHEMA)


def test_flatten(nests):
    got = {i: sorted((r.path, r.value or "-") for r in nested.flatten(nests, "r", "id").collect() if r.id == i) for i in (0, 1)}
    assert got[0] == [("c", "-"), ("e", "-"), ("q.l", "Not Found"), ("q.l", "x"), ("q.n", "Not Found"), ("v.[0].c", "1"), ("v.[1].c", "-")]
    assert got[1] == [("a", "s"), ("a", "t"), ("c", "5"), ("e", "z"), ("q", "-")]


def test_flatten_variant_equals_typed(spark):
    rows = [(1, json.dumps({"a": {"b": [1, 2], "c": [{"d": 1}, {"d": 2}]}})), (2, json.dumps({"a": {"b": [], "c": [{"d": 3}]}}))]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("v", F.try_parse_json("j"))
    loose = sorted((r.id, r.path, r.value) for r in nested.flatten_variant(df, "v", "id").collect())
    strict = sorted((r.id, r.path, r.value) for r in nested.flatten(nested.typed(df.select("id", "j"), "j"), "j", "id").collect())
    assert loose == strict == [(1, "a.b", "1"), (1, "a.b", "2"), (1, "a.c.[0].d", "1"), (1, "a.c.[1].d", "2"), (2, "a.c.[0].d", "3")]


def test_paths(nests):
    assert [tuple(r) for r in nested.get_path(nests, "r", "v[*].c", "id").collect()] == [(0, "v[0].c", "1")]
    assert nested.get_path(nests, "r", "v.c", "id").count() == 0 and nested.get_path(nests, "r", "no.such[9]").count() == 0
    changed = nested.set_path(nests, "r", "v[1].c", F.lit(9))
    assert [r.value for r in nested.get_path(changed, "r", "v[1].c").collect()] == ["9"]
    assert nested.get_path(nested.set_path(nests, "r", "v[7].c", F.lit(9)), "r", "v[*].c").count() == 1


def test_prune(nests):
    got = [json.loads(r.j) for r in nested.prune_nulls(nests, "r").orderBy("id").select(F.to_json("r").alias("j")).collect()]
    assert got == [{"v": [{"c": 1}], "q": {"l": ["Not Found", "x"]}, "e": ""}, {"a": ["s", "t"], "c": 5, "e": "z"}]


def test_prune_quantities(spark):
    df = spark.createDataFrame([({"t": {"quantityKind": "T", "quantityValue": {"numericValue": None}}, "p": {"quantityKind": "P", "quantityValue": {"numericValue": 0.0}}},)], "r struct<t:struct<quantityKind:string,quantityValue:struct<numericValue:double>>,p:struct<quantityKind:string,quantityValue:struct<numericValue:double>>>")
    r = nested.prune_quantities(df, "r").first().r
    assert r.t is None and r.p.quantityValue.numericValue == 0


PUBTATOR = "1|t|Aspirin and pain\n1|a|It helps.\n1\t12\t16\tpain\tDisease\tD1\n1\t0\t7\tAspirin\tChemical\tC1\n1\tCID\tC1\tD1\n\n2|t|T\n2|a|\n2\tAssociation\tA\tB\tNovel\n"


def test_pubtator(spark, tmp_path):
    (tmp_path / "x.txt").write_text(PUBTATOR)
    first, second = corpora.read_pubtator(spark, str(tmp_path / "x.txt")).orderBy("doc_id").collect()
    assert first.text == "Aspirin and pain\nIt helps." and [(e.offset, e.length, e.text) for e in first.entities] == [(0, 7, "Aspirin"), (12, 4, "pain")]
    assert [tuple(r) for r in first.relations] == [("CID", "C1", "D1")] and second.relations == []
    typed = corpora.read_pubtator(spark, str(tmp_path / "x.txt"), "typed").where("doc_id = '2'").first()
    assert [tuple(r) for r in typed.relations] == [("Association", "A", "B", True)]


def test_bioc(spark):
    note = lambda i: {"text": "a", "infons": {"identifier": i, "type": "G"}, "locations": [{"offset": 0, "length": 1}]}
    docs = spark.createDataFrame([("d", [{"offset": 5, "text": "late", "annotations": [note("1")]}, {"offset": 0, "text": "early", "annotations": [note("1"), note("2")]}], [{"infons": {"type": "t", "entity1": "1", "entity2": "2", "novel": "No"}}])], corpora.BIOC.replace("\n", " ").removeprefix("documents array<struct<").removesuffix(">>").replace("id:string", "id string", 1).replace(" passages:", " passages ", 1).replace("relations:array<struct<infons", "relations array<struct<infons"))
    r = corpora.parse_bioc(docs).first()
    assert r.text == "early late" and [e.identifier for e in r.entities] == ["1", "2"] and r.relations[0].novel is False


def test_bio_orphans(spark):
    rows = list(enumerate(zip("abcd", ["I-CN", "O", "B-CN", "I-PN"], strict=True)))
    df = spark.createDataFrame([(1, i, t, x) for i, (t, x) in rows], "s int, pos int, token string, label string")
    assert [(r.kind, r.text) for r in corpora.bio_spans(df, "s").collect()] == [("CN", "c")]


def test_graph_corpus(spark):
    v = spark.createDataFrame([(1, 0, "x", "M", [0]), (1, 1, "y", "O", [1]), (1, 2, "x", "M", [2]), (1, 3, "z", "?", [0])], "doc int, pos int, text string, type string, tokens array<int>")
    assert sorted((r.category, r.text, r.nth) for r in corpora.graph_entities(v, {"M": "materials", "O": "operations"}).collect()) == [("materials", "x", 1), ("operations", "y", 1)]
    e = spark.createDataFrame([(1, "r", [0], [1]), (1, "r", [0], [9])], "doc int, type string, left array<int>, right array<int>")
    assert [(r.source, r.target) for r in corpora.graph_relations(e, v).collect()] == [("z", "y")]


def test_tree_and_folders(spark, tmp_path):
    at = tmp_path / "ZnO" / "ZnEt2 - O3" / "model-1"
    at.mkdir(parents=True)
    (at / "p.json").write_text('{"processes": [1]}'), (at / "bad.json").write_text("{"), (at / "empty.json").write_text(""), (at / "x.txt").write_text("{}")
    found = records.scan_extractions(spark, str(tmp_path)).select(records.path_metadata(F.regexp_replace("path", "%20", " "), ("ZnO", "IGZO")).alias("m")).collect()
    assert [(r.m.model, r.m.condition, r.m.material, r.m.stem) for r in found] == [("model-1", "ZnEt2 - O3", "ZnO", "p")]
    gold = one(spark, records.gold_of_folder(F.col("f"), 3), f="InMe3 - GaMe3 - ZnEt2 - O3")
    assert tuple(gold) == ("InMe3", "GaMe3", "ZnEt2", "O3")


def test_synonyms(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("1\twater\n\n2\t oxidane \n3\twater\nbad line\n")
    assert sorted(map(tuple, kb.load_synonyms(spark, str(tmp_path / "s.tsv")).collect())) == [("oxidane", "2"), ("water", "3")]
    assert kb.load_synonyms(spark, str(tmp_path / "s.tsv"), "all").count() == 3
    assert [tuple(x) for x in one(spark, kb.curated(F.col("j")), j='{"a": "1, 2"}')] == [("a", "1"), ("a", "2")]


def test_linking(spark):
    base = spark.createDataFrame([("Zinc oxide", "1"), ("Indium gallium zinc oxide", "2"), ("water", "3")], "synonym string, id string")
    mentions = spark.createDataFrame([("water",), ("zinc oxid",), ("nothing like it",), ("water",)], "mention string")
    got = {r.mention: (r.ids, r.stage) for r in link.cascade(mentions, ("exact", lambda m: link.exact(m, base)), ("fuzzy", lambda m: link.fuzzy(m, base))).collect()}
    assert got == {"water": (["3"], "exact"), "zinc oxid": (["1"], "fuzzy"), "nothing like it": ([], "none")}
    assert link.grown(base, link.exact(mentions, base)).count() == 3


def test_fuzzy_blocking_loses_nothing(spark):
    rng = np.random.default_rng(2)
    names = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 14))) for _ in range(60)]
    edited = sorted({n[:i] + n[i + 1 :] for n in names for i in (1, len(n) - 1)} | set(names))
    base = spark.createDataFrame([(n, str(i)) for i, n in enumerate(sorted(set(names)))], "synonym string, id string")
    pairs = link.blocked(spark.createDataFrame([(m,) for m in edited], "mention string"), base)
    got = {(r.mention, r.synonym) for r in pairs.where(similarity.edit_ratio("mention", "low") >= 85).collect()}
    expected = {(m, n) for m in edited for n in names if 200 * similarity.common_subsequence(m, n) >= 85 * (len(m) + len(n))}
    assert got == expected


def test_validation(spark):
    df = spark.createDataFrame([(1, "x", '{"a": 1}'), (2, None, '{"b": 1}')], "doc int, t string, j string")
    rules = {"type": ("t", F.col("t").isNotNull()), "keys": ("j", validate.only_keys(F.col("j"), ["a"]))}
    assert sorted(map(tuple, validate.violations(df, "doc", rules).collect())) == [(2, "j", "keys"), (2, "t", "type")]
    assert sorted(map(tuple, validate.valid(df, "doc", rules).collect())) == [(1, True), (2, False)]
    assert one(spark, validate.wrapped(F.col("j"), "k"), j=" [1]") == '{"k": [1]}'


def test_jobs(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")

    def model(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "reply": ['{"n": 1}' if "one" in p else "no json" for p in f["prompt"]]})

    good, bad = judge.extract(docs, model, text.rendered("Read: {text}", text=F.col("text")), "n int")
    assert [r.doc_id for r in good.collect()] == [1] and [r.doc_id for r in bad.collect()] == [2]

    def critic(frames):
        for f in frames:
            yield pd.DataFrame({"pair_id": f["pair_id"], "satisfied": f["rating"] >= 4, "suggested": f["rating"] + 1})

    pairs = spark.createDataFrame([(1, 4), (2, 3), (3, 1)], "pair_id long, rating int")
    assert sorted(map(tuple, judge.debate(pairs, critic).collect())) == [(1, 4, 1, True), (2, 4, 2, True), (3, 4, 3, False)]

    def attempt(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "reply": "r", "rating": [5.0 if x else float(i) for i, x in zip(f["doc_id"], f["feedback"], strict=True)], "feedback": "better"})

    assert sorted((r.doc_id, r.attempt) for r in judge.refine(spark.createDataFrame([(1,), (4,)], "doc_id long"), attempt).collect()) == [(1, 1), (4, 0)]
    rubrics = spark.createDataFrame([("a", "d", True), ("b", "d", False)], "rubric string, description string, enabled boolean")

    def rater(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "rubric": f["rubric"], "rating": f["doc_id"].astype(int), "rationale": "x"})

    rated = judge.rate(docs, rubrics, [("j1", rater), ("j2", rater)])
    assert rated.count() == 4 and [r.judge for r in judge.consolidated(rated).collect()] == ["j1", "j1"]


def test_clusters(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.05]), (3, [0.0, 1.0]), (4, [0.05, 0.99]), (5, [-1.0, 0.0]), (6, [0.0, 0.0])], "id long, vec array<double>")
    assert sorted(map(tuple, cluster.density_clusters(points).collect())) == [(1, 0), (2, 0), (3, 1), (4, 1), (5, -1), (6, -1)]
    assert sorted(map(tuple, cluster.density_clusters(points).collect())) == sorted(map(tuple, cluster.density_clusters(points.repartition(3)).collect()))


def test_wide_and_triples(spark):
    leaves = spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 1, "y"), (2, "b", 0, "3")], "id int, path string, nth int, value string")
    assert sorted(map(tuple, sinks.wide(leaves, ["id"]).collect())) == [(1, "x, y", ""), (2, "", "3")]
    assert {(r.object, r.datatype) for r in sinks.triples(leaves, F.col("id")).collect()} == {("x", "string"), ("y", "string"), ("3", "integer")}


def test_expanded_ids(spark):
    df = spark.createDataFrame([(1, ["b", "a"], ["z"])], "k int, r array<string>, p array<string>")
    assert sorted((r.ref, r.pred) for r in evaluate.expanded_ids(df, "k", "r", "p").collect()) == [("a", "z"), ("b", "z")]


def test_feed_takes_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    step = lambda df: df.withColumn("double", F.col("id") * 2)
    for n in (5, 12):
        spark.range(n).write.mode("append").parquet(src)
        feed.feed(spark, src, "id long", step, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 17 and spark.read.parquet(out).agg(F.max("double")).first()[0] == 22
