"""Language model, pages, line dedup, neighbours, near-duplicates and the pipeline."""

import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomery.llm import linededup, lm, minhash, neighbours, pages, skew, textkit

ODD = [(1, "same text, twice"), (1, "same text, twice"), (2, None), (3, ""), (None, "no id"), (4, "word"), (5, "x y " * 30_000)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "k", 7, 0) for i, t in ODD], "doc_id long, text string, k string, h int, id int")


def test_lm_base_and_score(spark, sf):
    rows = {r.doc_id: r for r in lm.op2_lm(spark, sf).collect()}
    docs = {r.doc_id: [*(r.text or "").encode().lower().split(), b""] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in docs.items():
        r = rows[i]
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 5 == 1)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probabilities_sum_to_one(spark):
    """Of every token after every context; the filter is checked by asking it for what it was given."""
    texts = ["a b a c", "b a b", "a c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = ["a", "b", "c", "d", "zz"]
    two = [(100 + i, f"{h} {w}") for i, (h, w) in enumerate((h, w) for h in words for w in words)]
    one = [(1000 + i, h) for i, h in enumerate(words)]
    asked = spark.createDataFrame(two + one, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in lm.score(df.union(asked), F.col("doc_id") < 100).collect()}
    after = defaultdict(Counter)
    for t in texts:
        ws = ["", *t.split(), ""]
        for h, w in zip(ws, ws[1:], strict=False):
            after[h][w] += 1
    c = Counter(w for t in texts for w in [*t.split(), ""])
    n, v = sum(c.values()), len(c)
    first = lambda w: (c[w] - 0.75) / n if c[w] else 0.75 * v / n

    def p(h, w):
        f = {x: lm.BASE ** math.floor(math.log(k) / math.log(lm.BASE) + 1e-9) for x, k in after[h].items()}
        rest = 1 - sum(x - 0.75 for x in f.values()) / c[h] if c[h] else 1
        return (f[w] - 0.75) / c[h] + rest * first(w) if w in f else rest * first(w)

    for i, (h, w) in enumerate((h, w) for h in words for w in words):
        expected = math.log10(p("", h)) + math.log10(p(h, w)) + math.log10(p(w, ""))
        assert math.isclose(rows[100 + i], expected, rel_tol=1e-6), (h, w)
    assert math.isclose(sum(p("a", w) for w in [*c, "zz"]), 1)


def test_lm_in_rounds_of_broadcasts(spark, sf, monkeypatch):
    """However many rounds the filters come in, the scores are the same; without what the filter holds they are not."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    run = lambda: {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") % 5 > 0).collect()}
    rounds = []
    real = lm.probed
    monkeypatch.setattr(lm, "probed", lambda *given: rounds.append(1) or real(*given))
    whole = run()
    assert len(rounds) == 1
    monkeypatch.setattr(lm, "GROUP_TOKENS", 20_000)
    monkeypatch.setattr(lm, "FILTER_BYTES", 60_000)
    assert run() == whole and len(rounds) > 8
    empty = lambda packets, filters: real(packets, filters.withColumn("words", F.lit(bytes(8192))))
    monkeypatch.setattr(lm, "probed", empty)
    blind = run()
    assert sum(blind[i] < whole[i] for i in whole) > 0.9 * len(whole)


def test_lm_odd_rows(spark, odd):
    rows = lm.score(odd, F.col("doc_id") != 4).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens >= 1 for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]
    none = lm.score(odd, F.lit(False)).collect()
    assert all(abs(r.base_score) < 1e-6 and abs(r.score) < 1e-6 and r.n_known == 0 for r in none)
    assert lm.score(odd.limit(0), F.lit(True)).count() == 0


PAGE = """<html><body class="with-sidebar"><header><h1>Site</h1></header><div id="menu"><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></div>
<div class="cookie-notice">We use cookies, you know.</div><div class="wrap"><div class="post"><h2>Title &amp; more</h2><p>First, a paragraph of <a href=y>text</a> that goes on,
and on.<p>Second   para&nbsp;x with <b>bold.<br>Line</b> two.<ul><li>item 1<li>item 2</ul><form>Email: <input></form></div>
<div class="sidebar">Side, text, long, long, long, long, long.</div></div><section id="comments"><article class="comment"><p>I like it, very much, so, so, so.</p></article></section><footer>(c)</footer><script>a<b "x</p>"</script></body>"""


def test_pages():
    assert pages.main_text(PAGE) == "Title & more\nFirst, a paragraph of text that goes on, and on.\nSecond para x with bold. Line two.\nitem 1\nitem 2"
    assert [pages.main_text(x) for x in (None, "", "<p", "just < text")] == ["", "", "", "just < text"]
    assert pages.main_text("<div>" * 3000 + "x") == "x"


def gold(page):
    """Plainly, for the given pages: what stands in their one article, by paragraphs."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div)[^>]*>", re.sub(r"</?b>", "", inner))]
    return "\n".join(x for x in parts if x)


def test_pages_equal_gold(sf):
    given = duckdb.sql(f"SELECT html FROM '{sf.replace('0.001', '0.01')}/pages.parquet'").fetchall()
    for (page,) in given:
        assert pages.main_text(page) == gold(page)


def test_pages_built_from_parts():
    """Random layouts around known paragraphs, with and without article elements."""
    rng = random.Random(12)
    words = "alpha beta gamma delta, epsilon zeta, eta theta iota".split()
    said = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    links = lambda n: "<ul>" + "".join(f"<li><a href=x>{said(2)}</a>" for _ in range(n)) + "</ul>"
    noise = [
        lambda: f"<nav>{links(5)}</nav>", lambda: f"<div class='ad'>{said(12)}</div>", lambda: f"<div id=cookie-notice>{said(20)}</div>", lambda: f"<aside>{said(30)}</aside>",
        lambda: f"<div class='comments'><p>{said(40)}<p>{said(60)}</div>", lambda: f"<form><p>{said(9)}<input></form>", lambda: f"<div class='share-buttons'>{links(4)}</div>", lambda: "<script>var p = '<p>x</p>'</script>",
    ]
    for case in range(300):
        texts = [said(rng.randint(25, 90)) for _ in range(rng.randint(3, 9))]
        inside = []
        for n, t in enumerate(texts):
            inside.append(rng.choice(["<p>{}</p>", "<p>{}", "<p class='side-note'>{}</p>", "<p id=related>{}</p>", "<div>{}</div>"]).format(t.replace(" gamma", " <b>gamma</b>", 1)))
            if n < len(texts) - 1 and rng.random() < 0.3:
                inside.append(rng.choice([noise[1], noise[6], noise[7]])())
        box = rng.choice(["<article>{}</article>", "<div class='social-impact story'>{}</div>", "<div>{}</div>", "<main><section>{}</section></main>"])
        around = [f() for f in rng.sample(noise, 6)]
        page = "<html><body><header><h1>Site</h1></header>" + "".join(around[:3]) + "<div>" * (case % 4) + box.format("".join(inside)) + "</div>" * (case % 4) + "".join(around[3:]) + "<footer>(c) x</footer></body></html>"
        assert pages.main_text(page) == "\n".join(texts), page


def test_pages_keep_text_in_articles():
    long = "Some words, then more words, and yet more words that go on and on, for a while at least. " * 3
    links = "<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul>"
    page = f"<article><p>{long}</p>{links}<div class='social-impact story'><p>{long}</p></div><p id='related'>R {long}</p><p class='side-note'>S</p></article><article><p>{long}</p></article>"
    one = " ".join(long.split())
    assert pages.main_text(page) == "\n".join([one, "One", "Two", "Three", one, f"R {one}", "S", one])


def test_deep_pages_take_time_in_proportion():
    began = time.process_time()
    for page in ("<div>" * 50_000 + "x" + "</span></p></section>" * 50_000, "<div><p>some text, here" * 30_000, "<div>" * 20_000 + "<li>a</b>" * 40_000, "<i><div>" + "<b>" * 30_000 + "x" + "</i>" * 30_000):
        assert pages.main_text(page)
    assert time.process_time() - began < 60


def test_page_rows(spark, sf):
    rows = pages.op3_html(spark, sf).collect()
    assert all(r.text and r.n_chars == len(r.text) and "track(" not in r.text for r in rows)
    df = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", "<p>x", 2)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in pages.extract(df).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert pages.extract(df.limit(0)).count() == 0


def test_line_dedup_equals_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(duckdb.sql(linededup.OP6_SQL.replace("SELECT d.doc_id, CASE", "SELECT d.doc_id, CASE")).fetchall())
    assert sorted(tuple(r) for r in linededup.op6_linededup(spark, sf).collect()) == expected


def test_line_dedup_runs(spark, odd):
    rng = random.Random(1)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, short = line(30), line(10), line(15), line(20)
    docs = [(1, f"{line(5)}\n{a}\n{b}\n\n{c}\nend one"), (2, f"{a}\n{b}\n\n{c}\n{line(9)}"), (3, f"{b}\n{short}"), (4, f"{short}\n{b}\n{c}\nx"), (5, f"{a}\n{b}\n{c}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(df).collect()}
    assert got[1] == (docs[0][1], 0) and got[3] == (docs[2][1], 0) and got[4] == (docs[3][1], 0)
    assert got[2] == (docs[1][1].split("\n")[-1], 4) and got[5] == ("", 3)
    rows = linededup.dedup_lines(odd).collect()
    assert len(rows) == len(ODD) and [r.text for r in rows if r.doc_id == 2] == [None]
    assert [c for c in linededup.dedup_lines(odd).columns] == [*odd.columns, "n_lines", "n_removed"]
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_plan_is_native(spark, sf):
    plan = linededup.op6_linededup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def _near(rows, vectors, queries, k):
    hit = total = 0
    by = defaultdict(list)
    for r in rows:
        by[r.query_id].append(r)
    for q in queries:
        s = sorted(((-float(np.dot(v, vectors[q])), i) for i, v in vectors.items() if i != q))[:k]
        own = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit += len({i for _, i in s} & {r.vec_id for r in own})
        total += len(s)
    return hit / total


def test_neighbours_recall(spark):
    path = "/root/testdata/sf0.01"
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    assert _near(neighbours.op7_ann(spark, path).collect(), vectors, [i for i in vectors if i % 20 == 0], 20) >= 0.9


@pytest.mark.parametrize(("n", "k"), [(25, 20), (40, 20), (12, 20)])
def test_neighbours_of_few_vectors_are_all_there(spark, n, k):
    rng = np.random.default_rng(n)
    vectors = {i: rng.normal(size=64) for i in range(n)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 10 == 0, k).collect()
    assert Counter(r.query_id for r in got) == {i: min(k, n - 1) for i in range(0, n, 10)}
    assert all(math.isclose(r.score, vectors[r.query_id] @ vectors[r.vec_id]) for r in got)


def test_neighbours_recall_with_mixed_lengths(spark):
    rng = np.random.default_rng(7)
    for lengths in ([0.1, 1, 10], [1, 1.1, 1.3, 1.5]):
        vectors = {i: v for i, v in enumerate(rng.normal(size=(400, 64)) * rng.choice(lengths, (400, 1)) / 8)}
        df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
        assert _near(neighbours.search(df, F.col("vec_id") % 20 == 0).collect(), vectors, [i for i in vectors if i % 20 == 0], 20) >= 0.9


def test_neighbours_of_many_copies(spark):
    """Queries that are copies of one vector search once and each get their own list."""
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i % 7), 1.0, -1.0]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=4)
    lists = {r.query_id: r.ids for r in got.groupBy("query_id").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).collect()}
    x = dict(rows)
    want = {q: sorted(sorted((-sum(a * b for a, b in zip(x[q], v, strict=True)), i) for i, v in rows if i != q)[:4], key=lambda t: t[1]) for q in range(0, 1500, 20)}
    assert lists == {q: [i for _, i in w] for q, w in want.items()}


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (20, [3.0, 0.1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, key string")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [(1, 20), (2, 1), (3, 2)]
    assert {r.query_id for r in got} == {0, 20} and all(r.vec_id in (0, 1, 2, 3, 20) for r in got)
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def brute_components(docs, width, percent):
    sets = {i: set(textkit.shingle_hashes(t, width).tolist()) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 25)):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            docs.append((len(docs) * 7 % 997, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width, percent, piece=16).collect()}
    assert got == brute_components(docs, width, percent)


def test_near_duplicates_in_one_large_group(spark, monkeypatch):
    """1200 copies, each edited a little, most of them too much for a link: all pairs are tested, few rows come out."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(f"x{rng.randrange(10**9)}" if rng.random() < 0.04 else w for w in base)) for i in range(1200)]
    docs += [(5000 + i, docs[i % 7][1]) for i in range(600)]
    emitted, rest = [], minhash._rest
    monkeypatch.setattr(minhash, "_rest", lambda *a: emitted.append(rest(*a)) or emitted[0])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 3, 85, piece=400).collect()}
    assert got == brute_components(docs, 3, 85) and len({c for _, c in got.values()}) > 300
    assert emitted[0].count() < 1200


def test_split_join_equals_join(spark):
    many = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 5 > 0, F.col("id")).alias("k"), "id")
    one = spark.range(0, 30_000, 2).union(spark.range(7, 8)).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left", "left_semi"):
        split = skew.split_join(many, one, "k", counts, 30_000, F.col("id"), how)
        assert sorted(map(str, split.select("k", "id").collect())) == sorted(map(str, many.join(one, "k", how).select("k", "id").collect()))


def test_near_duplicates_odd_rows(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (2, 5), None: (1, None)}
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from loomery.llm.spill import stash

    kept, texts = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stash(stage(spark, kept, sf))
        assert kept.columns == docs.columns, name
        assert kept.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_dedup":
            groups = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in groups.items() if i == c}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf).count() == docs.count()  # the given texts all have a language


def test_pipeline_odd_rows(spark):
    rows = [(i, t, "en", None, 0, "x") for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ambiguous string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() >= 0 and stage(spark, docs.limit(0), "").count() == 0
        docs = docs if stage is corpus_pipeline.pack_sequences else stage(spark, docs, "")
    assert docs.where("doc_id = 1").count() == 1


def test_pipeline_without_languages(spark):
    docs = spark.createDataFrame([(1, "abc def", None, None, 7), (2, "123", None, None, 3), (3, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]


def test_lm_holds_every_bigram(spark):
    """Among 18 million tokens, bigrams that came once still count."""
    common = spark.range(180).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), 100_000).alias("text"))
    rare = [(1000 + i, f"u{i} v{i}") for i in range(300)]
    asked = [(2000 + i, f"u{i} v{i}") for i in range(300)] + [(3000 + i, f"u{i} v{(i + 1) % 300}") for i in range(300)]
    df = common.union(spark.createDataFrame(rare + asked, "doc_id long, text string")).repartition(4)
    rows = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") < 2000, most_words=100).collect()}
    assert all(rows[2000 + i] > rows[3000 + i] + 0.5 for i in range(300))
