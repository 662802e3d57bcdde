"""SimHash groups against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomery.llm import simhash


def plain(text, width=4):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, ids, most=4):
    """The least id of each row's component, every pair held against every other."""
    v, label = np.array(prints, np.uint64), np.arange(len(prints))
    for i in range(len(v)):
        for x in np.unique(label[near := np.bitwise_count(v ^ v[i]) <= most]):
            label[label == x] = label[near].min()
    return [min((i for i, same in zip(ids, label == x, strict=True) if same and i is not None), default=None) for x in label]


def check(df, **options):
    rows = simhash.near_duplicates(df, **options).collect()
    texts = [(r.doc_id, plain(r.text)) for r in df.select("doc_id", F.col("text").cast("string").alias("text")).collect()]
    assert sorted(((r.doc_id, int(r.fingerprint, 16)) for r in rows), key=str) == sorted(texts, key=str)
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)
    assert [r.component_id for r in rows] == groups([int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows])
    return rows


def test_all_documents(spark, sf):
    rows = simhash.op11_simhash(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(int(r.fingerprint, 16) == plain(docs[r.doc_id]) for r in rows)
    assert [r.component_id for r in rows] == groups([int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows])
    assert any(r.component_id != r.doc_id for r in rows)


def test_first_hash_is_sparks(spark):
    text = "One shingle ONLY here"
    assert spark.sql("select xxhash64('one shingle only here')").first()[0] % 2**64 == simhash.fingerprint(text)


def test_odd_rows(spark):
    rows = [(1, "same text, twice"), (1, "same text, twice"), (2, None), (3, ""), (None, "no id"), (4, "word"), (5, "x y " * 30_000), (6, " \t\n"), (None, "x y " * 30_000), (1, "another text under the first id")]
    found = check(spark.createDataFrame([(i, t, "k", 7, 0, 1) for i, t in rows], "doc_id long, text string, fp string, n int, id int, label int"))
    assert sorted(r.doc_id for r in found if int(r.fingerprint, 16) == 0) == [2, 3, 6]
    assert [r.component_id for r in found if r.doc_id in (2, 3, 6)] == [2, 2, 2]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_subtrees_and_pieces(spark, sf):
    """Cutting the trie finely, and hot subtrees in pieces, changes nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    edited = docs.where("length(text) > 2000").limit(20).selectExpr("doc_id + 100000 as doc_id", "concat(text, ' and a few more words') as text")
    check(docs.union(edited), subtree=3)


@pytest.mark.parametrize("turned", [False, True])
def test_trie_links_join_what_brute_force_joins(turned):
    rng = np.random.default_rng(3)
    flip = lambda x, k: x ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    base = [int(x) for x in rng.integers(0, 2**63, 300)]
    cloud = [flip(base[0], 3) for _ in range(800)]
    v = np.array(sorted({*base, *cloud, *(flip(x, k) for x in base[:60] for k in range(7))}), np.uint64)
    turn = lambda x: (x << np.uint64(32)) | (x >> np.uint64(32))
    links = [simhash.trie_links(v, None), tuple(map(turn, simhash.trie_links(turn(v), None)))]
    if turned:  # the same from all pairs of parts
        parts = [v[i::3] for i in range(3)]
        links = [tuple(map(back, simhash.trie_links(to(a), None if a is b else to(b)))) for to, back in ((np.array, np.array), (turn, turn)) for i, a in enumerate(parts) for b in parts[i:]]
    at, label = {int(x): i for i, x in enumerate(v)}, np.arange(len(v))
    for a, b in ((a, b) for x, y in links for a, b in zip(x, y, strict=True)):
        i, j = label[at[int(a)]], label[at[int(b)]]
        label[label == max(i, j)] = min(i, j)
        assert int(a ^ b).bit_count() <= 4
    assert [int(v[x]) for x in label] == groups(v, [int(x) for x in v])
    assert sum(len(x) for x, _ in links) <= 12 * len(v)  # forests, not all the pairs of the cloud
