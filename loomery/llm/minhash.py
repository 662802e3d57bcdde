"""Near-duplicate groups by circulant MinHash, banding and exact verification.

A document's set is that of its distinct runs of ``width`` words. Shingles are numbered by a hash, reordered by a first
permutation, and one second permutation, shifted circularly by k, gives coordinate k of the signature: the shifts of one
table replace one permutation per coordinate. Documents that agree on a band of ``rows`` coordinates are candidates, and
the Jaccard similarity of the full sets decides: 100 * intersection >= percent * union, in whole numbers.

How it scales. Documents with equal sets are one class from the start, so exact copies cost one row each. Every class is
first held against one class only, the least that it shares a bucket with; what these links join is one component. The
partners of a class stream past its set, in several tasks if there are very many. Where a bucket still holds classes of
different components, it is dealt in pieces of bounded size, two pieces to a task, together with the full sets. There
each pair of classes of different components is tested in the first bucket it shares, by counting common shingles, and
only links that join two components are handed on, so a task hands on fewer rows than it reads. No pair of different
components with a common band goes untested, and no group is gathered whole. The comparisons within a bucket grow with
the square of those of its classes that no link has joined; rows do so only beyond a piece. With 32 bands of 5 rows a link
at the threshold 0.85 is missed once in 10**8, at 0.8 three times in 10**6. Texts of hundreds of thousands of distinct
shingles share their least numbers and so become candidates of each other; the test on full sets decides all the same.

Cases: rows with a null id link with nothing; each comes out, with its size and a null ``component_id``. A repeated id is one document and gives one row; if its texts differ, the
one with the least hash stands. A null or wordless text has an empty set, links with nothing and is its own component.
Texts of fewer words than ``width`` are one shingle; very long ones are taken whole. Other columns are dropped. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm import graph, skew, spill, textkit

BANDS, ROWS = 32, 5
_PIECE_SHINGLES = 400_000
_SPACE = 1 << 20  # numbers that shingles get
_tables: list[np.ndarray] = []


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """``size`` coordinates: coordinate k is the least second[(first[s] + k) mod _SPACE] over shingles s."""
    if not _tables:
        rng = np.random.default_rng(20)
        first, second = rng.permutation(_SPACE).astype(np.uint32), rng.permutation(_SPACE).astype(np.uint32)
        _tables.extend([first, np.r_[second, second[:1024]]])
    shifted = np.lib.stride_tricks.sliding_window_view(_tables[1], size)
    at = _tables[0][shingles >> np.uint64(64 - 20)]
    least = np.full(size, _SPACE, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(least, shifted[at[i : i + 2048]].min(0), out=least)
    return least


def _sketches(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, h, n, digest, bands): hash of the text, size and digest of the set, bucket of each band."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = np.arange(BANDS, dtype=np.uint64)
        for batch in textkit.batches(tables):
            n, digests, bands = [], [], []
            for t in batch.column(2).to_pylist():
                s = textkit.shingle_hashes(t, width)
                n.append(len(s))
                if not len(s):
                    digests.append(None), bands.append(None)
                    continue
                with np.errstate(over="ignore"):
                    digests.append(np.array([s.sum(), textkit.mix(s ^ np.uint64(0xA5A5A5A5)).sum()]).tobytes())
                    h = lane
                    for column in signature(s).reshape(BANDS, ROWS).T:
                        h = textkit.mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
                bands.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "h", "n", "digest", "bands"])

    return _texts(df, key, text).mapInArrow(run, "id long, h long, n long, digest binary, bands array<long>")


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = textkit.one_text_column(df, key, text=text)
    return rows.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def _stars(first: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``first`` (a, b) the pairs whose full sets are similar enough. The partners of each a stream past its set."""
    counts = spill.stash(first.groupBy("a").agg(F.count("*").alias("n")))
    most = skew.share(first.count())
    pieces = F.ceil(F.col("n") / most).cast("int")
    many = F.broadcast(counts.where(F.col("n") > most).select("a", pieces.alias("pieces")))  # below skew.KEYS rows
    salted = first.join(many, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("pieces", F.lit(1))).cast("int").alias("salt"), F.col("b").alias("id"), F.lit(1).alias("role"))
    hubs = counts.select("a", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("salt"), F.col("a").alias("id"), F.lit(0).alias("role"))
    rows = salted.union(hubs).join(texts.select("id", "text"), "id").select("a", "salt", "role", "id", "text")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in textkit.batches(tables):
            a, b = [], []
            for x, role, i, t in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                own = textkit.shingle_hashes(t, width)
                if role == 0:
                    hub = own
                    continue
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if 100 * both >= percent * (len(hub) + len(own) - both):
                    a.append(x), b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.batches(tables):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([textkit.shingle_hashes(t, width).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["id", "bands", "hashes"])

    return texts.select("id", "bands", "text").mapInArrow(run, "id long, bands array<long>, hashes binary")


def joining(ids: np.ndarray, label: np.ndarray, own: np.ndarray, apart: bool, before: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between classes of different labels, as few as join all that links join. ``before``: the earlier bands of each
    class; a pair that agrees on one of them is tested there. ``apart``: only pairs of different ``own``."""
    n = np.array([len(s) for s in sets])
    start = np.cumsum(n) - n
    dense = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    here = np.zeros(dense.max() + 1, bool)
    of = np.unique(label, return_inverse=True)[1]
    out = []
    for i in range(1, len(ids)):
        could = (of[:i] != of[i]) & (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i]))
        if apart:
            could &= own[:i] != own[i]
        could = np.flatnonzero(could)
        if before.shape[1] and len(could):
            could = could[~(before[could] == before[i]).any(1)]
        if not len(could):
            continue
        mine = dense[start[i] : start[i] + n[i]]
        here[mine] = True
        size = n[could]
        stop = np.cumsum(size)
        both = np.add.reduceat(here[dense[np.repeat(start[could] - stop + size, size) + np.arange(stop[-1])]], stop - size, dtype=np.int64)
        here[mine] = False
        for j in could[100 * both >= percent * (size + n[i] - both)]:
            if of[j] != of[i]:
                of[of == of[j]] = of[i]
                out.append((int(ids[j]), int(ids[i])))
    return out


def _rest(buckets: DataFrame, texts: DataFrame, labels: DataFrame, sizes: DataFrame, rows: int, width: int, percent: int, piece: int) -> DataFrame:
    """Links (a, b) between classes of different components in a common bucket, as few as each task needs to join them."""
    named = spill.stash(buckets.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("label")))
    mixed = named.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    mixed = mixed.select("bucket", F.greatest(F.ceil(F.col("m") / piece), F.ceil(F.col("shingles") / _PIECE_SHINGLES)).cast("int").alias("pieces"))
    dealt = skew.split_join(named.drop("n"), mixed, "bucket", sizes, rows, F.col("id")).withColumn("own", F.pmod(F.hash("id"), F.col("pieces")))
    dealt = spill.stash(dealt)
    sets = _sets(texts.join(dealt.select("id").distinct(), "id", "left_semi"), width)
    # A piece meets every other piece, and itself, in one task each.
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("bucket", "id", "label", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def links(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy())
        ids, label, own = (table[c].to_numpy()[order] for c in ("id", "label", "own"))
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)[order]
        band = int((bands[0] == table["bucket"][0].as_py()).argmax())
        hashes = table["hashes"].to_pylist()
        found = joining(ids, label, own, table["p"][0].as_py() != table["q"][0].as_py(), bands[:, :band], [np.frombuffer(hashes[i], np.uint64) for i in order], percent)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return spread.join(sets, "id").groupBy("bucket", "p", "q").applyInArrow(links, "a long, b long")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", piece: int = 2048) -> DataFrame:
    """One row per id: key, ``n_shingles``, ``component_id`` (the least id reachable by links, itself included)."""
    spark = df.sparkSession
    spill.small_batches(spark)
    all_sketches = spill.stash(_sketches(df, key, text, width))
    one = Window.partitionBy("id").orderBy("h")
    sketches = spill.stash(all_sketches.where("id is not null").withColumn("copy", F.row_number().over(one)).where("copy = 1").drop("copy"))
    leads = spill.stash(sketches.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n")))  # one for each distinct set
    classes = spill.stash(sketches.join(leads.select("id"), "id", "left_semi").where("n > 0"))
    all_buckets = classes.select("id", "n", F.explode("bands").alias("bucket"))
    sizes = spill.stash(all_buckets.groupBy("bucket").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1"))
    rows = BANDS * classes.count()
    buckets = spill.stash(skew.split_join(all_buckets, sizes.select("bucket", "low"), "bucket", sizes, rows, F.col("id")))
    first = spill.stash(buckets.where("id > low").groupBy("id").agg(F.min("low").alias("a")).select("a", F.col("id").alias("b")))
    wanted = buckets.select("id").distinct().join(classes.select("id", "h", "bands"), "id")
    texts = spill.stash(_texts(df, key, text).join(wanted, ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "text", "bands"))
    links = spill.stash(_stars(first, texts, width, percent))
    labels = graph.components(links)
    more = spill.stash(_rest(buckets.select("bucket", "id", "n"), texts, labels, sizes, rows, width, percent, piece))
    if more.limit(1).count():
        labels = graph.components(links.union(more))
    by_class = leads.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    joined = skew.split_join(sketches, by_class, "digest", leads.select("digest", "n"), sketches.count(), F.col("id"), "left")
    out = joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    nameless = all_sketches.where("id is null").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.union(nameless)


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Every document against every other that shares a shingle.
OP8_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle FROM t, unnest(range(1, greatest(len(w) - 1, 2))) u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(label) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c ON id = doc_id LEFT JOIN n USING (doc_id)
"""
