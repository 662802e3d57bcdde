"""Hard negatives by an inverted multi-index, exact.

Components become whole numbers, floor(256 * component), and a score is an integer inner product. Vectors are cut in two
halves; each half has a codebook of at most 256 codes, and a pair of codes is a cell. From a code's distance to a half
query and the code's radius follows the most that a half score can be; the sum over both halves bounds a cell. For each
anchor a heap hands out cells by falling bound (the multi-sequence order). The search for positives stops where no cell left can
hold a row that comes before the last one found; that for negatives likewise, within the window that each
positive's score sets. So what is returned is exact, whatever the codebooks.

How it scales. Anchors look in 8 cells, then in 64 more, then in all that their bounds still ask for: three rounds, each in
shared storage, not one per cell. A cell with many entries is dealt in pieces, and so are the anchors that look there; a task
ranks one piece of anchors against one of entries and hands on at most what is asked for. Equal vectors of one label are one
entry with their least ids, so copies cost one; equal anchors search once. The driver sees the codebooks, radii and the sizes of cells (at
most 65,536). Codebooks are fitted on at most ``sample`` distinct vectors, those of the least hashes; the cells hold all
rows. Where vectors point in random directions bounds are loose and most cells are visited; clusters make them tight.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part, nor do vectors of another length
than the most frequent one or with a component of 2**20 or more, as scores must fit a long. A repeated (id, label, vector)
counts once; an anchor never takes a row of its own id as positive. Ties go to the smaller id. A positive score of 0 asks
for negatives of score 0, a negative one for none. Other columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm import skew, spill, textkit

_ROUNDS = (8, 64, None)  # cells that an anchor looks in
_NEVER = -(1 << 62)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, as longs."""
    most = max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(y).max(initial=0))) * x.shape[1]
    if most < 1 << 53:  # every partial sum is a whole number that a double holds
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64)
    return np.einsum("id,jd->ij", x, y)


class Index(NamedTuple):
    """Codebooks (whole numbers, so that bounds are the same on every machine), radii, and rows per cell."""

    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    filled: np.ndarray

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either half the least and the most score of each code's rows."""
        half = self.codes[0].shape[1]
        out = []
        for codes, radius, part in zip(self.codes, self.radii, (q[:half], q[half:]), strict=True):
            middle = products(part[None], codes)[0]
            reach = np.ceil(np.sqrt(float((part.astype(float) ** 2).sum())) * radius * (1 + 1e-12)).astype(np.int64) + 1
            out.append((middle - reach, middle + reach))
        return out

    def cells(self, q: np.ndarray, below: int | None, need: int, ceiling: int, most: int | None) -> tuple[list[int], int]:
        """Cells by falling bound, from just under ``below`` down to ``need``, all of one bound together, at most about
        ``most``; without those whose least score is over ``ceiling``. Also the bound down to which all have been seen."""
        (low1, up1), (low2, up2) = self.bounds(q)
        order1, order2 = np.argsort(-up1, kind="stable"), np.argsort(-up2, kind="stable")
        up1, up2 = up1[order1].tolist(), up2[order2].tolist()
        n1, n2, width = len(up1), len(up2), len(order2)
        heap, seen, out, last = [(-(up1[0] + up2[0]), 0, 0)], {0}, [], None
        while heap:
            bound = -heap[0][0]
            if bound < need or (most is not None and len(out) >= most and bound < last):
                break
            _, i, j = heapq.heappop(heap)
            last = bound
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < n1 and b < n2 and a * width + b not in seen:
                    seen.add(a * width + b)
                    heapq.heappush(heap, (-(up1[a] + up2[b]), a, b))
            c1, c2 = order1[i], order2[j]
            if (below is None or bound < below) and self.filled[c1, c2] and low1[c1] + low2[c2] <= ceiling:
                out.append(int(c1 * width + c2))
        return out, last if last is not None and heap else _NEVER


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k whole centres of the rows, by Lloyd's rounds from evenly spaced rows of the sorted distinct ones."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].astype(float)
    for _ in range(rounds):
        of = nearest(distinct.astype(float), centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, distinct)
        n = np.bincount(of, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(np.rint(centres).astype(np.int64), axis=0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def _unpack(packed: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), ">i8").astype(np.int64).reshape(-1, d)


def _assign(entries: DataFrame, codes: tuple[np.ndarray, np.ndarray], d: int) -> DataFrame:
    half = d // 2

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.batches(given, 4096):
            x = _unpack(batch.column(1), d).astype(float)
            columns = []
            for book, part in zip(codes, (x[:, :half], x[:, half:]), strict=True):
                of = nearest(part, book.astype(float))
                columns += [pa.array(of.astype(np.int32)), pa.array(np.sqrt(((part - book[of]) ** 2).sum(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["key", "packed", "label", "ids", "c1", "r1", "c2", "r2"])

    made = entries.select("key", "packed", "label", "ids").mapInArrow(run, "key string, packed binary, label long, ids array<long>, c1 int, r1 double, c2 int, r2 double")
    return made.withColumn("cell", F.col("c1") * len(codes[1]) + F.col("c2"))


def _packed(vec: str) -> Column:
    """Eight bytes a component, the highest first."""
    return F.unhex(F.array_join(F.transform(vec, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def build(entries: DataFrame, d: int, sample: int, cell: int) -> tuple[Index, DataFrame]:
    """The index, and all ``entries`` with their cells."""
    half = d // 2
    taken = entries.orderBy("key").limit(sample).select("packed").collect()
    x = np.frombuffer(b"".join(r.packed for r in taken), ">i8").astype(np.int64).reshape(-1, d)
    k = int(min(256, max(1, np.ceil(np.sqrt(entries.count() / cell)))))
    codes = (codebook(x[:, :half], k), codebook(x[:, half:], k))
    held = spill.stash(_assign(entries, codes, d))
    radii = []
    for c, r, book in (("c1", "r1", codes[0]), ("c2", "r2", codes[1])):
        radius = np.zeros(len(book))
        for row in held.groupBy(c).agg(F.max(r).alias("r")).collect():
            radius[row[0]] = row.r * (1 + 1e-9)
        radii.append(radius)
    filled = np.zeros((len(codes[0]), len(codes[1])), bool)
    for row in held.select("c1", "c2").distinct().collect():
        filled[row.c1, row.c2] = True
    return Index(codes, tuple(radii), filled), held


def _look(asked: DataFrame, index: Index, d: int, most: int | None) -> DataFrame:
    """For each key the cells of its next round. ``need`` of a window is the score of its last row so far, once it has k."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.batches(given, 500):
            x = _unpack(batch.column(1), d)
            cells, below = [], []
            for q, windows, before in zip(x, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if not windows or before == _NEVER:
                    cells.append([]), below.append(_NEVER)
                    continue
                need, ceiling = min(w["need"] for w in windows), max(w["high"] for w in windows)
                found, until = index.cells(q, before, need, ceiling, most)
                cells.append(found), below.append(until)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(below, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], ["key", "packed", "label", "windows", "below", "cells"])

    return asked.mapInArrow(run, "key string, packed binary, label long, windows array<struct<w: int, low: long, high: long, need: long>>, below long, cells array<int>")


def _rank(held: DataFrame, looks: DataFrame, d: int, k: int, same: bool, piece: int) -> DataFrame:
    """(key, w, score, low, ids): of every cell piece the first k entries of each window."""
    visits = looks.select("key", "packed", "label", "windows", F.explode("cells").alias("cell"))
    sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))
    turns = visits.groupBy("cell").agg(F.ceil(F.count("*") / (piece // 4)).cast("int").alias("turns"))
    both = F.broadcast(spill.stash(sizes.join(turns, "cell")))  # a row for each cell, at most 65,536
    left = held.join(both, "cell").select("cell", F.pmod(F.hash("key"), "pieces").alias("p"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("q"), "packed", "label", "ids")
    right = visits.join(both, "cell").select(F.col("cell").alias("at"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("ap"), F.pmod(F.hash("key"), "turns").alias("aq"), "key", "packed", "label", "windows")

    def rank(entries: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"key": [], "w": [], "score": [], "low": [], "ids": []}
        if entries.num_rows and asked.num_rows:
            ids = entries["ids"].to_pylist()
            low = np.array([i[0] for i in ids])
            order = np.argsort(low, kind="stable")
            low, labels = low[order], entries["label"].to_numpy()[order]
            x = _unpack(entries["packed"], d)[order]
            keys, windows, label = asked["key"].to_pylist(), asked["windows"].to_pylist(), asked["label"].to_numpy()
            q = _unpack(asked["packed"], d)
            for at in range(0, len(q), 256):
                scores = products(q[at : at + 256], x)
                for i, s in enumerate(scores, at):
                    fits = (labels == label[i]) if same else (labels != label[i])
                    for w in windows[i]:
                        found = np.flatnonzero(fits & (s >= max(w["low"], w["need"])) & (s <= w["high"]))
                        if len(found) > k:
                            worst = np.partition(s[found], len(found) - k)[len(found) - k]
                            found = found[s[found] >= worst]
                        for j in found[np.argsort(-s[found], kind="stable")][:k]:
                            for name, v in zip(out, (keys[i], w["w"], int(s[j]), int(low[j]), ids[order[j]][:k]), strict=True):
                                out[name].append(v)
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return left.groupBy("cell", "p", "q").cogroup(right.groupBy("at", "ap", "aq")).applyInArrow(rank, "key string, w int, score long, low long, ids array<long>")


def hunt(held: DataFrame, index: Index, asked: DataFrame, d: int, k: int, same: bool, piece: int = 4096) -> DataFrame:
    """(key, w, found): of each window of each key the first k rows (score, id), best first, of the same label or of others.
    ``asked``: key, packed, label, windows (w, low, high)."""
    state = asked.select("key", "packed", "label", F.transform("windows", lambda w: F.struct(w.w.alias("w"), w.low.alias("low"), w.high.alias("high"), w.low.alias("need"))).alias("windows"), F.lit(None).cast("long").alias("below"))
    best = None
    for most in _ROUNDS:
        looks = spill.stash(_look(state, index, d, most))
        new = _rank(held, looks, d, k, same, piece)
        new = new if best is None else new.union(best)
        first = Window.partitionBy("key", "w").orderBy(F.desc("score"), "low")
        best = spill.stash(new.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).drop("nth"))
        rows = F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id"))))))  # k * k at most
        each = best.groupBy("key", "w").agg(F.slice(rows, 1, k).alias("found"))
        if most is None:
            return each.select("key", "w", F.transform("found", lambda r: F.struct((-r.minus).alias("score"), r.id.alias("id"))).alias("found"))
        last = each.where(F.size("found") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", -F.element_at("found", -1).minus))).alias("last"))
        told = looks.select("key", "packed", "label", "windows", "below").join(last, "key", "left")
        state = told.select("key", "packed", "label", F.transform("windows", lambda w: w.withField("need", F.coalesce(F.try_element_at(F.col("last"), w.w), w.need))).alias("windows"), "below")


def mine(df: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, key: str = "vec_id", vector: str = "embedding", sample: int = 8192, cell: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchors`` selects."""
    spark = df.sparkSession
    spill.small_batches(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = df.select(df[key].cast("long").alias("id"), label.cast("long").alias("label"), df[vector].cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    whole = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 20)))
    rows = rows.where("id is not null and label is not null and vec is not null").where(whole).where(F.size("vec") > 0)
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not length:
        return spark.createDataFrame([], schema)
    d = length[0].d
    rows = rows.where(F.size("vec") == d).withColumn("vec", F.transform("vec", lambda v: F.floor(256 * v).cast("long")))
    rows = rows.withColumn("key", F.concat(F.hex(F.xxhash64("vec", "label")), F.hex(F.xxhash64(F.lit(1), "vec", "label"))))

    least = Window.partitionBy("key").orderBy("id")
    few = rows.select("key", "id", "vec", "label").withColumn("nth", F.dense_rank().over(least)).where(F.col("nth") <= positives + 1)
    entries = few.groupBy("key").agg(F.first("vec").alias("vec"), F.first("label").alias("label"), F.array_sort(F.collect_set("id")).alias("ids"))
    entries = spill.stash(entries.select("key", _packed("vec").alias("packed"), "label", "ids"))
    index, held = build(entries, d, sample, cell)
    asking = rows.where("asks").select(F.col("id").alias("anchor_id"), "key").distinct()
    counts = spill.stash(asking.groupBy("key").agg(F.count("*").alias("n")))
    keys = spill.stash(entries.join(counts, "key").select("key", "packed", "label"))

    window = lambda low, high, w: F.struct(w.cast("int").alias("w"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    all_scores = keys.withColumn("windows", F.array(window(F.lit(_NEVER), F.lit(-_NEVER), F.lit(0))))
    found = spill.stash(hunt(held, index, all_scores, d, positives + 1, True).select("key", "found"))
    # A window for each positive: 50 * positive <= 100 * negative <= 95 * positive.
    windows = "transform(found, (p, i) -> named_struct('w', i, 'low', if(p.score < 0, -1L, p.score div 2 + p.score % 2), 'high', 19 * (p.score div 20) + 19 * (p.score % 20) div 20))"
    asked = keys.join(found, "key").withColumn("windows", F.filter(F.expr(windows), lambda w: w.low >= 0)).drop("found").where(F.size("windows") > 0)
    bad = hunt(held, index, asked, d, negatives, False).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "found"))).alias("bad"))
    good = F.transform("found", lambda p, i: F.struct(p.id.alias("id"), p.score.alias("score"), F.try_element_at(F.col("bad"), i).alias("bad")))
    of_key = found.join(bad, "key").select("key", good.alias("good"))
    met = skew.split_join(asking, of_key, "key", counts, asking.count(), F.col("anchor_id"))
    own = F.slice(F.filter("good", lambda p: p.id != F.col("anchor_id")), 1, positives)
    each = met.select("anchor_id", F.explode(own).alias("p")).select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode("p.bad").alias("nth", "bad"))
    return each.select("anchor_id", "positive_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("bad.id").alias("negative_id"), "positive_score", F.col("bad.score").alias("negative_score"))


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label)


#: Every anchor against every row.
OP12_SQL = """
WITH sound AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM sound),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM x a, x b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
