"""Near-duplicates by SimHash, linked in a self-join of the binary trie of all fingerprints.

A text's fingerprint has a bit where more than half of its shingles' hashes have it (XXH64, seed 42, of every run of
``width`` words, repeats included). Two fingerprints that differ in at most ``most`` bits are linked.

The join. Distinct fingerprints form a binary trie. Node pairs are traversed together from the root down; a pair whose
paths differ adds one to its differing bits and is pruned beyond the budget; small nodes are compared directly. Of two
halves of the bits, one has at most ``most // 2`` of the differing ones, so the trie is walked twice, either half first
and with that smaller budget until the half ends: at 4 bits and 2**24 fingerprints a level holds some 150 pairs a
fingerprint then, instead of 6,000.

How it scales. The trie is cut into subtrees of at most ``subtree`` fingerprints by a histogram of the 16 leading bits (at
most 65,536 rows on the driver); a fuller one is cut in pieces by a hash. Each pair of subtrees within the budget is one
task's work, and fingerprints travel to it as packed arrays, some 8 bytes for each pair their subtree is in. A task hands
on a spanning forest of what it links, and skips node pairs that are one component already, so a dense cloud of near
copies makes neither rows nor visits in the square of its size. Components come from label rounds in shared storage.

Cases: a null, empty or wordless text has fingerprint zero and is linked like any other; fewer words than ``width`` are one
shingle. Every row comes out, repeated ids too, each by its own text. Null ids are never a component's name: where a
component has no other, ``component_id`` is null. Ties (bits set in exactly half the hashes) are 0. Very long texts are
taken whole. Other columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import graph, skew, spill, textkit

_TOP = 16  # leading bits of the histogram that cuts the trie
_PAIRS = 1 << 17  # node pairs that are expanded at once
_LEAF = 64  # pairs of fingerprints that are compared directly


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    last = min(width, len(words)) - 1
    spans = list(zip((end - size).tolist(), end[last:].tolist(), strict=False))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(spans), 1 << 16):
        hashes = np.array([digest(line[a:b], 42) for a, b in spans[i : i + (1 << 16)]], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans)).view(">u8")[0])


class Forest:
    """Labels of 0 .. n-1 that merge along links; keeps the links that merged something."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self._changes()

    def _changes(self) -> None:
        self.changes = np.cumsum(np.r_[False, self.label[1:] != self.label[:-1]]) if len(self.label) else self.label

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        merged = False
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            high, at = np.unique(np.maximum(a, b), return_index=True)  # each label joins one lower label
            self.kept.append((i[at], j[at]))
            to = np.arange(len(self.label))
            to[high] = np.minimum(a, b)[at]
            while (to[to] != to).any():
                to = to[to]
            self.label, merged = to[self.label], True
        if merged:
            self._changes()

    def one(self, la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> np.ndarray:
        """Whether all in [la, ha) and [lb, hb) have one label."""
        return (self.changes[la] == self.changes[ha - 1]) & (self.changes[lb] == self.changes[hb - 1]) & (self.label[la] == self.label[lb])


def trie_links(left: np.ndarray, right: np.ndarray | None, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that links of at most ``most`` differing bits, ``most // 2`` of them in the leading half, join:
    between ``left`` and ``right``, or within ``left``. Both are distinct unsigned numbers."""
    n = len(left)
    v = np.sort(left) if right is None else np.r_[np.sort(left), np.sort(right)]
    forest = Forest(len(v))
    before: dict[int, np.ndarray] = {}  # by depth: how many of the first i fingerprints have the bit

    def split(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in before:
            before[depth] = np.r_[0, np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        return hi - (before[depth][hi] - before[depth][lo])

    def compare(la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> None:
        wide = hb - lb
        size = (ha - la) * wide
        stop = np.cumsum(size)
        for at in range(0, len(size), 1 << 14):
            part = slice(at, at + (1 << 14))
            k = np.arange(size[part].sum()) - np.repeat(stop[part] - size[part] - (stop[at] - size[at]), size[part])
            w = np.repeat(wide[part], size[part])
            i, j = np.repeat(la[part], size[part]) + k // w, np.repeat(lb[part], size[part]) + k % w
            near = (i != j) & (np.bitwise_count(v[i] ^ v[j]) <= most)
            forest.link(i[near], j[near])

    whole = [np.array([x]) for x in ((0, n, 0, n) if right is None else (0, n, n, len(v)))]
    stack = [(0, *whole, np.array([0]))] if n and len(v) > (n if right is not None else 1) else []
    while stack:
        depth, la, ha, lb, hb, apart = stack.pop()
        if len(la) > _PAIRS:
            stack += [(depth, *(x[i : i + _PAIRS] for x in (la, ha, lb, hb, apart))) for i in range(0, len(la), _PAIRS)]
            continue
        go = ~forest.one(la, ha, lb, hb)
        small = go & (((ha - la) * (hb - lb) <= _LEAF) | (depth == 64))
        compare(la[small], ha[small], lb[small], hb[small])
        go &= ~small
        if not go.any():
            continue
        la, ha, lb, hb, apart = (x[go] for x in (la, ha, lb, hb, apart))
        ma, mb = split(depth, la, ha), split(depth, lb, hb)
        own = (la == lb) & (ha == hb)
        budget = most // 2 if depth < 32 else most
        sides = [(la, ma, lb, mb, apart, True), (ma, ha, mb, hb, apart, True), (la, ma, mb, hb, apart + 1, True), (ma, ha, lb, mb, apart + 1, ~own)]
        made = [[], []]
        for a, b, c, d, e, asked in sides:
            keep = (a < b) & (c < d) & (e <= budget) & asked
            same = keep & own & (a == c)
            for to, which in zip(made, (keep & ~same, same), strict=True):
                to.append([x[which] for x in (a, b, c, d, e)])
        for to in made:  # a node with itself goes on first, so that clouds are one component before they meet others
            children = [np.concatenate(x) for x in zip(*to, strict=True)]
            if len(children[0]):
                stack.append((depth + 1, *children))
    if not forest.kept:
        return v[:0], v[:0]
    i, j = (np.concatenate(x) for x in zip(*forest.kept, strict=True))
    return v[i], v[j]


class Cut:
    """Subtrees of a trie from the counts of its leading bits."""

    def __init__(self, counts: dict[int, int], subtree: int):
        full = np.zeros((1 << _TOP) + 1, np.int64)
        for top, n in counts.items():
            full[top + 1] = n
        total = np.cumsum(full)
        found, stack = [], [(0, 0)]
        while stack:
            prefix, depth = stack.pop()
            lo, hi = prefix << (_TOP - depth), (prefix + 1) << (_TOP - depth)
            n = int(total[hi] - total[lo])
            if n > subtree and depth < _TOP:
                stack += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
            elif n:
                found.append((lo, depth, -(-n // subtree)))
        self.start, self.depth, self.pieces = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.first = np.cumsum(self.pieces) - self.pieces  # number of each subtree's first piece

    def members(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subtree and piece number of each fingerprint."""
        of = np.searchsorted(self.start, (v >> np.uint64(64 - _TOP)).astype(np.int64), "right") - 1
        return of, self.first[of] + (textkit.mix(v) % self.pieces[of].astype(np.uint64)).astype(np.int64)

    def partners(self, of: int, budget: int) -> np.ndarray:
        """Piece numbers of all subtrees whose paths differ from this one's in at most ``budget`` bits."""
        common = np.minimum(self.depth, self.depth[of])
        near = np.flatnonzero(np.bitwise_count((self.start ^ self.start[of]) >> (_TOP - common)) <= budget)
        return np.concatenate([self.first[t] + np.arange(self.pieces[t]) for t in near])


def _walk(prints: DataFrame, turned: bool, most: int, subtree: int) -> DataFrame:
    """Links (a, b) found with the leading half first, or, ``turned``, with the other half first."""
    spark = prints.sparkSession
    order = F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)") if turned else F.col("fp")
    rows = prints.select(order.alias("v"))
    top = F.shiftrightunsigned("v", 64 - _TOP)
    counts = {r[0]: r[1] for r in rows.groupBy(top).count().collect()}  # 65,536 rows at most
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    cut = Cut(counts, subtree)

    def deal(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            v = np.concatenate(held)
            of, member = cut.members(v)
            by = np.argsort(member, kind="stable")
            v, of, member = v[by], of[by], member[by]
            starts = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])
            for lo, hi in zip(starts, np.r_[starts[1:], len(v)], strict=True):
                me, others = member[lo], cut.partners(of[lo], most // 2)
                u, w = np.minimum(me, others), np.maximum(me, others)
                for at in range(0, len(others), 1024):
                    part = slice(at, at + 1024)
                    yield pa.RecordBatch.from_arrays([pa.array(u[part]), pa.array(w[part]), pa.array((u[part] != me).astype(np.int32)), pa.array([v[lo:hi].tobytes()] * len(u[part]), pa.binary())], ["u", "w", "side", "packed"])

        for batch in given:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= 1 << 20:
                yield from packed()
                held.clear()
        if held and sum(map(len, held)):
            yield from packed()

    def join(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        packs = table["packed"].to_pylist()
        left, right = (np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(packs[i], np.uint64) for i in np.flatnonzero(side == s))]) for s in (0, 1))
        a, b = trie_links(left, None if table["u"][0] == table["w"][0] else right, most)
        return pa.table([pa.array((x << np.uint64(32) | x >> np.uint64(32) if turned else x).view(np.int64)) for x in (a, b)], ["a", "b"])

    dealt = rows.repartitionByRange(F.shiftrightunsigned("v", 1)).mapInArrow(deal, "u long, w long, side int, packed binary")
    return dealt.groupBy("u", "w").applyInArrow(join, "a long, b long")


def near_duplicates(df: DataFrame, width: int = 4, most: int = 4, key: str = "doc_id", text: str = "text", subtree: int = 1 << 15) -> DataFrame:
    """For each row: key, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the least key that it reaches."""
    spark = df.sparkSession
    spill.small_batches(spark)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.batches(given):
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    texts = textkit.one_text_column(df, key, text=text).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    docs = spill.stash(texts.mapInArrow(run, "id long, fp long").withColumn("row", F.monotonically_increasing_id()))
    prints = spill.stash(docs.groupBy("fp").agg(F.min("id").alias("lead"), F.count("*").alias("n")))
    links = spill.stash(_walk(prints, False, most, subtree).union(_walk(prints, True, most, subtree)))
    labels = graph.components(links).withColumnRenamed("id", "fp")
    of_print = spill.stash(prints.select("fp", "lead").join(labels, "fp"))
    groups = spill.stash(of_print.groupBy("component").agg(F.min("lead").alias("least"), F.count("*").alias("n")))
    named = skew.split_join(of_print.select("fp", "component"), groups.select("component", "least"), "component", groups.select("component", "n"), of_print.count(), F.col("fp"))
    leads = prints.select("fp", "lead").join(named.select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "lead").alias("component_id"))
    out = skew.split_join(docs, leads, "fp", prints.select("fp", "n"), docs.count(), F.col("row"))
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
