"""Scoring texts with a bigram model whose quantised counts live in a log-frequency Bloom filter.

Outcomes are the V known tokens and one for all unknown ones. P1(w) = (c(w) - D) / N for known w and D V / N for the
unknown; P(w|h) = max(f(h,w) - D, 0) / c(h) + rest(h) P1(w), where rest(h) is what the first term leaves over all w, so
the probabilities of all outcomes sum to one. f is a quantised count, rounded down: a bigram of level q is entered in the
filter as the q items (bigram, 1), ..., (bigram, q) and read by probing level after level until one is missing. A false
positive (below one in a hundred) adds a little mass. A text begins after an end token. D is DISCOUNT.

The filter holds every bigram, cut into hash shards whose number grows with the corpus, so that a shard has about
SHARD_TOKENS tokens' bigrams and one task builds it. Documents are read once into blocks, each a list of its distinct
tokens and, for each document, its places in that list. A block's distinct bigrams, with their counts in the texts that
teach, stand in stored packets, one for each shard. Shards sum the counts and build their filters, and that is the last
that is seen of the counts: filters are broadcast, as many shards at a time as make up FILTER_BYTES, and the stored packets
of these shards probe them, level after level. What a block gets back are the levels found for its bigrams in their order. What a
shard's bigrams give to their first tokens goes to the shards of tokens, which count the blocks' tokens and answer them
likewise. A frequent token or bigram costs one entry per block, not one per use. The rounds of broadcasts grow with the
corpus, at some 20 million tokens to a round; each reads its own packets only.

A bigram is known by two 32-bit halves of its tokens' hashes. Of the tokens 0.2 % share their half with another one at 10**7
distinct tokens, 2 % at 10**8, 21 % at 10**9; their bigrams are then counted together.

Cases: a null text is the empty text: one end token. A very long text is one row of its block. A row whose ``learn`` is null does not teach. Repeated rows each
count and each get their row. Null ids are kept. Other columns are dropped. An empty table gives an empty table; if no
row teaches, base and score are 0, as the unknown outcome is the only one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm import spill, textkit

DISCOUNT = 0.75
SHARD_TOKENS = 1 << 21
BASE = 1.3  # of the quantisation
GROUP_TOKENS = 1 << 24  # tokens whose bigrams' packets are stored together
FILTER_BYTES = 64 << 20  # of filters that are broadcast at once; one shard has some megabytes
_PROBES = 4
_LOW = 5  # low places of a key
_BLOCK_TOKENS = 4_000_000
_BLOCK_PAIRS = 2_000_000


def _hashes(words: list[bytes]) -> np.ndarray:
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    return textkit.span_hashes(np.frombuffer(b"".join(words), np.uint8), end - size, end)


def _packed(x: np.ndarray) -> bytes:
    """The bytes of all numbers, place by place."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed_keys(x: np.ndarray) -> bytes:
    """Steps between sorted keys: their high places compressed, then the low ones, which are random, as they are."""
    places = np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zlib.compress(np.ascontiguousarray(places[_LOW:]), 1) + places[:_LOW].tobytes()


def _unpacked_keys(data: bytes) -> np.ndarray:
    reader = zlib.decompressobj()
    high = np.frombuffer(reader.decompress(data), np.uint8).reshape(8 - _LOW, -1)
    low = np.frombuffer(reader.unused_data, np.uint8).reshape(_LOW, -1)
    return np.cumsum(np.ascontiguousarray(np.concatenate([low, high]).T).view("<u8").ravel(), dtype=np.uint64)


def _tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), b""]


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in held])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(np.concatenate([n for _, n in held])[order], first, dtype=np.int32)


def _by_shard(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """The shards, by the first ``bits`` bits, of sorted keys, and where their keys stand."""
    found, first = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    return found, [slice(i, j) for i, j in zip(first, [*first[1:], len(keys)][: len(first)], strict=True)]


TOKENS, BIGRAMS = 1, 2


def _blocks(df: DataFrame, learn: Column, key: str, text: str, most_words: int, bits: int) -> DataFrame:
    """Rows of four kinds: a document (k, learn, n_tokens, places); the list of its block (the halves of its tokens'
    hashes); and packets of its tokens or bigrams for a shard (packet, shard, keys, seen), with their counts in texts that
    teach. Bigrams stand in the order of their mixed keys, tokens in that of their halves and then the list."""
    rows = df.select(df[key].alias("k"), learn.alias("learn"), df[text].cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    names = ["block", "k", "learn", "n_tokens", "places", "halves", "packet", "shard", "keys", "seen"]

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        place: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next place
        trained = np.zeros(1 << 18, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = used = 0
        key_type = pa.null()

        def row(n: int, **given: pa.Array) -> pa.RecordBatch:
            kinds = [pa.int64(), key_type, pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *(given.get(c, pa.nulls(n, t)) for c, t in zip(names[1:], kinds[1:], strict=True))], names)

        def packets(packet: int, keys: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
            shards, parts = _by_shard(keys, bits)
            for i in range(0, len(parts), 1000):
                some = parts[i : i + 1000]
                yield row(len(some), packet=pa.array([packet] * len(some), pa.int32()), shard=pa.array(shards[i : i + 1000].astype(np.int64)), keys=pa.array([_packed_keys(keys[at]) for at in some], pa.binary()), seen=pa.array([_packed(seen[at].astype("<i4")) for at in some], pa.binary()))

        def listed() -> Iterator[pa.RecordBatch]:
            hashes = _hashes(list(place))
            half = hashes >> np.uint64(32)
            yield row(1, halves=pa.array([half.astype("<u4").tobytes()], pa.binary()))
            order = np.argsort(half, kind="stable")
            yield from packets(TOKENS, hashes[order], trained[: len(place)][order])
            pairs, seen = _merged(held)
            yield from packets(BIGRAMS, *_merged([(textkit.mix(half[pairs >> 32] << np.uint64(32) | half[pairs & 0xFFFFFFFF]), seen)]))

        for batch in textkit.batches(tables):
            key_type = batch.column(0).type
            sizes, packed = [], []
            for learns, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _tokens(t)
                at = np.fromiter(map(place.__getitem__, words), np.int32, len(words))
                if learns:
                    if len(place) > len(trained):
                        trained = np.r_[trained, np.zeros(len(place), np.int64)]
                    np.add.at(trained, at, 1)
                wide = at.astype(np.int64)
                before = np.concatenate([[place[b""]], wide[:-1]])
                held.append((before << 32 | wide, np.full(len(at), bool(learns), np.int32)))
                fresh += len(at)
                sizes.append(len(at))
                packed.append(_packed(at.astype("<i4")))
            yield row(len(sizes), k=batch.column(0), learn=batch.column(1), n_tokens=pa.array(sizes, pa.int64()), places=pa.array(packed, pa.binary()))
            used += sum(sizes)
            if fresh > 1_000_000:
                held = [_merged(held)]
                fresh = 0
            if len(place) >= most_words or used >= _BLOCK_TOKENS or len(held[0][0]) >= _BLOCK_PAIRS:
                yield from listed()
                block += 1
                place, held = defaultdict(count().__next__), []
                fresh = used = 0
                trained[:] = 0
        if place:
            yield from listed()

    return rows.mapInArrow(run, f"block long, k {kind}, learn boolean, n_tokens long, places binary, halves binary, packet int, shard long, keys binary, seen binary")


def _positions(keys: np.ndarray, level: np.ndarray | int, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        h = textkit.mix(keys + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
        step = textkit.mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        return [(h + np.uint64(t) * step) & np.uint64(bits - 1) for t in range(_PROBES)]


class LogFrequencyFilter(NamedTuple):
    words: np.ndarray  # the bits, as 64-bit integers
    top: int  # the highest level entered

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of the keys, 0 where not even level 1 is there."""
        level = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for j in range(1, self.top + 1):
            ok = np.ones(len(alive), bool)
            for p in _positions(keys[alive], j, len(self.words) * 64):
                ok &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            alive = alive[ok]
            if not len(alive):
                break
            level[alive] = j
        return level


def build_filter(keys: np.ndarray, level: np.ndarray) -> LogFrequencyFilter:
    """Of keys with levels from 1 on; 12 to 24 bits an item."""
    bits = 1 << max(16, int(12 * max(1, level.sum()) - 1).bit_length())
    words = np.zeros(bits // 8, np.uint8)
    top = int(level.max(initial=0))
    for j in range(1, top + 1):
        for p in _positions(keys[level >= j], j, bits):
            np.bitwise_or.at(words, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    return LogFrequencyFilter(words.view("<u8"), top)


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a shard's packets: the distinct keys, their counts, and for each packet where its keys stand among them."""
    parts = [_unpacked_keys(x) for x in table["keys"].to_pylist()]
    keys, back = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.bincount(back, np.concatenate([_unpacked(x, "<i4") for x in table["seen"].to_pylist()]), len(keys))
    return keys, n, np.split(back, np.cumsum([len(x) for x in parts])[:-1])


def shard_filters(bigrams: DataFrame, bits: int) -> DataFrame:
    """Rows of two kinds: for each shard its filter (shard, words, top); and, for each shard of tokens, what the bigrams of a
    shard give to their first tokens (shard, halves, sums)."""

    def run(table: pa.Table) -> pa.Table:
        keys, n, _ = _counted(table)
        keys, n = keys[n > 0], n[n > 0]
        level = (np.floor(np.log(n) / np.log(BASE) + 1e-9) + 1).astype(np.int64)
        made = build_filter(keys, level)
        half, back = np.unique(textkit.unmix(keys) >> np.uint64(32), return_inverse=True)
        mass = np.bincount(back, BASE ** (level - 1.0) - DISCOUNT, len(half))
        shards, parts = _by_shard(half << np.uint64(32), bits)
        return pa.table([
            pa.array([table["shard"][0].as_py(), *shards.tolist()], pa.int64()),
            pa.array([made.words.tobytes(), *[None] * len(parts)], pa.binary()),
            pa.array([made.top, *[None] * len(parts)], pa.int32()),
            pa.array([None, *(_packed_keys(half[x]) for x in parts)], pa.binary()),
            pa.array([None, *(_packed(mass[x]) for x in parts)], pa.binary()),
        ], ["shard", "words", "top", "halves", "sums"])

    return bigrams.select("shard", "keys", "seen").groupBy("shard").applyInArrow(run, "shard long, words binary, top int, halves binary, sums binary")


def broadcast_rounds(filters: DataFrame, bits: int, some: int) -> Iterator[tuple[int, list[int]]]:
    """Parts of the stored packets, from 1, with the shards in order whose filters are broadcast together: FILTER_BYTES at
    most, unless one shard has more."""
    part, shards, size = 0, [], 0
    sizes = filters.where(F.col("words").isNotNull()).select("shard", F.octet_length("words").alias("n")).orderBy("shard")
    for r in sizes.toLocalIterator():  # two numbers a shard, some at a time
        if shards and (1 + (r.shard >> (bits - some)) != part or size + r.n > FILTER_BYTES):
            yield part, shards
            shards, size = [], 0
        part, size = 1 + (r.shard >> (bits - some)), size + r.n
        shards.append(r.shard)
    if shards:
        yield part, shards


def probed(packets: DataFrame, filters: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(of_block, shard, levels): the levels that the broadcast filters have for each packet's bigrams, in their order; and
    what is broadcast, for the caller to destroy once the rows are written."""
    context = packets.sparkSession.sparkContext
    held = context.broadcast({r.shard: (r.words, r.top) for r in filters.select("shard", "words", "top").collect()})

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {shard: LogFrequencyFilter(np.frombuffer(words, "<u8"), top) for shard, (words, top) in held.value.items()}
        for batch in tables:
            found = [zlib.compress(known[s].levels(_unpacked_keys(k)).astype(np.uint8), 1) for s, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["of_block", "shard", "levels"])

    return packets.select("block", "shard", "keys").mapInArrow(run, "of_block long, shard long, levels binary"), held


def shard_counts(tokens: DataFrame, masses: DataFrame) -> DataFrame:
    """For each block and shard, in the order of the block's tokens: their ``counts`` and what their bigrams were ``given``;
    ``new``: distinct tokens with a count, told once for each shard."""

    def run(packets: pa.Table, masses: pa.Table) -> pa.Table:
        keys, c, places = _counted(packets)
        given = np.zeros(len(keys))
        if masses.num_rows:
            half, back = np.unique(np.concatenate([_unpacked_keys(x) for x in masses["halves"].to_pylist()]), return_inverse=True)
            mass = np.bincount(back, np.concatenate([_unpacked(x, "<f8") for x in masses["sums"].to_pylist()]), len(half))
            at = np.minimum(np.searchsorted(half, keys >> np.uint64(32)), len(half) - 1)
            given = np.minimum(np.where(half[at] == keys >> np.uint64(32), mass[at], 0.0), c)
        new = [int((c > 0).sum()), *[0] * (len(places) - 1)]
        answers = [pa.array([_packed(x[at]) for at in places], pa.binary()) for x in (c.astype("<i8"), given)]
        return pa.table([packets["block"], packets["shard"], *answers, pa.array(new, pa.int64())], ["of_block", "shard", "counts", "given", "new"])

    left = tokens.select("block", "shard", "keys", "seen").groupBy("shard")
    return left.cogroup(masses.select("shard", "halves", "sums").groupBy("shard")).applyInArrow(run, "of_block long, shard long, counts binary, given binary, new long")


def score(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", most_words: int = 250_000) -> DataFrame:
    """Per row: key, learned (whether it taught), n_tokens, n_known, train_tokens, base_score (log10 of the text under
    (c + 0.5) / (N + 0.5 (V + 1)) for each token) and score. ``most_words``: distinct tokens that close a block."""
    spark = df.sparkSession
    spill.small_batches(spark)
    learn = F.coalesce(learn, F.lit(False))
    size = df.agg(F.sum(F.octet_length(df[text].cast("string")))).first()[0] or 0
    bits = max(6, int(size // (8 * SHARD_TOKENS)).bit_length())  # a token has some 6 bytes
    some = int(size // (6 * GROUP_TOKENS)).bit_length()
    group = F.shiftright("shard", bits - some)
    blocks = _blocks(df, learn, key, text, most_words, bits)
    stored, drop = spill.stash_parts(blocks, F.when(F.coalesce(F.col("packet") == BIGRAMS, F.lit(False)), 1 + group).otherwise(0), 1 + (1 << some))
    bigrams = stored.where("part > 0")
    stored = stored.where("part = 0")
    docs = stored.where(F.col("packet").isNull()).select("block", "k", "learn", "n_tokens", "places", "halves")
    total = docs.where("learn").agg(F.sum("n_tokens")).first()[0] or 0

    filters = spill.stash_last(shard_filters(bigrams, bits))
    answered = spill.Appended(spark, "of_block long, shard long, levels binary")
    done = 0
    for part, shards in broadcast_rounds(filters, bits, some):
        while done < part:  # parts that no later round reads
            drop(done) if done else None
            done += 1
        mine = F.col("shard").between(shards[0], shards[-1])
        rows, held = probed(bigrams.where((F.col("part") == part) & mine), filters.where(mine & F.col("words").isNotNull()))
        answered.add(rows)
        held.destroy()
    drop(done) if done else None
    levels = answered.read()
    counts = spill.stash_last(shard_counts(stored.where(F.col("packet") == TOKENS), filters.where(F.col("halves").isNotNull())))
    distinct = counts.agg(F.sum("new")).first()[0] or 0
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    answers = counts.select("of_block", "shard", "counts", "given", *none("levels")).union(levels.select("of_block", "shard", *none("counts", "given"), "levels"))
    kind = docs.schema["k"].dataType.simpleString()
    names = ["k", "learned", "n_tokens", "n_known", "base", "score"]

    def sums(docs: pa.Table, answers: pa.Table) -> pa.Table:
        listed = docs.filter(pc.is_valid(docs["halves"]))
        docs = docs.filter(pc.is_null(docs["halves"]))
        answers = answers.sort_by("shard")
        of_tokens, of_bigrams = answers.filter(pc.is_valid(answers["counts"])), answers.filter(pc.is_valid(answers["levels"]))
        half = np.frombuffer(listed["halves"][0].as_py(), "<u4").astype(np.uint64)
        order = np.argsort(half, kind="stable")
        c, given = np.zeros(len(half), np.int64), np.zeros(len(half))
        c[order] = np.concatenate([_unpacked(x, "<i8") for x in of_tokens["counts"].to_pylist()])
        given[order] = np.concatenate([_unpacked(x, "<f8") for x in of_tokens["given"].to_pylist()])
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(c > 0, 1 - given / np.maximum(c, 1), 1.0)
            single = np.where(c > 0, (c - DISCOUNT) / max(total, 1), 1.0)  # the unknown outcome's share comes later
        start = int(np.flatnonzero(half == (_hashes([b""]) >> np.uint64(32))[0])[0])
        places = [_unpacked(x, "<i4") for x in docs["places"].to_pylist()]

        def runs() -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            i = 0
            while i < len(places):  # some documents at a time
                j, size = i, 0
                while j < len(places) and (j == i or size < 500_000):
                    size += len(places[j])
                    j += 1
                at, of = np.concatenate(places[i:j]), np.repeat(np.arange(j - i), [len(x) for x in places[i:j]])
                before = np.r_[start, at[:-1]]
                before[np.flatnonzero(np.diff(of, prepend=-1))] = start
                yield i, j, at, of, before, half[before] << np.uint64(32) | half[at]
                i = j

        pairs = np.unique(np.concatenate([np.unique(pair) for *_, pair in runs()]))
        level = np.zeros(len(pairs), np.uint8)  # levels are in the order of the mixed pairs
        level[np.argsort(textkit.mix(pairs))] = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in of_bigrams["levels"].to_pylist()])
        rows: list[np.ndarray] = []
        for i, j, at, of, before, pair in runs():
            known = c[at] > 0
            p = rest[before] * single[at]
            found = np.flatnonzero(known & (given[before] > 0))
            q = level[np.searchsorted(pairs, pair[found])]
            p[found] += np.where(q > 0, BASE ** (q - 1.0) - DISCOUNT, 0) / c[before[found]]
            rows.append(np.stack([np.bincount(of, x, j - i) for x in (known, np.log10(c[at] + 0.5), np.log10(np.clip(p, 1e-300, 1)))]))
        n_known, base, scores = np.concatenate(rows, 1)
        return pa.table([docs["k"], docs["learn"], docs["n_tokens"], pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(scores)], names)

    rows = docs.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(sums, f"k {kind}, learned boolean, n_tokens long, n_known long, base double, score double")
    unknown = F.lit(float(np.log10(DISCOUNT * distinct / total)) if total else 0.0)
    return rows.select(F.col("k").alias(key), "learned", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))).alias("base_score"), (F.col("score") + (F.col("n_tokens") - F.col("n_known")) * unknown).alias("score"))


def op2_lm(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(textkit.crc_remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    rows = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held)
    return rows.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
