"""Packing token sequences into windows by non-negative least squares.

Documents are encoded once and stored. A document longer than the window gives whole windows from its start and one rest.
The lengths of the rests alone, not the tokens, go to packers of some 16,000 documents each. For these lengths, in classes,
all combinations of few classes that fill a window are listed; repeat counts for them are solved by non-negative least
squares against the histogram and rounded down; documents fill these patterns, the last place of each by the longest
document that fits. What is left goes greedily into the fullest sequence with room. Then the emptiest sequences are taken
apart, until their documents hold what all others are short of; cut to size they fill every sequence that is short by more
than a 256th of the window. What is left of them is laid end to end and cut into windows, and the last part of less than a
window into powers of two, which need no padding. So no sequence pads more than a 256th, and only few documents are cut.

How it scales. Besides the stored tokens of the rests, two or four bytes each, only some numbers of each document are
exchanged; the tokens of documents that are cut are met again for the checksums of their pieces.

Cases: a null text is the empty text, which still has its end token. Very long texts are encoded in parts, cut at white
space. Repeated rows each get their pieces. Columns besides the key and the text are dropped. An empty table gives an
empty table. Equal lengths go in the order of their rows. sequence_id is the packer's number times 2**32 plus a count, so it is unique
without coordination; what a packer decides is written once, so a task that runs again finds it.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import spill, textkit

_KEPT = 300_000  # words remembered in a worker, twice
_PART = 1 << 21  # characters of a text that are encoded at a time


class WordIds:
    """Ids by the tokenizers library for a vocabulary of lower-case words with word ends that drops white space: nothing
    reaches over white space or from word to word, so what was encoded once is looked up. Plain texts are split into words
    by arrays, their distinct words looked up once a call and new ones encoded many at once, as one text; of other texts,
    chunks between white space that are not plain are given to the library one by one."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = textkit.Recent(_KEPT)
        self.spaces = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
        model = json.loads(spec)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in model["added_tokens"]))
        # Letters that composing leaves alone and that lower() and the vocabulary lower alike; blanks as both know them.
        self.plain = re.compile("[\\t-\\r -~\\xa0-\\u012f\\u0131-\\u024f]*")
        # The vocabulary splits a chunk into runs of letters, single digits and runs of the rest.
        self.kind = np.array([0 if self.spaces.match(chr(c)) else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x250 + 1)], np.uint8)
        ends = model["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in model["model"]["vocab"].items() if t.endswith(ends)]] = True

    def _is_plain(self, text: str) -> bool:
        return bool(self.plain.fullmatch(text)) and not ("<|" in text and self.special.search(text))

    def _split(self, text: str) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Where the words of a plain lower-case text start, and the words."""
        codes = np.frombuffer((text + "\n\n\n").encode("utf-32-le"), "<u4")
        kind = self.kind[codes]
        before = np.r_[np.uint8(0), kind[:-1]]
        start = (kind > 0) & ((kind != before) | (kind == 2))
        at = np.flatnonzero((codes == 39) & (before != 3))  # an apostrophe that begins a run may take letters with it
        if len(at):
            # Fixed values: 's 't 'm 'd 're 've 'll are words.
            after, third = codes[at + 1], codes[at + 2]
            one = np.isin(after, [115, 116, 109, 100])
            two = (third == 101) & ((after == 114) | (after == 118)) | (third == 108) & (after == 108)
            start[at[one | two] + 1] = False
            stop = np.r_[at[one] + 2, at[two] + 3]
            start[stop] = kind[stop] > 0
        first = np.flatnonzero(start)
        data = np.frombuffer(text.encode(), np.uint8)
        kept, width = kind[:-3] > 0, None
        if len(data) == len(text):
            data, size = data[kept], np.cumsum(kept, dtype=np.int32)
        else:
            width = 1 + (codes[:-3] >= 0x80).astype(np.int32)
            data, size = data[np.repeat(kept, width)], np.cumsum(kept * width, dtype=np.int32)
        offsets = np.r_[size[first - 1], np.int32(len(data))]
        if len(first) and first[0] == 0:
            offsets[0] = 0
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        return first, words.dictionary_encode()

    def _of_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = list(map(self.words.now.get, words))
        fresh: dict[str, bytes] = {}
        new, older = [], self.words.older
        missing = [i for i, x in enumerate(out) if x is None]
        for i in missing:
            if (found := older.get(words[i])) is not None:
                fresh[words[i]] = found
            else:
                new.append(words[i])
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stop = ((np.flatnonzero(self.ends[got]) + 1) * 4).tolist()
            packed = got.tobytes()
            fresh.update(zip(some, (packed[i:j] for i, j in zip([0, *stop], stop, strict=False)), strict=True))
        for i in missing:
            out[i] = fresh[words[i]]
        self.words.update(fresh)
        return out

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """Of plain lower-case texts."""
        first, words = self._split("\n".join(texts))
        if not len(first):
            return [b""] * len(texts)
        found = self._of_words(words.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        where, store, index = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4"), words.indices.to_numpy()
        sizes = size[index]
        stop = np.cumsum(sizes)
        ids = store[np.repeat(where[index] - stop + sizes, sizes) + np.arange(stop[-1])].tobytes()
        ends = np.searchsorted(first, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        ends = (np.r_[0, stop][ends] * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _parts(self, text: str) -> list[str]:
        if len(text) <= _PART:
            return [text]
        cuts, at = [0], _PART
        while at < len(text) and (m := self.spaces.search(text, at)):
            cuts.append(m.start())
            at = m.start() + _PART
        return [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        pieces: list[tuple[int, int, str]] = []  # text, place in its list, what it says
        for i, text in enumerate(texts):
            for part in self._parts(text):
                if self._is_plain(part):
                    pieces.append((i, len(out[i]), part.lower()))
                    out[i].append(b"")
                    continue
                for chunk in self.spaces.split(part):
                    if self._is_plain(chunk):
                        pieces.append((i, len(out[i]), chunk.lower()))
                        out[i].append(b"")
                    else:  # only the library says
                        out[i].append(np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes())
        at = 0
        while at < len(pieces):
            stop, size = at, 0
            while stop < len(pieces) and (stop == at or size + len(pieces[stop][2]) <= _PART):
                size += len(pieces[stop][2])
                stop += 1
            for (i, n, _), ids in zip(pieces[at:stop], self._plain_ids([x for *_, x in pieces[at:stop]]), strict=True):
                out[i][n] = ids
            at = stop
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def combinations(classes: int, depth: int) -> np.ndarray:
    """One column for each multiset of at most ``depth`` class sizes 1..classes that sums to ``classes``."""
    found: list[list[int]] = []

    def fill(rest: int, most: int, chosen: list[int]) -> None:
        if rest == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for size in range(min(rest, most), 0, -1):
                if size * (depth - len(chosen)) < rest:
                    break
                fill(rest - size, size, [*chosen, size])

    fill(classes, classes, [])
    return np.stack([np.bincount(c, minlength=classes + 1) for c in found], 1)[1:].astype(float)


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| small, by accelerated projected gradients."""
    gram, goal = a @ a.T, a  # steps in the row space: a has many more columns than rows
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (goal.T @ (goal @ y - b)))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


_plans: dict[tuple[int, int], np.ndarray] = {}


class _Shelf:
    """Indices by length; takes the longest that is no longer than asked."""

    def __init__(self, lengths: np.ndarray, window: int):
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for i in np.argsort(lengths, kind="stable").tolist():
            self.by_length[int(lengths[i])].append(i)
        self.there = np.zeros(window + 1, bool)
        self.there[list(self.by_length)] = True

    def take(self, most: int, least: int = 1) -> int | None:
        back = self.there[least : most + 1][::-1]
        if not len(back) or not back[at := int(back.argmax())]:
            return None
        pile = self.by_length[most - at]
        i = pile.pop()
        self.there[most - at] = bool(pile)
        return i

    def put(self, i: int, length: int) -> None:
        self.by_length[length].append(i)
        self.there[length] = True


def pack_lengths(lengths: np.ndarray, window: int, classes: int = 64, depth: int = 3, solved: list[int] | None = None) -> list[list[int]]:
    """Groups of indices whose lengths (1..window) sum to at most the window. ``solved`` gets the number of groups that stand
    first and come from solved patterns."""
    width = window // classes
    of = -(-lengths // width)  # a class holds lengths up to its size
    shelf = _Shelf(lengths, window)
    if (classes, depth) not in _plans:
        _plans[classes, depth] = combinations(classes, depth)
    ways = _plans[classes, depth]
    counts = np.floor(least_squares(ways, np.bincount(of, minlength=classes + 1)[1:].astype(float)) + 0.25).astype(int)
    groups: list[list[int]] = []
    for j in np.argsort(-counts, kind="stable").tolist():
        if counts[j] == 0:
            break
        sizes = [int(s) + 1 for s in np.flatnonzero(ways[:, j])[::-1] for _ in range(int(ways[s, j]))]
        for _ in range(int(counts[j])):
            group, room = [], window
            for n, s in enumerate(sizes):
                last = n == len(sizes) - 1
                i = shelf.take(room if last else s * width, 1 if last else (s - 1) * width + 1)
                if i is None:
                    break
                group.append(i)
                room -= int(lengths[i])
            if len(group) < len(sizes):
                for i in group:
                    shelf.put(i, int(lengths[i]))
                break
            groups.append(group)
    if solved is not None:
        solved.append(len(groups))
    # Greedy rest: longest first, each into the sequence with the least room that still holds it.
    room: dict[int, list[int]] = defaultdict(list)
    for k, g in enumerate(groups):
        room[window - int(lengths[g].sum())].append(k)
    free = np.zeros(window + 1, bool)
    free[list(room)] = True
    while (i := shelf.take(window)) is not None:
        size = int(lengths[i])
        at = int(np.argmax(free[size:])) + size
        if free[at]:
            k = room[at].pop()
            free[at] = bool(room[at])
        else:
            at, k = window, len(groups)
            groups.append([])
        groups[k].append(i)
        room[at - size].append(k)
        free[at - size] = True
    return groups


def place(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (index, start, length); a sequence of less than the window is short by its 256th at most, or its length
    is a power of two."""
    groups = pack_lengths(lengths, window)
    short = np.array([window - int(lengths[g].sum()) for g in groups], np.int64)
    order = np.argsort(-short, kind="stable")
    need = np.where(short[order] > window // 256, short[order], 0)
    supply = np.cumsum(window - short[order])  # of the emptiest sequences, up to each
    n = int(np.argmax(np.r_[0, supply] >= np.r_[need[::-1].cumsum()[::-1], 0]))
    apart = [i for g in order[:n] for i in groups[g]]
    left = int(lengths[apart].sum())
    at = [0, 0]  # document of ``apart``, tokens of it that have a place

    def cut(room: int) -> list[tuple[int, int, int]]:
        found = []
        while room:
            i, start = apart[at[0]], at[1]
            size = min(room, int(lengths[i]) - start)
            found.append((i, start, size))
            room -= size
            at[:] = [at[0] + 1, 0] if start + size == lengths[i] else [at[0], start + size]
        return found

    out = []
    for g in order[n:]:
        gap = int(short[g]) if short[g] > window // 256 else 0
        out.append([(i, 0, int(lengths[i])) for i in groups[g]] + cut(gap))
        left -= gap
    while left:
        room = window if left >= window else 1 << left.bit_length() - 1
        out.append(cut(room))
        left -= room
    return out


def _encoded(df: DataFrame, vocabulary: str, window: int, end_id: int, key: str, text: str) -> DataFrame:
    """(row, k, total, crcs of the whole windows, rest, rest_crc, ids of the rest)."""
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))  # a file of 1.7 MB, whatever the data
    rows = textkit.one_text_column(df, key, text=text)
    kind = rows.schema[key].dataType.simpleString()

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ids:
            _ids[vocabulary] = WordIds(spec.value)
        encode, end = _ids[vocabulary], np.array([end_id], "<u4").tobytes()
        narrow = max(end_id, len(encode.ends) - 1) < 1 << 16
        for batch in textkit.batches(tables, 4000, 8 << 20):
            totals, crcs, rests, rest_crcs, kept = [], [], [], [], []
            for ids in encode([t or "" for t in batch.column(1).to_pylist()]):
                ids += end
                total = len(ids) // 4
                stop = 4 * (total - total % window)
                rest = ids[stop:]
                totals.append(total), rests.append(total % window), rest_crcs.append(zlib.crc32(rest))
                crcs.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, stop, 4 * window)])
                kept.append(np.frombuffer(rest, "<u4").astype("<u2").tobytes() if narrow else rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.int64()), pa.array(rest_crcs, pa.int64()), pa.array(kept, pa.binary())], ["k", "total", "crcs", "rest", "rest_crc", "ids"])

    made = rows.mapInArrow(run, f"k {kind}, total long, crcs array<long>, rest long, rest_crc long, ids binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def _placed(docs: DataFrame, window: int, most: int) -> DataFrame:
    """(row, whole, pieces): the sequence of its first whole window, further ones follow, and the pieces of its rest."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [t for t in tables if t.num_rows]
        if not given:
            return
        base = TaskContext.get().partitionId() << 32
        table = pa.Table.from_batches(given).sort_by("row")  # in one order, however they came
        row, rest, windows = (table[c].to_numpy() for c in ("row", "rest", "windows"))
        whole = base + np.cumsum(windows) - windows
        made = base + int(windows.sum())
        pieces: list[list[dict]] = [[] for _ in row]
        with_rest = np.flatnonzero(rest)
        for n, sequence in enumerate(place(rest[with_rest], window)):
            at = 0
            for i, start, size in sequence:
                pieces[with_rest[i]].append({"start": start, "length": size, "sequence": made + n, "offset": at})
                at += size
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "sequence", "offset")]))
        for i in range(0, len(row), 10_000):
            part = slice(i, i + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(row[part]), pa.array(whole[part]), pa.array(pieces[part], kind)], ["row", "whole", "pieces"])

    lengths = docs.select("row", "rest", F.size("crcs").cast("long").alias("windows"))
    packers = max(1, -(-docs.count() // most))
    return lengths.repartition(packers).mapInArrow(run, "row long, whole long, pieces array<struct<start: long, length: long, sequence: long, offset: long>>")


def _checksums(cut: DataFrame) -> DataFrame:
    """(row, cut_crcs) of documents that are cut, from (row, rest, ids, pieces)."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.batches(tables, 4000, 8 << 20):
            found = []
            for rest, ids, pieces in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                x = np.frombuffer(ids, f"<u{len(ids) // rest}").astype("<u4")
                found.append([zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["row", "cut_crcs"])

    return cut.select("row", "rest", "ids", "pieces").mapInArrow(run, "row long, cut_crcs array<long>")


def pack(df: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", most: int = 1 << 14) -> DataFrame:
    """One row per piece, see the module. ``most``: documents whose lengths one packer sees."""
    spark = df.sparkSession
    spill.small_batches(spark, rows=4000)
    docs = spill.stash(_encoded(df, vocabulary, window, end_id, key, text))
    placed = spill.stash(_placed(docs, window, most))
    cut = placed.where(F.size("pieces") > 1)
    crcs = spill.stash(_checksums(docs.select("row", "rest", "ids").join(cut.select("row", "pieces"), "row")))
    met = docs.select("row", "k", "total", "crcs", "rest", "rest_crc").join(placed, "row").join(crcs, "row", "left")
    piece = lambda start, length, crc, sequence, offset: F.struct(start.alias("start"), length.alias("length"), crc.alias("crc"), sequence.alias("sequence"), offset.alias("offset"))
    long = lambda x: F.lit(x).cast("long")
    whole = F.transform("crcs", lambda c, i: piece(i.cast("long") * window, long(window), c, F.col("whole") + i.cast("long"), long(0)))
    rests = F.transform("pieces", lambda p, i: piece(F.col("total") - F.col("rest") + p.start, p.length, F.coalesce(F.get("cut_crcs", i), F.col("rest_crc")), p.sequence, p.offset))
    each = met.select("k", "total", F.explode(F.concat(whole, rests)).alias("p"))
    return each.select(F.col("k").alias(key), "p.start", "p.length", F.col("p.crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), F.col("p.sequence").alias("sequence_id"), "p.offset")


_ids: dict[str, WordIds] = {}


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
