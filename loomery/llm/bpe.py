"""Byte-pair encoding by a table over prefixes, and decoding.

Every prefix of a piece has exactly one encoding, so it has exactly one last token. An automaton over the vocabulary
lists the tokens that end at each place; of these the one is kept that is compatible with the last token of what
stands before it. Following the kept tokens back from the end gives the ids that merging by rank gives. The work is
linear in the length of a piece: a run of a million letters is no special case.

Cases: a null text is the empty text (no ids, decoded ""). Repeated rows each get their row. Columns besides the key
and the text are dropped, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import spill, textkit

_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_KEPT = 250_000  # pieces remembered in a worker, twice


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class PrefixEncoder:
    """Encodes and decodes with one byte-level vocabulary in the tokenizers library's JSON form."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        model, letters = json.loads(spec), _byte_letters()
        vocab = model["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            whole, pair = vocab[a + b], (vocab[a], vocab[b])
            self.joined.setdefault(pair, r)
            if whole not in self.halves:
                self.rank[whole], self.halves[whole] = r, pair
        self.matches = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i not in self.special.values():
                self.matches.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.matches.make_automaton()
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.known = textkit.Recent(_KEPT)
        self.known_pieces = textkit.Recent(_KEPT)
        s = _SPACES
        self.chunks = regex.compile(f" ?[^{s}]+|[{s}]+(?![^{s}])|[{s}]+")
        self.pieces = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{s}\\p{{L}}\\p{{N}}]+|[{s}]+(?![^{s}])|[{s}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens side by side: no merge across their border comes before the merges that
        built the tokens on it. Time runs backwards here; each step takes apart the token that was built last."""
        latest = 1 << 60  # a merge across the border must have come before this to break the pair
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < latest:
                return False
            built_a, built_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if built_a < 0 and built_b < 0:
                return True
            if built_a > built_b:  # equal merges run from left to right: the one inside a came first
                latest, a = built_a, self.halves[a][1]
            else:  # and the one across the border comes before the one inside b
                latest, b = built_b + 1, self.halves[b][0]

    def piece(self, data: bytes) -> bytes:
        """Ids of one piece, packed as little-endian 32-bit integers."""
        n, ok = len(data), self.pair_ok
        last: list[tuple[int, int] | None] = [None] * n
        for end, found in self.matches.iter(data.decode("latin-1")):
            if last[end] is not None:
                continue
            token, size = found
            start = end - size
            if start >= 0:
                before = last[start]
                if before is None:
                    continue
                pair = (before[0], token)
                good = ok.get(pair)
                if good is None:
                    if len(ok) > _KEPT:
                        ok.clear()
                    good = ok[pair] = self.compatible(*pair)
                if not good:
                    continue
            last[end] = found
        ids, at = [], n - 1
        while at >= 0:
            token, size = last[at]  # type: ignore[misc]
            ids.append(token)
            at -= size
        return np.array(ids[::-1], "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for piece in self.pieces.findall(chunk):
            ids = self.known_pieces.now.get(piece)
            if ids is None:
                ids = self.known_pieces.recall(piece)
            if ids is None:
                ids = self.piece(piece.encode())
                if len(piece) < 64:
                    self.known_pieces.put(piece, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        out, known = [], self.known.now
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for chunk in self.chunks.findall(part):
                ids = known.get(chunk)
                if ids is None:
                    ids = self.known.recall(chunk)
                if ids is None:
                    ids = self._chunk(chunk)
                    if len(chunk) < 64:
                        self.known.put(chunk, ids)
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_built: dict[str, PrefixEncoder] = {}


def encode_decode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``, the text that the
    ids give back. No shuffle: each task encodes the rows it reads. The vocabulary file (a fixed 1.5 MB) is broadcast."""
    spark = df.sparkSession
    spill.small_batches(spark)
    spec = spark.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _built:
            _built[vocabulary] = PrefixEncoder(spec.value)
        coder = _built[vocabulary]
        for batch in textkit.batches(tables):
            ids = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([coder.decode(i) for i in ids], pa.string())], ["k", "n_tokens", "ids", "decoded"])

    rows = textkit.one_text_column(df, key, text=text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("k", key)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
