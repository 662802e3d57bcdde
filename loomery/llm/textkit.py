"""Array helpers that several operators share. They run inside tasks, on one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.r_[np.uint64(1), np.full(max(1 << 16, 1 << (n - 1).bit_length()), base, np.uint64)])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` turns into x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each codes[start:end], whatever its place, from one running sum."""
    n = len(codes)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=total[1:])
        at = (total[end] - total[start]) * powers(_PINV, n + 1)[start]
        return mix(at + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` in order, A-Z lower-cased."""
    data = text.encode("utf-8", "surrogatepass").lower()
    if not data:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(data, np.uint8)
    edge = np.diff(np.r_[True, _SPACE[codes], True].astype(np.int8))
    return span_hashes(codes, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of all runs of ``width`` words, sorted; with fewer words, of the whole run; with none, empty."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        run = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            run = (run * np.uint64(_P)) + words[k : k + len(run)]
    return np.unique(mix(run + np.uint64(width)))


def batches(tables: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded rows and bytes; a single larger row stays alone."""
    for table in tables:
        step = max(1, min(rows, table.num_rows * size // max(1, table.nbytes)))
        for at in range(0, table.num_rows, step):
            yield table.slice(at, step)


def one_text_column(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Only the named columns; ``text`` as string. Other columns, whatever their names, take no part."""
    return df.select(*[df[k] for k in keys], df[text].cast("string").alias(text))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written in decimal, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


class Recent:
    """A bounded memo. ``now`` is read directly; ``recall`` looks where older entries are and keeps what it finds. When
    ``now`` is full it becomes the older half, so what is used stays."""

    def __init__(self, most: int):
        self.most = most
        self.now: dict = {}
        self.older: dict = {}

    def recall(self, key):
        found = self.older.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.now) >= self.most:
            self.older = dict(self.now)
            self.now.clear()  # the same object, as loops hold on to it
        self.now[key] = value

    def update(self, found: dict) -> None:
        """Keeps all of ``found``, but for keys of 64 and more characters."""
        if len(self.now) >= self.most:
            self.older = dict(self.now)
            self.now.clear()
        self.now.update((k, v) for k, v in found.items() if len(k) < 64)
