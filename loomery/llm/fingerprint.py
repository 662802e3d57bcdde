"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors. Sums don't depend on order, and a paragraph is inserted or deleted by adding or subtracting its vector. The
vector has two parts:

- EXACT lanes modulo 2**64, a hash of the whole paragraph. Equal multisets have equal sums; others differ but for chance.
- NEAR lanes modulo 2**32: each run of GRAM code points of the paragraph (begun by GRAM - 1 blanks, so that a short
  paragraph has runs too) adds 1 or -1 to one lane. The inner product of two such sums estimates the number of common
  runs, so the cosine of the sums is a likeness, with a standard error of about 1 / sqrt(NEAR).

Cases: a null text is the empty text, which has no paragraphs; so are empty lines no paragraphs. Two empty documents have
likeness 1, an empty and another 0. Equal sums have likeness 1. Very long texts are taken whole, one at a time. Repeated
rows each get their row; other columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm import spill, textkit

EXACT, NEAR, GRAM = 16, 256, 10


class Sum:
    """The sum of paragraphs' vectors."""

    def __init__(self, exact: np.ndarray | None = None, near: np.ndarray | None = None):
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.near = np.zeros(NEAR, np.uint32) if near is None else near

    def plus(self, text: str, times: int = 1) -> Sum:
        """With the paragraphs of ``text`` inserted, or deleted if ``times`` is -1."""
        lines = [x for x in text.split("\n") if x]
        if not lines:
            return self
        with np.errstate(over="ignore"):
            digests = b"".join(hashlib.blake2b(x.encode(), person=p).digest() for x in lines for p in (b"lane 0-7", b"lane 8-15"))
            exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
            blank = "\n" * (GRAM - 1)  # in no paragraph
            codes = np.frombuffer((blank + blank.join(lines)).encode("utf-32-le"), "<u4")
            end = np.flatnonzero(codes != 10) + 1  # a run for each code point of a paragraph, ending there
            h = textkit.span_hashes(codes, end - GRAM, end)
            near = np.bincount(h >> np.uint64(56), np.where(h & np.uint64(1), 1.0, -1.0), NEAR).astype(np.int64).astype(np.uint32)
            if times < 0:
                exact, near = np.uint64(0) - exact, np.uint32(0) - near
            return Sum(self.exact + exact, self.near + near)

    def text(self) -> str:
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.near.astype("<u4").tobytes()).decode()


def likeness(a: Sum, b: Sum) -> float:
    if (a.exact == b.exact).all() and (a.near == b.near).all():
        return 1.0
    x, y = (s.near.view(np.int32).astype(float) for s in (a, b))
    size = np.sqrt((x @ x) * (y @ y))
    return float(np.clip(x @ y / size, 0, 1)) if size else 0.0


def edited(text: str, other: str) -> str:
    """The last third of ``text`` replaced by as many of the first code points of ``other``, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def edited_sum(text: str, whole: Sum, other: str) -> tuple[str, Sum]:
    """The edited text and its sum, from the whole text's sum: only the paragraphs after the last one that stays are
    deleted and inserted."""
    new = edited(text, other)
    stays = text.rfind("\n", 0, len(text) - len(text) // 3) + 1
    return new, whole.plus(text[stays:], -1).plus(new[stays:])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_chars``, ``fingerprint`` (base64 of the lanes, little-endian). No shuffle."""
    spark = df.sparkSession
    spill.small_batches(spark)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.batches(tables):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([Sum().plus(t).text() for t in texts])], ["k", "n_chars", "fingerprint"])

    rows = textkit.one_text_column(df, key, text=text)
    return rows.mapInArrow(run, f"k {rows.schema[key].dataType.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("k", key)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are <= key (0 for a null), in two steps of about sqrt(len) comparisons."""
    width = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not blocks:
        return F.lit(0)
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    block = at_most(F.array(*(F.lit(b[0]) for b in blocks))) - 1
    inside = at_most(F.get(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), block))
    return F.when(key.isNull() | (block < 0), 0).otherwise(block * width + inside)


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, where the next row
    is the one with the next smaller key (rows of equal keys by a hash of the text and by text, null keys last) and, after
    the last, the first.

    Rows go once through a shuffle into ranges of keys, in order; each range also gets a copy of the first row of the
    range after it. ``ranges``: of about equal numbers of rows, eight for each shuffle partition if not given; their bounds
    and first keys are all that the driver sees. A key that many rows share, or none, is cut further by the hash."""
    spark = df.sparkSession
    ranges = ranges or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spill.small_batches(spark)
    rows = textkit.one_text_column(df, key, text=text).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    least = [int(b) for b in rows.where("k is not null").approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges)]
    bounds, often = sorted(set(least)), {k: n for k, n in Counter(least).items() if n > 1}
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("k").isNull())).first()
    pieces = F.when(F.col("k").isNull(), F.lit(max(1, -(-ranges * nulls // max(1, n)))))
    if often:
        pieces = pieces.otherwise(F.create_map(*(F.lit(v) for pair in often.items() for v in pair))[F.col("k")])
    part = F.floor((F.shiftright("h", 11) + F.lit(1 << 52)) / F.lit(float(1 << 53)) * pieces)
    # so ranges, too, run from large keys to small; a frequent key comes after the other keys of its range
    place = F.when(F.col("k").isNull(), 1).otherwise(-_range_of(F.col("k"), bounds)).cast("long") * (1 << 20) + F.coalesce(part + 1, F.lit(0))
    rows = rows.withColumn("r", place)
    first = F.min(F.struct((-F.col("k")).alias("k"), "h")).alias("first")
    heads = [(r[0], None if r[1] is None else -r[1], r[2]) for r in sorted(rows.groupBy("r").agg(first).select("r", "first.*").collect())]
    if not heads:
        return spark.createDataFrame([], f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    turn = [(heads[i][0], *heads[(i + 1) % len(heads)]) for i in range(len(heads))]  # range, the one after it, its first row
    heads_table = F.broadcast(spark.createDataFrame(turn, "of long, after long, top long, hash long"))
    guests = rows.join(heads_table, (F.col("r") == F.col("after")) & F.col("k").eqNullSafe(F.col("top")) & (F.col("h") == F.col("hash"))).groupBy("of").agg(F.first("k").alias("k"), F.min(F.coalesce("t", F.lit(""))).alias("t"), F.first("h").alias("h"))
    dealt = rows.select("k", "t", "h", "r", F.lit(False).alias("guest")).union(guests.select("k", "t", "h", F.col("of").alias("r"), F.lit(True).alias("guest")))
    ordered = dealt.repartition("r").sortWithinPartitions("r", "guest", F.col("k").desc_nulls_last(), "h", F.coalesce("t", F.lit(""))).select("k", "t", "guest")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, str, Sum] | None = None
        for batch in textkit.batches(tables):
            out = []
            for k, t, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = t or ""
                whole = Sum().plus(t)
                if last:
                    new, other = edited_sum(last[1], last[2], t)
                    out.append((last[0], len(last[1]), hashlib.sha256(new.encode()).hexdigest(), last[2].text(), other.text(), likeness(last[2], other), likeness(last[2], whole)))
                last = None if guest else (k, t, whole)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    fields = pa.schema([("k", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return ordered.mapInArrow(run, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("k", key)


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
