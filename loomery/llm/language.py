"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier on hashed character n-grams predicts each bit. Decoding
takes the codeword with the least weighted loss; bits whose classifier errs more weigh less. Where a second codeword is
about as near, the row is flagged as ambiguous.

The classifiers are fitted on a bounded sample: ``sample`` labelled rows, distinct texts with letters, spread evenly over the languages;
of each language those of the least hashes, so copies count once and every run fits the same model. Every row is predicted, from its whole text.

Cases: of languages whose codewords are equally near the first in alphabetical order is said, and the row is ambiguous. A null text, or one without a letter, is ``und`` with score 0 and not ambiguous. Very long texts are taken whole. A null or repeated id is a row
like any other. Rows with a null language teach nothing. Without labelled rows all is ``und``. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm import spill, textkit

UNKNOWN = "und"
_WIDTH = 4096
_letters: list[np.ndarray] = []


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed 1- to 3-grams, lower-cased, all else than letters as one space."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters[0][codes]
    if not letter.any():
        return None
    x = np.where(letter, codes, 32).astype(np.uint32)
    x = np.r_[np.uint32(32), x[letter | np.r_[True, letter[:-1]]], np.uint32(32)]
    counts = np.zeros(_WIDTH)
    gram = np.zeros(len(x), np.uint32)
    for n in range(3):
        gram = gram[: len(x) - n] * np.uint32(0x01000193) + x[n:] * np.uint32(0x9E3779B1)
        counts += np.bincount((gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(20), minlength=_WIDTH)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # language x bit, of -1 and 1
    weights: np.ndarray  # feature x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit, summing to 1


def codewords(n: int) -> np.ndarray:
    """All ways to split up to 6 languages in two; for more, 48 random bits, the best of 50 draws by least distance."""
    if n <= 6:
        bits = [[1, *(1 if k >> i & 1 else -1 for i in range(n - 1))] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits or [[1]]).T
    rng = np.random.default_rng(7)
    draws = [rng.choice([-1, 1], (n, 48)) for _ in range(50)]
    return max(draws, key=lambda c: -int((c @ c.T - 1000 * np.eye(n)).max()))


def fit(x: np.ndarray, lang: list[str], ridge: float = 0.05) -> Model:
    """Ridge classifiers for all bits at once, in the space of the sample; a bit's trust follows from its error when each
    row is left out."""
    languages = sorted(set(lang))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in lang]].astype(float)
    mean = x.mean(0, dtype=float)
    z = x - mean.astype(np.float32)
    inverse = np.linalg.inv((z @ z.T).astype(float) + ridge * np.eye(len(z)))
    bias = y.mean(0)
    dual = inverse @ (y - bias)
    left_out = y - dual / np.diag(inverse)[:, None]
    error = np.clip((left_out * y <= 0).mean(0), 0.5 / len(y), 0.5)
    trust = np.log((1 - error) / error) + 1e-6
    weights = (z.T @ dual.astype(np.float32)).astype(float)
    return Model(languages, code, weights, bias - mean @ weights, trust / trust.sum())


def decode(model: Model, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its share of the likelihood, and whether the runner-up comes within ``margin`` in mean loss."""
    said = x @ model.weights + model.bias
    loss = np.stack([np.logaddexp(0, -2 * said * word) @ model.trust for word in model.code], 1)
    order = np.sort(loss, 1)
    share = np.exp(-8 * (loss - order[:, :1]))
    near = order[:, 1] - order[:, 0] < margin if loss.shape[1] > 1 else np.zeros(len(x), bool)
    return loss.argmin(1), 1 / share.sum(1), near


def identify(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 1000, margin: float = 0.02, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, ``lang_pred``, ``score`` (0 to 1), ``ambiguous`` and the columns named in ``keep``. ``learn`` says
    which rows teach. One pass counts distinct texts by language (exchanging their hashes), one finds the least hashes, one
    gathers the features of ``sample`` texts, one predicts."""
    spark = df.sparkSession
    spill.small_batches(spark)
    teach = df.where(learn & df[lang].isNotNull()).select(df[lang].cast("string").alias("l"), df[text].cast("string").alias("t"))
    teach = teach.where(F.col("t").rlike(r"\p{L}")).select("l", F.xxhash64("t").alias("h"), "t")
    counts = {r[0]: r[1] for r in teach.select("l", "h").distinct().groupBy("l").count().collect()}  # one row per language
    model = None
    if counts:
        each = max(2, sample // len(counts))

        def below(most: dict[str, int]) -> DataFrame:
            return teach.where(F.col("h") <= F.create_map(*(F.lit(v) for pair in most.items() for v in pair))[F.col("l")])

        # of hashes spread evenly, fewer than ``each`` fall below twice the share once in 10^20 fits or more rarely
        likely = {name: min((1 << 63) - 1, (2 * each + 100 << 64) // n - (1 << 63)) for name, n in counts.items()}
        hashes: dict[str, list[int]] = {}
        for name, h in below(likely).select("l", "h").distinct().collect():
            hashes.setdefault(name, []).append(h)
        chosen = below({name: sorted(found)[:each][-1] for name, found in hashes.items()})

        def once(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A task hands on the first of its copies."""
            seen: set[tuple[str, int]] = set()
            for batch in textkit.batches(tables):
                new = [not (x in seen or seen.add(x)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield batch.filter(pa.array(new, pa.bool_()))

        distinct = chosen.mapInArrow(once, "l string, h long, t string").groupBy("l", "h").agg(F.min("t").alias("t")).select("l", "t")

        def gather(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in textkit.batches(tables):
                found = [(v, f.tobytes()) for v, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (f := features(t)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.string()), pa.array([f for _, f in found], pa.binary())], ["l", "f"])

        rows = sorted((r[0], bytes(r[1])) for r in distinct.mapInArrow(gather, "l string, f binary").collect())
        if rows:
            model = fit(np.frombuffer(b"".join(f for _, f in rows), np.float32).reshape(len(rows), -1), [v for v, _ in rows])
    shared = spark.sparkContext.broadcast(model)  # _WIDTH x bits numbers, whatever the data

    others = list(dict.fromkeys([key, *keep, text]))
    at_text = others.index(text)
    passed = [c for c in others if c in (key, *keep)]

    def predict(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.batches(tables):
            found = [features(t) if shared.value else None for t in batch.column(at_text).to_pylist()]
            n = len(found)
            best, score, near = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
            if at := [i for i, f in enumerate(found) if f is not None]:
                best[at], score[at], near[at] = decode(shared.value, np.stack([found[i] for i in at]), margin)
            names = [*shared.value.languages, UNKNOWN] if shared.value else [UNKNOWN]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array([names[i] for i in best], pa.string()), pa.array(score), pa.array(near)], [*passed, "lang_pred", "score", "ambiguous"])

    out = df.select(*(df[c].cast("string").alias(c) if c == text else df[c] for c in others))
    fields = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in passed)
    return out.mapInArrow(predict, f"{fields}, lang_pred string, score double, ambiguous boolean")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(textkit.crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
