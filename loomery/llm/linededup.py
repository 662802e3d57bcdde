"""Repeated runs of lines, found by winnowing and deleted where they come again.

Only DataFrame functions. A run counts from ``words`` words on (50), whatever its number of lines. Lines without a word
are no part of a sequence, but go with the run around them. A gram is the lines that start within ``words / 2`` words of a
line's start; of the grams that start within ``words / 2`` words of each other the least hash is a fingerprint. All grams
of such a window lie in any run of ``words`` words that starts there, so two places that share a run share a fingerprint.

Fingerprints that occur once are dropped with all that hangs on them. Around the others matches are extended both ways:
each shortest window of ``words`` words, forward from a line and backward from a line, is held against its first
occurrence, and windows that came before mark their lines. The marked lines of a document are merged to runs and deleted;
so every maximal repeated run goes, and the first occurrence of every line stays.

How it scales. Hashes of lines, not texts, are shuffled, 128 bits for each line and window; at 10**12 windows two that
differ agree once in 10**14 corpora. A passage that a million documents share is one group with partial aggregation, not
pairs; where its places meet the group's first they are dealt over several tasks. Texts are shuffled once, to meet the
runs to delete.

Cases: a null text stays null, with 0 lines. Lines are compared without white space around them. "Earlier" is by key, null
keys last, then by a hash of the text, then by place. Rows that repeat both key and text are one document: each comes out,
changed alike. A document all of whose lines go keeps its row, with an empty text. Very long texts are taken whole; one
document's lines are one sorted group. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm import skew, spill

_WORD = r"[^\x20\x09-\x0D]+"


def repeated_runs(df: DataFrame, words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h, runs): for each document with repeated runs its key, its text's hash and an array of (lo, hi) line numbers."""
    docs = df.where(df[text].isNotNull()).select(df[key].alias("k"), F.xxhash64(df[text].cast("string")).alias("h"), df[text].cast("string").alias("t"))
    lines = docs.select("k", "h", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    bare = F.trim(F.translate("line", "\t\r\x0b\x0c", "    "))
    lines = lines.select("k", "h", "pos", F.struct(F.xxhash64(bare).alias("x"), F.xxhash64(F.lit(1), bare).alias("y")).alias("hash"), F.regexp_count("line", F.lit(_WORD)).alias("w")).where("w > 0")
    lines = lines.dropDuplicates(["k", "h", "pos"])  # of repeated rows

    of = Window.partitionBy("k", "h")
    by_place = of.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("end", F.sum("w").over(by_place)).withColumn("start", F.col("end") - F.col("w")).withColumn("total", F.sum("w").over(of))
    half = words // 2
    starting = lambda a, b: of.orderBy("start").rangeBetween(a, b)
    whole = F.col("total") - F.col("start")
    grams = lines.withColumn("gram", F.when(whole >= half, F.xxhash64(F.collect_list("hash.x").over(starting(0, half - 1)))))
    grams = grams.withColumn("least", F.min("gram").over(starting(0, half - 1)))
    grams = grams.withColumn("chosen", F.max("least").over(starting(1 - half, 0)) == F.col("gram"))
    ahead, behind = starting(0, words - 1), of.orderBy("end").rangeBetween(1 - words, 0)
    grams = grams.withColumn("after", F.collect_list("hash").over(ahead)).withColumn("until", F.collect_list("hash").over(behind))
    sides = lambda way, lines: (F.xxhash64(F.lit(way), lines).alias("x"), F.xxhash64(F.lit(way + 2), lines).alias("y"))
    both = F.array(
        F.struct(F.col("least").alias("gram"), *sides(0, F.col("after")), F.col("pos").alias("lo"), F.max("pos").over(ahead).alias("hi"), (whole >= words).alias("full")),
        F.struct(F.first("least").over(behind).alias("gram"), *sides(1, F.col("until")), F.min("pos").over(behind).alias("lo"), F.col("pos").alias("hi"), (F.col("end") >= words).alias("full")),
    )
    sequence = spill.stash(grams.select("k", "h", "gram", "chosen", both.alias("both")))

    prints = spill.stash(sequence.where("chosen").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    windows = sequence.select("k", "h", F.explode("both").alias("of")).select("k", "h", "of.*").where("full").drop("full")
    at = F.struct("k", "h", "lo", "hi")
    near = skew.split_join(windows, prints.select("gram"), "gram", prints, sequence.count(), at, "left_semi")
    windows = spill.stash(near.select("k", "h", "x", "y", "lo", "hi"))
    place = F.struct(F.col("k").isNull().alias("none"), "k", "h", "lo", "hi")
    first = spill.stash(windows.groupBy("x", "y").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    met = skew.split_join(windows, first.select("x", "y", "first"), ["x", "y"], first, windows.count(), at)
    marked = met.where(place > F.col("first")).select("k", "h", "lo", "hi")

    order = of.orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = marked.withColumn("new", F.when(F.col("lo") <= before + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = islands.groupBy("k", "h", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("k", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def dedup_lines(df: DataFrame, words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, ``text`` without repeated runs, and ``n_lines`` and ``n_removed``."""
    runs = repeated_runs(df, words, key, text).select(F.col("k").alias("__k"), F.col("h").alias("__h"), F.col("runs").alias("__runs"))
    t = df[text].cast("string")
    joined = df.join(runs, df[key].eqNullSafe(F.col("__k")) & (F.xxhash64(t) == F.col("__h")), "left")
    lines = F.split(t, "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("__runs", lambda r: (i >= r.lo) & (i <= r.hi)))
    removed = F.aggregate("__runs", F.lit(0).cast("long"), lambda n, r: n + r.hi - r.lo + 1)
    others = [c if c != text else F.when(F.col("__runs").isNull(), t).otherwise(F.array_join(kept, "\n")).alias(text) for c in df.columns]
    count = F.when(t.isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*others, count.alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))


def op6_linededup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same without fingerprints: every window is held against all windows.
OP6_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS raw FROM cut, unnest(range(1, len(ls) + 1)) AS u(i)),
w AS (SELECT doc_id, pos, regexp_replace(regexp_replace(raw, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n FROM l),
e AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS stop FROM w WHERE n > 0),
s AS (SELECT *, stop - n AS start, max(stop) OVER (PARTITION BY doc_id) AS total FROM e),
f AS (
  SELECT doc_id, 'f' AS way, list(line) OVER a AS lines, pos AS lo, max(pos) OVER a AS hi, total - start >= 50 AS whole FROM s
  WINDOW a AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, 'b', list(line) OVER b, min(pos) OVER b, pos, stop >= 50 FROM s
  WINDOW b AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
g AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY way, lines ORDER BY doc_id, lo, hi) AS nth FROM f WHERE whole),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM g WHERE nth > 1),
kept AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
