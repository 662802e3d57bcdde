"""Queries on strings and similarities."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import similarity as S
from loomery.functions import text as X


def normal_forms(spark, d):
    c = F.col("p_name")
    return spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey",
        X.lenient_ascii(c).alias("lenient"),
        X.without_space(c).alias("no_space"),
        X.without_punctuation(F.col("p_type")).alias("no_punctuation"),
        X.ascii_words(c).alias("ascii"),
        X.collapse(F.concat(F.lit("  "), F.replace(c, F.lit(" "), F.lit("   ")))).alias("collapsed"),
        X.plain_dashes(F.concat(c, F.lit("–—"))).alias("dashes"),
        X.unquoted(F.concat(F.lit('"'), c, F.lit("'"))).alias("unquoted"),
        X.key_form(F.concat(c, F.lit("#"), F.col("p_brand"))).alias("key"),
        X.path_key(F.concat(c, F.lit(".[0]"))).alias("path"),
    )


NORMAL_SQL = r"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) AS lenient, regexp_replace(p_name, '\s+', '', 'g') AS no_space,
regexp_replace(p_type, '[!-/:-@\[-`{-~]', '', 'g') AS no_punctuation, regexp_replace(p_name, '[^A-Za-z0-9 ]', '', 'g') AS ascii,
trim(regexp_replace('  ' || replace(p_name, ' ', '   '), '\s+', ' ', 'g')) AS collapsed, p_name || '--' AS dashes, trim(p_name) AS unquoted,
regexp_replace(lower(p_name || '#' || p_brand), '[^a-z0-9]', '', 'g') AS key, regexp_replace(p_name || '.[0]', '[^A-Za-z0-9.]', '', 'g') AS path FROM part"""


def numbers(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = F.when(F.col("event_id") % 6 == 0, F.lit("1,200")).when(F.col("event_id") % 6 == 1, F.concat((F.col("event_id") % 97).cast("string"), F.lit("%"))).when(F.col("event_id") % 6 == 2, F.lit("abc%")).when(F.col("event_id") % 6 == 3, F.lit("true")).when(F.col("event_id") % 6 == 4, F.lit("nan")).otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", X.to_number(raw).alias("number"))


NUMBER_SQL = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1200.0 WHEN 1 THEN (event_id % 97) / 100 WHEN 3 THEN 1.0 WHEN 5 THEN user_id::DOUBLE END::DOUBLE AS number FROM events"""


def labels_with_ids(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    uri = X.uris_of_ids(F.concat_ws(", ", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")), "http://x/compound/")
    label = X.label_with_ids(F.col("s_name"), F.transform(uri, X.id_of_uri))
    return s.select("s_suppkey", label.alias("label"), F.array_join(X.ids_of_label(label), "|").alias("ids"))


LABEL_SQL = """SELECT s_suppkey, s_name || ' [CID:' || s_suppkey || ', ' || s_nationkey || ']' AS label, s_suppkey || '|' || s_nationkey AS ids FROM supplier"""


def prompts(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select("item_id", F.md5(X.escaped_braces(X.rendered("Item {id}: {{text}} {text}", id=F.col("item_id"), text=F.col("text")))).alias("prompt"))


PROMPT_SQL = "SELECT item_id, md5(replace(replace('Item ' || item_id || ': {' || text || '} ' || text, '{', '{{'), '}', '}}')) AS prompt FROM benchmark"


def chunks(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    each = docs.select("doc_id", F.posexplode(X.token_chunks(S.tokens(F.col("text")), 68)).alias("n", "c"))
    return each.select("doc_id", "n", F.size("c").alias("tokens"), F.md5(F.array_join("c", " ")).alias("hash"))


CHUNK_SQL = r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS ts FROM documents),
c AS (SELECT doc_id, n::INT AS n, ts[n * 64 + 1 : n * 64 + 64] AS c FROM t, unnest(range((len(ts) - 1) // 64 + 1)) AS u(n) WHERE len(ts) > 0)
SELECT doc_id, n, len(c)::INT AS tokens, md5(array_to_string(c, ' ')) AS hash FROM c"""


def _next_parts(spark, d, most):
    """Each part with those of the next keys; a bounded number of pairs for each."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    q = p.select(F.col("p_partkey").alias("other"), F.col("p_name").alias("name2"))
    return p.withColumn("other", F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + most))).join(q, "other")


def jaccard(spark, d):
    return _next_parts(spark, d, 6).select("p_partkey", "other", S.token_jaccard(F.lower("p_name"), F.lower("name2")).alias("score"))


JACCARD_SQL = r"""WITH p AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda x: x <> '')) AS ts FROM part)
SELECT a.p_partkey, b.p_partkey AS other, CASE WHEN len(a.ts) + len(b.ts) = 0 THEN 1.0 ELSE len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts))) END::DOUBLE AS score
FROM p a JOIN p b ON b.p_partkey BETWEEN a.p_partkey + 1 AND a.p_partkey + 6"""


def edit_ratios(spark, d):
    return _next_parts(spark, d, 3).select("p_partkey", "other", F.round(S.edit_ratio("p_name", "name2"), 6).alias("ratio"), F.round(S.token_set_ratio(F.col("p_name"), F.col("name2")), 6).alias("set_ratio"))


def rouge(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    pairs = b.join(b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("before")), "item_id")
    one, two = S.rouge(F.col("text"), F.col("before"), 1), S.rouge(F.col("text"), F.col("before"), 2)
    return pairs.select("item_id", F.round(one.precision, 9).alias("p1"), F.round(one.recall, 9).alias("r1"), F.round(one.f1, 9).alias("f1"), F.round(two.f1, 9).alias("f2"))


ROUGE_SQL = r"""WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ts FROM benchmark),
g AS (SELECT item_id, n, list_transform(range(1, len(ts) - n + 2), lambda i: array_to_string(ts[i : i + n - 1], ' ')) AS gs FROM t, (VALUES (1), (2)) v(n)),
c AS (SELECT item_id, n, w, count(*) AS k FROM (SELECT item_id, n, unnest(gs) AS w FROM g) GROUP BY ALL),
h AS (SELECT a.item_id, a.n, sum(least(a.k, b.k)) AS hit FROM c a JOIN c b ON b.item_id = a.item_id - 1 AND a.n = b.n AND a.w = b.w GROUP BY ALL),
s AS (SELECT a.item_id, a.n, coalesce(hit, 0) AS hit, len(a.gs) AS la, len(b.gs) AS lb FROM g a JOIN g b ON b.item_id = a.item_id - 1 AND a.n = b.n LEFT JOIN h ON h.item_id = a.item_id AND h.n = a.n),
r AS (SELECT item_id, n, coalesce(hit / nullif(la, 0), 0) AS p, coalesce(hit / nullif(lb, 0), 0) AS r FROM s)
SELECT item_id, round(max(p) FILTER (n = 1), 9)::DOUBLE AS p1, round(max(r) FILTER (n = 1), 9)::DOUBLE AS r1, round(coalesce(max(2 * p * r / nullif(p + r, 0)) FILTER (n = 1), 0), 9)::DOUBLE AS f1,
round(coalesce(max(2 * p * r / nullif(p + r, 0)) FILTER (n = 2), 0), 9)::DOUBLE AS f2 FROM r GROUP BY item_id"""


def vector_cosine(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


COSINE_SQL = "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def bleu(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    pairs = b.join(b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("before")), "item_id")
    return S.bleu(pairs, "text", "before", 2).select(F.round("bleu", 9).alias("bleu"))


BLEU_SQL = r"""WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ts FROM benchmark),
g AS (SELECT item_id, n, list_transform(range(1, len(ts) - n + 2), lambda i: array_to_string(ts[i : i + n - 1], ' ')) AS gs FROM t, (VALUES (1), (2)) v(n)),
c AS (SELECT item_id, n, w, count(*) AS k FROM (SELECT item_id, n, unnest(gs) AS w FROM g) GROUP BY ALL),
h AS (SELECT a.n, sum(least(a.k, b.k)) AS hit FROM c a JOIN c b ON b.item_id = a.item_id - 1 AND a.n = b.n AND a.w = b.w GROUP BY ALL),
s AS (SELECT a.n, sum(len(a.gs)) AS tot, sum(len(b.gs)) AS ref FROM g a JOIN g b ON b.item_id = a.item_id - 1 AND a.n = b.n GROUP BY ALL),
m AS (SELECT exp(avg(ln(coalesce(hit, 0) / tot))) AS mean FROM s LEFT JOIN h USING (n) WHERE coalesce(hit, 0) > 0 HAVING count(*) = 2)
SELECT round(coalesce((SELECT mean FROM m), 0) * least(1.0, exp(1 - ref / tot)), 9)::DOUBLE AS bleu FROM s WHERE n = 1"""


def alignment(spark, d):
    """Sixteen vectors are a pair: those with even numbers are predicted, the others the reference."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 16).alias("pair"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    got = S.alignment(e.where("idx % 2 = 0"), e.where("idx % 2 = 1"))
    return got.select("pair", *[F.round(c, 7).alias(c) for c in ("precision", "recall", "f1")])


ALIGN_SQL = """WITH s AS (SELECT a.vec_id // 16 AS pair, a.vec_id AS p, b.vec_id AS r, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a JOIN embeddings b ON a.vec_id // 16 = b.vec_id // 16 WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
p AS (SELECT pair, avg(m) AS precision FROM (SELECT pair, p, max(x) AS m FROM s GROUP BY ALL) GROUP BY ALL), r AS (SELECT pair, avg(m) AS recall FROM (SELECT pair, r, max(x) AS m FROM s GROUP BY ALL) GROUP BY ALL)
SELECT pair, round(precision, 7) AS precision, round(recall, 7) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 7) AS f1 FROM p JOIN r USING (pair)"""


def unicode_keys(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.length(X.unicode_form(F.col("text"), "NFKD")).cast("long").alias("n_decomposed"), F.md5(X.lenient(F.col("text"))).alias("lenient"))


QUERIES = {
    "text_normal_forms": (normal_forms, NORMAL_SQL),
    "text_numbers": (numbers, NUMBER_SQL),
    "text_labels_with_ids": (labels_with_ids, LABEL_SQL),
    "text_prompts": (prompts, PROMPT_SQL),
    "text_chunks": (chunks, CHUNK_SQL),
    "text_unicode": (unicode_keys, None),
    "sim_token_jaccard": (jaccard, JACCARD_SQL),
    "sim_edit_ratio": (edit_ratios, None),
    "sim_bleu": (bleu, BLEU_SQL),
    "sim_alignment": (alignment, ALIGN_SQL),
    "sim_rouge": (rouge, ROUGE_SQL),
    "sim_cosine": (vector_cosine, COSINE_SQL),
}
