"""Queries on scoring: a document is an order; gold and predicted items are lines chosen by predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import evaluate, matching, metrics


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def _sides(spark: SparkSession, d: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    lines = _lines(spark, d)
    return lines.where("l_returnflag = 'R'").select(*columns), lines.where("l_discount >= 0.05").select(*columns)


_SIDES = "g AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT * FROM lineitem WHERE l_discount >= 0.05)"
_RATES = "coalesce(tp / nullif(tp + fp, 0), 0.0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0)::DOUBLE AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)::DOUBLE AS f1"


def _set_sql(group: str, keys: str) -> str:
    on = " AND ".join(f"a.{c.strip()} IS NOT DISTINCT FROM b.{c.strip()}" for c in f"{group}, {keys}".split(","))
    first, one = group.split(",")[0].strip(), keys.split(",")[0].strip()
    using = ", ".join(f"coalesce(a.{c.strip()}, b.{c.strip()}) AS {c.strip()}" for c in group.split(","))
    return f"""{_SIDES},
m AS (SELECT {using}, a.{first} IS NOT NULL AS ing, b.{first} IS NOT NULL AS inp FROM (SELECT DISTINCT {group}, {keys} FROM g) a FULL JOIN (SELECT DISTINCT {group}, {keys} FROM p) b ON {on}),
c AS (SELECT {group}, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (inp AND NOT ing) AS fp, count(*) FILTER (ing AND NOT inp) AS fn FROM m GROUP BY {group}
  HAVING count(*) FILTER (ing) > 0 AND count(*) FILTER (inp) > 0)"""


_SUMS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"


def set_match_micro(spark, d):
    gold, predicted = _sides(spark, d, "l_orderkey", "l_partkey", "l_suppkey")
    return evaluate.flat_corpus(gold, predicted, "l_orderkey", ["l_partkey", "l_suppkey"])


def set_match_by_document(spark, d):
    gold, predicted = _sides(spark, d, "l_orderkey", "l_partkey", "l_suppkey")
    return metrics.prf(matching.set_counts(gold, predicted, ["l_orderkey"], ["l_partkey", "l_suppkey"]))


def set_match_counting_unpredicted(spark, d):
    gold, predicted = _sides(spark, d, "l_orderkey", "l_partkey", "l_suppkey")
    return evaluate.flat_corpus(gold, predicted, "l_orderkey", ["l_partkey", "l_suppkey"], "count")


def set_match_by_category(spark, d):
    gold, predicted = _sides(spark, d, "l_orderkey", "l_linestatus", "l_partkey")
    return metrics.by_category(matching.set_counts(gold, predicted, ["l_orderkey", "l_linestatus"], ["l_partkey"]), "l_linestatus")


def span_match(spark, d):
    gold, predicted = _sides(spark, d, "l_orderkey", "l_linenumber", "l_quantity", "l_linestatus")
    return evaluate.flat_corpus(gold, predicted, "l_orderkey", ["l_linenumber", "l_quantity", "l_linestatus"])


def sentence_evaluation(spark, d):
    gold, predicted = _sides(spark, d, "l_orderkey", "l_linenumber", "l_partkey")
    gold, predicted = (x.withColumn("sentence", F.col("l_linenumber") % 3) for x in (gold, predicted))
    return evaluate.sentence_corpus(gold, predicted, "l_orderkey", "sentence", ["l_partkey"])


def category_evaluation(spark, d):
    gold, predicted = (x.select("l_orderkey", "l_linestatus", F.col("l_partkey").cast("string").alias("text"), F.when(F.col("l_linenumber") > 3, F.col("l_suppkey").cast("string")).alias("subtype")) for x in _sides(spark, d, "*"))
    return evaluate.category_corpus(gold, predicted, "l_orderkey", "l_linestatus", "text", "subtype")


CATEGORY_SQL = f"""WITH {_SIDES},
u AS (SELECT 'g' AS side, l_orderkey, l_linestatus, l_partkey::VARCHAR AS text, CASE WHEN l_linenumber > 3 THEN l_suppkey::VARCHAR END AS subtype FROM g
  UNION ALL SELECT 'p', l_orderkey, l_linestatus, l_partkey::VARCHAR, CASE WHEN l_linenumber > 3 THEN l_suppkey::VARCHAR END FROM p),
t AS (SELECT l_orderkey, l_linestatus, bool_or(subtype IS NOT NULL) AS typed FROM u GROUP BY ALL),
k AS (SELECT DISTINCT side, u.l_orderkey, u.l_linestatus, text, CASE WHEN typed THEN subtype END AS subtype FROM u JOIN t USING (l_orderkey, l_linestatus)),
m AS (SELECT l_orderkey, l_linestatus, text, subtype, bool_or(side = 'g') AS ing, bool_or(side = 'p') AS inp FROM k GROUP BY ALL),
c AS (SELECT l_orderkey, l_linestatus, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (inp AND NOT ing) AS fp, count(*) FILTER (ing AND NOT inp) AS fn FROM m GROUP BY ALL HAVING count(*) FILTER (ing) > 0 AND count(*) FILTER (inp) > 0),
s AS (SELECT coalesce(l_linestatus, 'overall') AS l_linestatus, {_SUMS} FROM c GROUP BY ROLLUP (l_linestatus))
SELECT *, {_RATES} FROM s"""


def weighted_scores(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality is not null and toxic is not null")
    return metrics.weighted(labels, F.col("quality"), 1 - F.col("toxic"))


WEIGHTED_SQL = """WITH r AS (SELECT quality AS ref, 1 - toxic AS pred FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
l AS (SELECT label, count(*) FILTER (ref = label AND pred = label) AS tp, count(*) FILTER (pred = label AND ref <> label) AS fp, count(*) FILTER (ref = label AND pred <> label) AS fn, count(*) FILTER (ref = label) AS n
  FROM r, (SELECT ref AS label FROM r UNION SELECT pred FROM r) GROUP BY label),
x AS (SELECT tp, n, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS q, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f FROM l)
SELECT sum(tp) / sum(n) AS accuracy, sum(p * n) / sum(n) AS precision, sum(q * n) / sum(n) AS recall, sum(f * n) / sum(n) AS f1 FROM x"""


def category_accuracy(spark, d):
    right = (F.col("l_returnflag") == "R") == (F.col("l_discount") >= 0.05)
    return metrics.accuracy(_lines(spark, d).withColumn("status", F.col("l_linestatus")), right, "status")


def field_evaluation(spark, d):
    gold, predicted = _sides(spark, d, "l_orderkey", "l_partkey", "l_suppkey", "l_linestatus")
    return evaluate.field_scores(gold, predicted, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linestatus"])


FIELD_SQL = f"""WITH {_SIDES},
r AS (SELECT f.field, CASE f.field WHEN 'l_partkey' THEN g.l_partkey::VARCHAR WHEN 'l_suppkey' THEN g.l_suppkey::VARCHAR ELSE g.l_linestatus END AS a,
  CASE f.field WHEN 'l_partkey' THEN p.l_partkey::VARCHAR WHEN 'l_suppkey' THEN p.l_suppkey::VARCHAR ELSE p.l_linestatus END AS b
  FROM g JOIN p USING (l_orderkey), (VALUES ('l_partkey'), ('l_suppkey'), ('l_linestatus')) f(field)),
s AS (SELECT coalesce(field, 'overall') AS field, count(*) FILTER (a = b) AS tp, count(*) FILTER (a <> b) AS fp, count(*) FILTER (a <> b) AS fn FROM r GROUP BY ROLLUP (field))
SELECT *, {_RATES} FROM s"""


def _kb(spark, d):
    gold, predicted = _sides(spark, d, "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    gold = gold.select("l_orderkey", F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("gq"))
    predicted = predicted.select("l_orderkey", F.col("l_linenumber").alias("p"), F.col("l_quantity").alias("pq"))
    return gold, predicted, gold.join(predicted, "l_orderkey").where(F.abs(F.col("gq") - F.col("pq")) <= 5).select("l_orderkey", "g", "p")


def greedy_match(spark, d):
    return matching.knowledge_base_counts(*_kb(spark, d), ["l_orderkey"], "greedy")


def coverage_match(spark, d):
    return matching.knowledge_base_counts(*_kb(spark, d), ["l_orderkey"], "coverage")


COVERAGE_SQL = f"""WITH {_SIDES},
m AS (SELECT g.l_orderkey, g.l_linenumber AS g, p.l_linenumber AS p FROM g JOIN p USING (l_orderkey) WHERE abs(g.l_quantity - p.l_quantity) <= 5),
f AS (SELECT l_orderkey, g, min(p) AS p FROM m GROUP BY ALL), h AS (SELECT l_orderkey, count(*) AS tp, count(DISTINCT p) AS w FROM f GROUP BY ALL),
a AS (SELECT l_orderkey, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT l_orderkey, count(*) AS n FROM p GROUP BY ALL)
SELECT l_orderkey, coalesce(tp, 0) AS tp, coalesce(b.n, 0) - coalesce(w, 0) AS fp, coalesce(a.n, 0) - coalesce(tp, 0) AS fn FROM a FULL JOIN b USING (l_orderkey) LEFT JOIN h USING (l_orderkey)"""


GREEDY_SQL = f"""WITH RECURSIVE {_SIDES},
m AS MATERIALIZED (SELECT DISTINCT g.l_orderkey, g.l_linenumber AS g, p.l_linenumber AS p FROM g JOIN p USING (l_orderkey) WHERE abs(g.l_quantity - p.l_quantity) <= 5),
q AS MATERIALIZED (SELECT l_orderkey, list(g ORDER BY g) AS gs, row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS k FROM m GROUP BY l_orderkey, p),
r AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS k, []::INT[] AS used FROM q UNION ALL SELECT r.l_orderkey, r.k + 1, CASE WHEN len(list_filter(gs, lambda x: NOT list_contains(used, x))) > 0 THEN list_append(used, list_filter(gs, lambda x: NOT list_contains(used, x))[1]) ELSE used END FROM r JOIN q ON q.l_orderkey = r.l_orderkey AND q.k = r.k + 1),
h AS (SELECT l_orderkey, max(len(used)) AS tp FROM r GROUP BY 1), a AS (SELECT l_orderkey, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT l_orderkey, count(*) AS n FROM p GROUP BY ALL)
SELECT l_orderkey, coalesce(tp, 0) AS tp, coalesce(b.n, 0) - coalesce(tp, 0) AS fp, coalesce(a.n, 0) - coalesce(tp, 0) AS fn FROM a FULL JOIN b USING (l_orderkey) LEFT JOIN h USING (l_orderkey)"""


def soft_match(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    side = lambda x: x.join(part, x.l_partkey == part.p_partkey).select("l_orderkey", F.col("l_linenumber").alias("id"), F.col("p_name").alias("text"))
    gold, predicted = (side(x) for x in _sides(spark, d, "l_orderkey", "l_linenumber", "l_partkey"))
    return metrics.micro(matching.soft_counts(gold, predicted, ["l_orderkey"]))


def best_gold(spark, d):
    gold, predicted, _ = _kb(spark, d)
    scored = gold.join(predicted, "l_orderkey").select("l_orderkey", "g", "p", (1 - F.abs(F.col("gq") - F.col("pq")) / 50).alias("score"))
    return matching.best_gold(scored, ["l_orderkey"])


BEST_SQL = f"""WITH {_SIDES},
s AS (SELECT l_orderkey, g.l_linenumber AS g, p.l_linenumber AS p, 1 - abs(g.l_quantity - p.l_quantity) / 50 AS score FROM g JOIN p USING (l_orderkey))
SELECT l_orderkey, p, g, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, p ORDER BY score DESC, g) = 1"""


def key_sets(spark, d):
    gold, predicted = (x.select("l_partkey", "l_suppkey").distinct() for x in _sides(spark, d, "l_partkey", "l_suppkey"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(gold.intersect(predicted), "both").union(count(gold.subtract(predicted), "gold")).union(count(predicted.subtract(gold), "predicted"))


KEY_SQL = f"""WITH {_SIDES}, a AS (SELECT DISTINCT l_partkey, l_suppkey FROM g), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM p)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'gold', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'predicted', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""


def id_expansion(spark, d):
    orders = _lines(spark, d).groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_discount") >= 0.05, F.col("l_suppkey"))).alias("b"))
    return metrics.weighted(evaluate.expanded_ids(orders.where("size(a) > 0 and size(b) > 0"), "l_orderkey", "a", "b"), F.col("ref") % 5, F.col("pred") % 5)


EXPAND_SQL = """WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey) FILTER (l_returnflag = 'R'))) AS a, list_sort(list_distinct(list(l_suppkey) FILTER (l_discount >= 0.05))) AS b FROM lineitem GROUP BY ALL),
e AS (SELECT a[(i % len(a)) + 1] % 5 AS ref, b[(i % len(b)) + 1] % 5 AS pred FROM o, unnest(range(greatest(len(a), len(b)))) AS t(i) WHERE len(a) > 0 AND len(b) > 0),
r AS (SELECT * FROM e),
l AS (SELECT label, count(*) FILTER (ref = label AND pred = label) AS tp, count(*) FILTER (pred = label AND ref <> label) AS fp, count(*) FILTER (ref = label AND pred <> label) AS fn, count(*) FILTER (ref = label) AS n
  FROM r, (SELECT ref AS label FROM r UNION SELECT pred FROM r) GROUP BY label),
x AS (SELECT tp, n, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS q, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f FROM l)
SELECT sum(tp) / sum(n) AS accuracy, sum(p * n) / sum(n) AS precision, sum(q * n) / sum(n) AS recall, sum(f * n) / sum(n) AS f1 FROM x"""

def reference_set(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_brand", F.split("p_type", " ")[0].alias("ref"), F.split("p_name", " ")[0].alias("pred"))
    return evaluate.reference_comparison(parts, "p_brand", "ref", "pred", {"STANDARD": "cold", "SMALL": "blue", "PROMO": "red", "LARGE": "hot"})


REFERENCE_SQL = """WITH p AS (SELECT p_brand, string_split(p_type, ' ')[1] AS ref, string_split(p_name, ' ')[1] AS pred FROM part), m AS (SELECT p_brand, CASE ref WHEN 'STANDARD' THEN 'cold' WHEN 'SMALL' THEN 'blue' WHEN 'PROMO' THEN 'red' WHEN 'LARGE' THEN 'hot' ELSE ref END AS ref, pred FROM p)
SELECT coalesce(p_brand, 'overall') AS p_brand, count(*) AS n, avg((ref IS NOT DISTINCT FROM pred)::INT) AS accuracy FROM m GROUP BY ROLLUP (p_brand)"""

_MICRO = f"s AS (SELECT {_SUMS} FROM c) SELECT *, {_RATES} FROM s"
_COUNTED = _set_sql("l_orderkey", "l_partkey, l_suppkey").replace(" AND count(*) FILTER (inp) > 0", "")
QUERIES = {
    "score_set_match_micro": (set_match_micro, f"WITH {_set_sql('l_orderkey', 'l_partkey, l_suppkey')}, {_MICRO}"),
    "score_set_match_by_document": (set_match_by_document, f"WITH {_set_sql('l_orderkey', 'l_partkey, l_suppkey')} SELECT *, {_RATES} FROM c"),
    "score_set_match_counting_unpredicted": (set_match_counting_unpredicted, f"WITH {_COUNTED}, {_MICRO}"),
    "score_set_match_by_category": (set_match_by_category, f"WITH {_set_sql('l_orderkey, l_linestatus', 'l_partkey')}, s AS (SELECT coalesce(l_linestatus, 'overall') AS l_linestatus, {_SUMS} FROM c GROUP BY ROLLUP (l_linestatus)) SELECT *, {_RATES} FROM s"),
    "score_span_match": (span_match, f"WITH {_set_sql('l_orderkey', 'l_linenumber, l_quantity, l_linestatus')}, {_MICRO}"),
    "score_sentence_evaluation": (sentence_evaluation, f"WITH {_set_sql('l_orderkey, sentence', 'l_partkey').replace('SELECT * FROM lineitem', 'SELECT *, l_linenumber % 3 AS sentence FROM lineitem')}, {_MICRO}"),
    "score_category_evaluation": (category_evaluation, CATEGORY_SQL),
    "score_weighted": (weighted_scores, WEIGHTED_SQL),
    "score_category_accuracy": (category_accuracy, "SELECT coalesce(l_linestatus, 'overall') AS status, count(*) AS n, avg(((l_returnflag = 'R') = (l_discount >= 0.05))::INT) AS accuracy FROM lineitem GROUP BY ROLLUP (l_linestatus)"),
    "score_field_evaluation": (field_evaluation, FIELD_SQL),
    "score_greedy_match": (greedy_match, GREEDY_SQL),
    "score_coverage_match": (coverage_match, COVERAGE_SQL),
    "score_soft_match": (soft_match, None),
    "score_best_gold": (best_gold, BEST_SQL),
    "score_reference_set": (reference_set, REFERENCE_SQL),
    "score_key_sets": (key_sets, KEY_SQL),
    "score_id_expansion": (id_expansion, EXPAND_SQL),
}
