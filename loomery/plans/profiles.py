"""Queries on evaluation by identifiers, statistics over corpora, choosing and small readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import similarity as S
from loomery.functions import text as X
from loomery.operators import choose, evaluate, idmatch, judge, link, matching, metrics, nested, stats
from loomery.plans import records
from loomery.plans.scoring import _RATES, _SIDES, _SUMS
from loomery.sources import corpora, kb, sinks


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _named(spark, d):
    """Lines with their part's name: gold in capitals, predicted with double blanks."""
    lines = _table(spark, d, "lineitem").join(_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return lines.where("l_returnflag = 'R'").withColumn("p_name", F.upper("p_name")), lines.where("l_discount >= 0.05").withColumn("p_name", F.replace("p_name", F.lit(" "), F.lit("  ")))


def normalised_match(spark, d):
    gold, predicted = _named(spark, d)
    return metrics.micro(matching.set_counts(gold, predicted, ["l_orderkey"], ["p_name", "l_linestatus"], form=X.lenient))


NORMALISED_SQL = f"""WITH {_SIDES}, n AS (SELECT l_orderkey, l_linestatus, lower(p_name) AS name, l_returnflag = 'R' AS ing, l_discount >= 0.05 AS inp FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT l_orderkey, l_linestatus, name, bool_or(ing) AS ing, bool_or(inp) AS inp FROM n WHERE ing OR inp GROUP BY ALL),
c AS (SELECT l_orderkey, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (inp AND NOT ing) AS fp, count(*) FILTER (ing AND NOT inp) AS fn FROM k GROUP BY ALL HAVING count(*) FILTER (ing) > 0 AND count(*) FILTER (inp) > 0),
s AS (SELECT {_SUMS} FROM c) SELECT *, {_RATES} FROM s"""


def id_evaluation(spark, d):
    """Suppliers stand for identifiers, known by the names of two parts; open lines are matched greedily, others by coverage."""
    gold, predicted = _named(spark, d)
    side = lambda df, n, *more: df.select("l_orderkey", F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias(n), *more)
    gold = side(gold, "g", F.col("p_name").alias("text"))
    predicted = side(predicted, "p", F.array(F.col("l_suppkey").cast("string")).alias("ids"), F.when(F.col("l_quantity") < 3, F.col("p_name")).alias("value"))
    part = _table(spark, d, "part")
    known = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("formula"), F.array("p_type").alias("synonyms"))
    return idmatch.by_ids(gold, predicted, known, ["l_orderkey"], {"O": "greedy", "F": "coverage"}, percent=None)


_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
ID_SQL = f"""WITH RECURSIVE g AS (SELECT l_orderkey, l_linestatus AS category, l_linenumber AS g, {_KEY.format('p_name')} AS key FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'),
p AS (SELECT l_orderkey, l_linestatus AS category, l_linenumber AS p, l_suppkey, CASE WHEN l_quantity < 3 THEN {_KEY.format('p_name')} END AS own FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount >= 0.05),
n AS (SELECT p_partkey AS id, {_KEY.format('p_name')} AS key FROM part UNION SELECT p_partkey, {_KEY.format('p_brand')} FROM part UNION SELECT p_partkey, {_KEY.format('p_type')} FROM part),
m AS MATERIALIZED (SELECT p.l_orderkey, category, p, g FROM p JOIN n ON n.id = l_suppkey JOIN g USING (l_orderkey, category, key) UNION SELECT p.l_orderkey, p.category, p, g FROM p JOIN g ON g.l_orderkey = p.l_orderkey AND g.category = p.category AND g.key = own),
q AS MATERIALIZED (SELECT l_orderkey, list(g ORDER BY g) AS gs, row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS k FROM m WHERE category = 'O' GROUP BY l_orderkey, p),
r AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS k, []::INT[] AS used FROM q UNION ALL SELECT r.l_orderkey, r.k + 1, CASE WHEN len(list_filter(gs, lambda x: NOT list_contains(used, x))) > 0 THEN list_append(used, list_filter(gs, lambda x: NOT list_contains(used, x))[1]) ELSE used END FROM r JOIN q ON q.l_orderkey = r.l_orderkey AND q.k = r.k + 1),
h AS (SELECT l_orderkey, 'O' AS category, max(len(used)) AS tp, max(len(used)) AS w FROM r GROUP BY 1
  UNION ALL SELECT l_orderkey, 'F', count(*), count(DISTINCT p) FROM (SELECT l_orderkey, g, min(p) AS p FROM m WHERE category = 'F' GROUP BY ALL) GROUP BY 1),
a AS (SELECT l_orderkey, category, count(*) AS n FROM g WHERE category IN ('O', 'F') GROUP BY ALL), b AS (SELECT l_orderkey, category, count(*) AS n FROM p WHERE category = 'O' OR (category = 'F' AND (l_orderkey, category) IN (SELECT l_orderkey, category FROM a)) GROUP BY ALL),
c AS (SELECT category, coalesce(tp, 0) AS tp, coalesce(b.n, 0) - coalesce(w, 0) AS fp, coalesce(a.n, 0) - coalesce(tp, 0) AS fn FROM a FULL JOIN b USING (l_orderkey, category) LEFT JOIN h USING (l_orderkey, category)),
s AS (SELECT coalesce(category, 'overall') AS category, {_SUMS} FROM c GROUP BY ROLLUP (category)) SELECT *, {_RATES} FROM s"""


def expert_comparison(spark, d):
    lines = _table(spark, d, "lineitem").withColumn("nth", F.col("l_linenumber"))
    side = lambda df, n: df.select("l_orderkey", F.col("l_linenumber").alias(n), "l_quantity")
    leaves = lambda df, n: df.select("l_orderkey", F.col("l_linenumber").alias(n), F.explode(F.array(*[F.struct(F.lit(c).alias("path"), (F.col(f"l_{c}") % 3).cast("string").alias("value")) for c in ("partkey", "suppkey")])).alias("x")).select("l_orderkey", n, F.lit(0).alias("nth"), "x.*")
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    gold, predicted = one.where("l_returnflag = 'R'"), one.where("l_discount >= 0.05")
    scored = side(gold, "g").withColumnRenamed("l_quantity", "a").join(side(predicted, "p"), "l_orderkey").select("l_orderkey", "g", "p", (1 - F.abs(F.col("a") - F.col("l_quantity")) / 50).alias("score"))
    return evaluate.expert_comparison(scored, leaves(gold, "g"), leaves(predicted, "p"), ["l_orderkey"])


EXPERT_SQL = """WITH o AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag, l_discount) = 1),
b AS (SELECT g.l_partkey % 3 AS g1, g.l_suppkey % 3 AS g2, p.l_partkey % 3 AS p1, p.l_suppkey % 3 AS p2 FROM o g JOIN o p USING (l_orderkey) WHERE g.l_returnflag = 'R' AND p.l_discount >= 0.05 AND 1 - abs(g.l_quantity - p.l_quantity) / 50 > 0
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, p.l_linenumber ORDER BY 1 - abs(g.l_quantity - p.l_quantity) / 50 DESC, g.l_linenumber) = 1),
r AS (SELECT g1 AS ref, p1 AS pred FROM b UNION ALL SELECT g2, p2 FROM b),
l AS (SELECT label, count(*) FILTER (ref = label AND pred = label) AS tp, count(*) FILTER (pred = label AND ref <> label) AS fp, count(*) FILTER (ref = label AND pred <> label) AS fn, count(*) FILTER (ref = label) AS n FROM r, (SELECT ref AS label FROM r UNION SELECT pred FROM r) GROUP BY label),
x AS (SELECT tp, n, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS q, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f FROM l)
SELECT sum(tp) / sum(n) AS accuracy, sum(p * n) / sum(n) AS precision, sum(q * n) / sum(n) AS recall, sum(f * n) / sum(n) AS f1 FROM x"""


def field_evaluation_by(spark, d):
    lines = _table(spark, d, "lineitem")
    cols = ["l_orderkey", "l_returnflag", "l_partkey", "l_suppkey"]
    return evaluate.field_scores(lines.where("l_tax <= 0.02").select(*cols), lines.where("l_discount >= 0.05").select(*cols), ["l_orderkey", "l_returnflag"], ["l_partkey", "l_suppkey"], by="l_returnflag")


FIELD_BY_SQL = f"""WITH r AS (SELECT l_returnflag, f.field, CASE f.field WHEN 'l_partkey' THEN g.l_partkey ELSE g.l_suppkey END AS a, CASE f.field WHEN 'l_partkey' THEN p.l_partkey ELSE p.l_suppkey END AS b
  FROM lineitem g JOIN lineitem p USING (l_orderkey, l_returnflag), (VALUES ('l_partkey'), ('l_suppkey')) f(field) WHERE g.l_tax <= 0.02 AND p.l_discount >= 0.05),
s AS (SELECT coalesce(l_returnflag, 'all') AS l_returnflag, coalesce(field, 'overall') AS field, count(*) FILTER (a = b) AS tp, count(*) FILTER (a <> b) AS fp, count(*) FILTER (a <> b) AS fn FROM r GROUP BY CUBE (l_returnflag, field))
SELECT *, {_RATES} FROM s"""


def extraction_statistics(spark, d):
    leaves = nested.flatten(records._orders(spark, d), "record", "o_orderkey")
    n = stats.coverage_per_record(leaves, "o_orderkey")
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("model"))
    return stats.extraction_statistics(orders.join(n, "o_orderkey"), "model", "o_custkey", "n")


EXTRACT_SQL = f"""WITH {records._LEAVES}, e AS (SELECT o_orderkey, count(*) FILTER (value IS NOT NULL AND value NOT IN ('', 'Not Found')) AS n FROM l GROUP BY ALL),
p AS (SELECT o_orderpriority AS model, o_custkey, count(*) AS k, sum(n) AS n FROM orders JOIN e USING (o_orderkey) GROUP BY ALL)
SELECT model, sum(k)::BIGINT AS processes, round(avg(k), 2) AS mean_by_paper, max(k) AS most_in_paper, round(sum(n) / sum(k), 2) AS mean_properties FROM p GROUP BY model"""


def property_frequency(spark, d):
    leaves = nested.flatten(records._orders(spark, d), "record", "o_orderkey").where("value is not null").withColumn("path", F.regexp_replace("path", r"\[\d+\]", "[]"))
    return stats.property_frequency(leaves, only=["lines", "customer"], skip=["note"])


FREQUENCY_SQL = f"""WITH {records._LEAVES} SELECT regexp_replace(path, '\\[\\d+\\]', '[]') AS path, count(*) AS n FROM l WHERE value IS NOT NULL AND (path LIKE '%lines%' OR path LIKE '%customer%') AND path NOT LIKE '%note%' GROUP BY 1"""


def relation_statistics(spark, d):
    n = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    docs = _table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderstatus").alias("variant"), F.coalesce("n", F.lit(0)).alias("n"))
    return stats.relation_statistics(docs, "variant", "n", ["F", "O", "P", "none"])


RELATION_SQL = """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderstatus AS variant, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
SELECT v.variant, coalesce(sum(n), 0)::BIGINT AS total, coalesce(round(avg(n), 2), 0)::DOUBLE AS mean, coalesce(min(n), 0)::BIGINT AS least, coalesce(max(n), 0)::BIGINT AS most FROM (VALUES ('F'), ('O'), ('P'), ('none')) v(variant) LEFT JOIN o USING (variant) GROUP BY 1"""


def dataset_profile(spark, d):
    return stats.dataset_profile(_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_orderkey", "l_partkey", F.col("l_discount") > 0.05)


PROFILE_SQL = """SELECT l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS l_linestatus, count(DISTINCT l_orderkey) AS docs, count(*) AS mentions, count(DISTINCT l_partkey) AS ids, round(avg((l_discount > 0.05)::INT), 6) AS novel
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))"""


def ids_in_text(spark, d):
    return stats.ids_in_text(_table(spark, d, "pages"), F.col("html"), r"track\(([0-9]+)\)", 1)


def _linked(spark, d):
    """Values with ids at two paths: a brand's suppliers, none where the size is large; a type's sizes."""
    p = _table(spark, d, "part")
    brand = p.select(F.lit("brand").alias("path"), F.col("p_brand").alias("value"), F.when(F.col("p_size") < 40, F.array(F.col("p_size").cast("string"))).otherwise(F.array().cast("array<string>")).alias("ids"))
    return brand.unionByName(p.select(F.lit("type").alias("path"), F.col("p_type").alias("value"), F.array((F.col("p_size") % 7).cast("string"), (F.col("p_size") % 5).cast("string")).alias("ids")))


_LINKED = """v AS (SELECT 'brand' AS path, p_brand AS value, CASE WHEN p_size < 40 THEN [p_size::VARCHAR] ELSE []::VARCHAR[] END AS ids FROM part UNION ALL SELECT 'type', p_type, [(p_size % 7)::VARCHAR, (p_size % 5)::VARCHAR] FROM part)"""


def merged_ids(spark, d):
    return stats.merged_ids(_linked(spark, d), "path", "value").withColumn("ids", F.array_join("ids", ","))


def linking_statistics(spark, d):
    return stats.linking_statistics(_linked(spark, d))


def linking_table(spark, d):
    return stats.linking_table(_linked(spark, d), ["brand", "type"])


TABLE_SQL = f"""WITH {_LINKED}, m AS (SELECT path, value, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT path, value, unnest(ids) AS id FROM v) GROUP BY ALL),
a AS (SELECT DISTINCT path, value FROM v), n AS (SELECT path, value, coalesce(ids, '') AS ids, row_number() OVER (PARTITION BY path ORDER BY value) AS nth FROM a LEFT JOIN m USING (path, value))
SELECT nth::INT AS nth, coalesce(max(value) FILTER (path = 'brand'), '') AS brand, coalesce(max(ids) FILTER (path = 'brand'), '') AS brand_ids, coalesce(max(value) FILTER (path = 'type'), '') AS type, coalesce(max(ids) FILTER (path = 'type'), '') AS type_ids FROM n GROUP BY nth"""


def similarity_matrix(spark, d):
    first = _table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min_by("text", F.struct("turn", "text")).alias("text"))
    shown = stats.similarity_matrix(first, "conv_id", "role", "text", S.token_jaccard, ["assistant", "system", "user"])
    return shown.select("role", *[F.round(c, 9).alias(c) for c in ("assistant", "system", "user")])


MATRIX_SQL = r"""WITH f AS (SELECT conv_id, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1),
t AS (SELECT conv_id, role, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS ts FROM f),
s AS (SELECT a.role AS m, b.role AS o, avg(CASE WHEN len(a.ts) + len(b.ts) = 0 THEN 1.0 ELSE len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts))) END) AS s FROM t a JOIN t b USING (conv_id) WHERE a.role <> b.role GROUP BY ALL UNION ALL SELECT DISTINCT role, role, 1.0 FROM t)
SELECT m AS role, round(max(s) FILTER (o = 'assistant'), 9) AS assistant, round(max(s) FILTER (o = 'system'), 9) AS system, round(max(s) FILTER (o = 'user'), 9) AS user FROM s GROUP BY m"""


def lookup(spark, d):
    """Brands in lower case, in part or with something behind, against all brands."""
    p = _table(spark, d, "part")
    k = F.col("p_size") % 3
    asked = p.select(F.when(k == 0, F.lower("p_brand")).when(k == 1, F.substring("p_brand", 4, 10)).otherwise(F.concat("p_brand", F.lit(" x"))).alias("mention")).unionByName(p.select(F.col("p_type").alias("mention")))
    return link.lookup(asked, _brands(spark, d))


def _brands(spark, d):
    return _table(spark, d, "part").select(F.col("p_brand").alias("synonym"), F.col("p_size").cast("string").alias("id")).unionByName(_table(spark, d, "part").select(F.col("p_type").alias("synonym"), F.lit("t").alias("id"))).distinct()


_BRANDS = """k AS (SELECT DISTINCT p_brand AS synonym, p_size::VARCHAR AS id FROM part UNION SELECT DISTINCT p_type, 't' FROM part)"""
LOOKUP_SQL = f"""WITH {_BRANDS}, m AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN lower(p_brand) WHEN 1 THEN substr(p_brand, 4, 10) ELSE p_brand || ' x' END AS mention FROM part UNION SELECT p_type FROM part),
e AS (SELECT mention, synonym, id FROM m JOIN k ON mention = synonym)
SELECT * FROM e UNION ALL SELECT mention, synonym, id FROM m JOIN k ON contains(lower(synonym), lower(mention)) OR contains(lower(mention), lower(synonym)) WHERE mention NOT IN (SELECT mention FROM e)"""


def by_formula(spark, d):
    brands = _brands(spark, d)
    p = _table(spark, d, "part")
    formulas = p.select(F.col("p_name").alias("mention"), F.when(F.col("p_size") > 5, F.col("p_brand")).otherwise("").alias("formula"))
    found = link.by_formula(p.select(F.col("p_name").alias("mention")), formulas, lambda m: link.exact(m, brands))
    return found.select("mention", F.array_join("ids", ",").alias("ids"))


def synonym_of_id(spark, d):
    return link.synonym_of_id(_table(spark, d, "part").select(F.col("p_size").cast("string").alias("id")), _brands(spark, d))


def holding_both(spark, d):
    e = _table(spark, d, "events").select("user_id", F.col("event_type").alias("path"), F.get_json_object("props", "$.k").alias("id"))
    return choose.holding_both(e, ["user_id"], ("click", "9"), ("error", "7"))


def where_number(spark, d):
    leaves = choose.where_given(_table(spark, d, "events"), event_type="click", props=None).select("user_id", F.lit("k").alias("path"), F.get_json_object("props", "$.k").alias("value"))
    return choose.where_number(leaves, "k", 8.0, "user_id")


def chunk_cosine(spark, d):
    e = _table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    pairs = e.join(nxt, "vec_id").select((F.col("vec_id") / 4).cast("long").alias("pair"), F.col("embedding").alias("a"), "b")
    return S.chunk_cosine(pairs).select("pair", F.round("score", 9).alias("score"))


def rouge_l(spark, d):
    b = _table(spark, d, "benchmark")
    pairs = b.join(b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("before")), "item_id")
    return pairs.select("item_id", S.rouge_l(F.col("text"), F.col("before")).alias("r")).select("item_id", F.round("r.precision", 9).alias("precision"), F.round("r.recall", 9).alias("recall"), F.round("r.f1", 9).alias("f1"))


def escapes(spark, d):
    p = _table(spark, d, "part")
    return p.select("p_partkey", X.unescaped(F.concat("p_name", F.lit(r" \u00e9\u4e2d"), F.lit("!"))).alias("text"))


def _fields(spark, d):
    """Fields as extraction leaves them: a bare text, a linked one, a list."""
    p, k = _table(spark, d, "part"), F.col("p_partkey") % 3
    uri = F.concat(F.lit("http://x/compound/"), F.col("p_size").cast("string"))
    linked = F.to_json(F.struct(F.col("p_name").alias("value"), F.array(uri).alias("sameAs")))
    listed = F.concat(F.lit('["'), F.col("p_name"), F.lit('",{"text":"'), F.col("p_type"), F.lit('"},'), F.col("p_size").cast("string"), F.lit("]"))
    return p.select("p_partkey", F.try_parse_json(F.when(k == 0, F.to_json(F.struct(F.col("p_name").alias("x"))).substr(F.lit(6), F.length("p_name") + 2)).when(k == 1, linked).otherwise(listed)).alias("v"))


def fields(spark, d):
    v = F.col("v")
    return _fields(spark, d).where("p_partkey % 3 < 2").select("p_partkey", nested.field_value(v).alias("value"), F.array_join(nested.field_ids(v), ",").alias("ids"))


def entities(spark, d):
    return _fields(spark, d).select("p_partkey", F.array_join(F.transform(nested.entity_list(F.col("v")), lambda x: x.text), "|").alias("texts"))


def variant_items(spark, d):
    return nested.items(_fields(spark, d), "v", "p_partkey").select("p_partkey", F.coalesce(F.try_variant_get("item", "$.text", "string"), F.try_variant_get("item", "$.value", "string")).alias("text"))


def zipped(spark, d):
    got = nested.zipped(records._orders(spark, d), "record", ["customer.priority", "lines[0].part"], "o_orderkey")
    return got.select("o_orderkey", F.array_join("values", "|").alias("both"))


def numbered(spark, d):
    lines = _table(spark, d, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lines.select("l_orderkey", stats.numbered(lines, F.col("l_orderkey"), order, F.col("l_returnflag")).alias("key"))


def first_of(spark, d):
    return sinks.first_of(_table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def item_numbers(spark, d):
    return nested.numbered_items(_table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("words")), "words", "p_partkey")


def pubtator(spark, d):
    """Documents written as marked-up blocks with a mention and a relation, and read again."""
    docs = _table(spark, d, "documents").where("text is not null")
    line = F.regexp_replace("text", r"[\r\n\t|]+", " ")
    i = F.col("doc_id").cast("string")
    block = F.concat(i, F.lit("|t|"), F.substring(line, 1, 30), F.lit("\n"), i, F.lit("|a|"), line, F.lit("\n"), i, F.lit("\t3\t8\t"), F.substring(line, 4, 5), F.lit("\tChemical\tD1\n"), i, F.lit("\tCID\tD1\tD2"))
    got = corpora.parse_pubtator(docs.select(block.alias("value")))
    e, r = F.get("entities", F.lit(0)), F.get("relations", F.lit(0))
    return got.select("doc_id", F.md5("text").alias("hash"), e.offset.alias("offset"), e.length.alias("length"), e.identifier.alias("identifier"), r.disease.alias("disease"))


PUBTATOR_SQL = r"""WITH l AS (SELECT doc_id, regexp_replace(text, '[\r\n\t|]+', ' ', 'g') AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS doc_id, md5(substr(line, 1, 30) || chr(10) || line) AS hash, 3 AS "offset", 5 AS length, 'D1' AS identifier, 'D2' AS disease FROM l"""


def sentence_texts(spark, d):
    c = _table(spark, d, "conversations")
    return corpora.document_text(c, "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("hash"))


def parallel_rows(spark, d):
    """A brand's parts as parallel arrays, in order of their numbers."""
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type")))
    docs = _table(spark, d, "part").groupBy("p_brand").agg(listed.alias("x")).select(F.col("x.p_name").alias("text"), F.col("x.p_type").alias("label"))
    return corpora.positions(docs, "text", "label").groupBy("idx", "text", "label").agg(F.count("*").alias("n"))


def synonym_dictionary(spark, d):
    """JSON objects of names and comma-joined ids."""
    p = _table(spark, d, "part")
    text = F.concat(F.lit('{"'), F.col("p_name"), F.lit('": "'), F.col("p_partkey").cast("string"), F.lit(" , "), F.col("p_size").cast("string"), F.lit('"}'))
    return p.select(F.explode(kb.curated(text)).alias("x")).select("x.*").groupBy("synonym").agg(F.count("*").alias("n"))


def same_as_edges(spark, d):
    return sinks.same_as(_linked(spark, d).where("path = 'brand'"), F.col("value")).distinct()


def flat_export(spark, d):
    leaves = nested.flatten(records._orders(spark, d), "record", "o_orderkey").where("value is not null")
    leaves = leaves.withColumn("nth", F.coalesce(F.regexp_extract("path", r"\[(\d+)\]", 1).try_cast("int"), F.lit(0))).withColumn("path", F.replace(F.regexp_replace("path", r"\.?\[\d+\]", ""), F.lit("."), F.lit("_")))
    orders = _table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("status"))
    return sinks.flat_export(leaves.join(orders, "o_orderkey"), ["o_orderkey", "status"], ["status", "lines_part"]).withColumnRenamed("process.status", "process_status")


EXPORT_SQL = f"""WITH {records._LEAVES}, k AS (SELECT o_orderkey, regexp_replace(path, '\\.?\\[\\d+\\]', '') AS p, coalesce(try_cast(regexp_extract(path, '\\[(\\d+)\\]', 1) AS INT), 0) AS i, value FROM l WHERE value IS NOT NULL)
SELECT o_orderkey, o_orderpriority AS status, coalesce(string_agg(value, '; ' ORDER BY i) FILTER (p = 'status'), '') AS process_status, coalesce(string_agg(value, '; ' ORDER BY i) FILTER (p = 'lines.part'), '') AS lines_part
FROM k JOIN orders USING (o_orderkey) WHERE p IN ('status', 'lines.part') GROUP BY ALL"""


def union_distinct(spark, d):
    return _table(spark, d, "part").select(F.col("p_size").alias("key")).union(_table(spark, d, "supplier").select("s_nationkey")).distinct()


def positional(spark, d):
    """An order's gold and predicted lines as documents that have nothing but their place in common."""
    lines = _table(spark, d, "lineitem")
    side = lambda df: df.groupBy(F.col("l_orderkey").alias("idx")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("kind"))).alias("items"))
    return evaluate.positional_corpus(side(lines.where("l_returnflag = 'R'")), side(lines.where("l_discount >= 0.05")), "items", ["part", "kind"])


POSITIONAL_SQL = f"""WITH {_SIDES}, k AS (SELECT l_orderkey, l_partkey, l_linestatus, bool_or(l_returnflag = 'R') AS ing, bool_or(l_discount >= 0.05) AS inp FROM lineitem WHERE l_returnflag = 'R' OR l_discount >= 0.05 GROUP BY ALL),
c AS (SELECT l_orderkey, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (inp AND NOT ing) AS fp, count(*) FILTER (ing AND NOT inp) AS fn FROM k GROUP BY ALL HAVING bool_or(ing) AND bool_or(inp)), s AS (SELECT {_SUMS} FROM c) SELECT *, {_RATES} FROM s"""


def matched_by(spark, d):
    """Pairs by functions of the caller: a predicted field's identifiers are its key and brand, gold has a brand."""
    part = _table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = _table(spark, d, "lineitem").join(part, "l_partkey")
    gold = lines.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("g"), F.col("p_brand").alias("field"))
    predicted = lines.where("l_discount >= 0.05").select("l_orderkey", F.col("l_linenumber").alias("p"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.lower("p_brand")).alias("field"))
    return matching.matches_by(gold, predicted, ["l_orderkey"], lambda f: F.split(f, "/"), lambda i, f: i == F.lower(f))


def property_texts(spark, d):
    leaves = nested.flatten(records._orders(spark, d), "record", "o_orderkey").withColumn("path", F.regexp_replace("path", r"\[\d+\]", "[]"))
    return stats.property_statistics(leaves, "o_orderkey", skip=["status"], list_most=100).select("path", "distinct_texts", F.array_join("texts", "|").alias("texts"))


TEXTS_SQL = f"""WITH {records._LEAVES}, k AS (SELECT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END AS t FROM l WHERE value IS NOT NULL AND value NOT IN ('', 'Not Found') AND path NOT LIKE '%status%')
SELECT path, count(DISTINCT t) AS distinct_texts, coalesce(string_agg(DISTINCT t, '|' ORDER BY t), '') AS texts FROM k GROUP BY path"""


def rebuilt(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.struct(F.col("o_orderpriority").alias("p")).alias("in"), F.col("o_custkey").alias("key")).alias("customer")).alias("r"))
    return nested.rebuild(nested.flatten(o, "r", "o_orderkey"), "o_orderkey", texts=True).withColumn("record", F.to_json("record"))


def empty_quantities(spark, d):
    """Parts as quantities: without a number where the size is odd, with a note where it is above 40."""
    size = F.col("p_size")
    number = F.struct(F.when(size % 2 == 0, size.cast("double")).alias("numericValue"), F.struct(F.col("p_type").alias("hasQuantityKind")).alias("unit"))
    made = _table(spark, d, "part").select("p_partkey", F.struct(F.when(size > 5, number).alias("quantityValue"), F.lit("kind").alias("quantityKind"), F.when(size > 40, F.lit("note")).alias("note")).alias("q"))
    return made.select("p_partkey", nested.is_empty_quantity(F.col("q"), made.schema["q"].dataType).alias("empty"))


def critics(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("evaluator"))
    return judge.critics(n, _table(spark, d, "region").select(F.col("r_regionkey").alias("idx"), F.col("r_name").alias("critic")))


def macro_scores(spark, d):
    labels = _table(spark, d, "labels")
    return metrics.macro(labels.withColumns({"quality": F.col("quality").cast("double"), "toxic": F.col("toxic").cast("double")}), ["quality", "toxic"]).select(F.round("quality", 9).alias("quality"), F.round("toxic", 9).alias("toxic"))


_KIND = "p_partkey % 3"
QUERIES = {
    "score_normalised_match": (normalised_match, NORMALISED_SQL),
    "score_id_evaluation": (id_evaluation, ID_SQL),
    "score_expert_comparison": (expert_comparison, EXPERT_SQL),
    "score_field_evaluation_by_group": (field_evaluation_by, FIELD_BY_SQL),
    "stat_extraction": (extraction_statistics, EXTRACT_SQL),
    "stat_property_frequency": (property_frequency, FREQUENCY_SQL),
    "stat_relations": (relation_statistics, RELATION_SQL),
    "stat_dataset_profile": (dataset_profile, PROFILE_SQL),
    "stat_ids_in_text": (ids_in_text, r"SELECT DISTINCT unnest(regexp_extract_all(html, 'track\(([0-9]+)\)', 1)) AS id FROM pages"),
    "stat_merged_ids": (merged_ids, f"WITH {_LINKED}, x AS (SELECT path, value, unnest(ids) AS id FROM v) SELECT path, value, coalesce(string_agg(DISTINCT id, ',' ORDER BY id), '') AS ids FROM (SELECT DISTINCT path, value FROM v) LEFT JOIN x USING (path, value) GROUP BY ALL"),
    "stat_linking": (linking_statistics, f"WITH {_LINKED} SELECT coalesce(path, 'overall') AS path, count(*) FILTER (len(ids) > 0) AS linked, count(*) FILTER (len(ids) = 0) AS unlinked, count(DISTINCT value) AS texts, count(DISTINCT ids[1]) AS ids FROM v GROUP BY ROLLUP (path)"),
    "stat_linking_table": (linking_table, TABLE_SQL),
    "stat_similarity_matrix": (similarity_matrix, MATRIX_SQL),
    "link_lookup": (lookup, LOOKUP_SQL),
    "link_by_formula": (by_formula, f"WITH {_BRANDS} SELECT p_name AS mention, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM part JOIN k ON p_brand = synonym WHERE p_size > 5 GROUP BY 1"),
    "link_synonym_of_id": (synonym_of_id, f"WITH {_BRANDS} SELECT id, min(synonym) AS synonym FROM k WHERE id IN (SELECT p_size::VARCHAR FROM part) GROUP BY 1"),
    "filter_holding_both": (holding_both, "SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'click' AND json_extract_string(props, '$.k') = '9') AND bool_or(event_type = 'error' AND json_extract_string(props, '$.k') = '7')"),
    "filter_number": (where_number, "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND try_cast(json_extract_string(props, '$.k') AS DOUBLE) = 8"),
    "sim_chunk_cosine": (chunk_cosine, "SELECT a.vec_id // 4 AS pair, round(avg(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])))), 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1"),
    "sim_rouge_l": (rouge_l, None),
    "text_escapes": (escapes, "SELECT p_partkey, p_name || ' é中!' AS text FROM part"),
    "text_linked_fields": (fields, f"SELECT p_partkey, p_name AS value, CASE WHEN {_KIND} = 1 THEN p_size::VARCHAR ELSE '' END AS ids FROM part WHERE {_KIND} < 2"),
    "nest_entity_list": (entities, f"SELECT p_partkey, CASE WHEN {_KIND} = 2 THEN p_name || '|' || p_type || '|' || p_size ELSE '' END AS texts FROM part"),
    "nest_items": (variant_items, f"SELECT p_partkey, CASE {_KIND} WHEN 1 THEN p_name ELSE p_type END AS text FROM part WHERE {_KIND} > 0"),
    "nest_zipped": (zipped, f"WITH {records._LEAVES} SELECT o_orderkey, priority || '|' || l_partkey AS both FROM o JOIN n ON l_orderkey = o_orderkey WHERE i = 0 AND priority IS NOT NULL"),
    "nest_numbered_items": (item_numbers, "SELECT p_partkey, i::INT AS n, w[i] AS item FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part), unnest(range(1, len(w) + 1)) u(i)"),
    "stat_numbered": (numbered, "SELECT l_orderkey, CASE WHEN n = 1 THEN l_returnflag ELSE l_returnflag || '_' || n END AS key FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)"),
    "sink_first_of": (first_of, "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"),
    "sink_same_as": (same_as_edges, f"WITH {_LINKED} SELECT DISTINCT sha256(value) AS subject, 'brand.sameAs' AS predicate, unnest(ids) AS object, 'iri' AS datatype FROM v WHERE path = 'brand'"),
    "sink_flat_export": (flat_export, EXPORT_SQL),
    "source_pubtator": (pubtator, PUBTATOR_SQL),
    "source_sentence_texts": (sentence_texts, "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn, text)) AS hash FROM conversations GROUP BY 1"),
    "source_parallel_rows": (parallel_rows, "WITH p AS (SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx, p_name AS text, p_type AS label FROM part) SELECT idx::INT AS idx, text, label, count(*) AS n FROM p GROUP BY ALL"),
    "source_synonym_dictionary": (synonym_dictionary, "SELECT p_name AS synonym, count(*) AS n FROM (SELECT p_name, p_partkey AS id FROM part UNION ALL SELECT p_name, p_size FROM part) GROUP BY 1"),
    "score_positional": (positional, POSITIONAL_SQL),
    "score_matches_by_functions": (matched_by, f"WITH l AS (SELECT l_orderkey, l_linenumber, p_brand, l_returnflag, l_discount FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT DISTINCT a.l_orderkey, b.l_linenumber AS p, a.l_linenumber AS g FROM l a JOIN l b USING (l_orderkey, p_brand) WHERE a.l_returnflag = 'R' AND b.l_discount >= 0.05"),
    "score_macro": (macro_scores, "SELECT round(avg(quality), 9) AS quality, round(avg(toxic), 9) AS toxic FROM labels"),
    "nest_property_texts": (property_texts, TEXTS_SQL),
    "nest_rebuild": (rebuilt, """SELECT o_orderkey, '{"customer":{"in":{"p":"' || o_orderpriority || '"},"key":"' || o_custkey || '"},"status":"' || o_orderstatus || '"}' AS record FROM orders"""),
    "nest_empty_quantities": (empty_quantities, "SELECT p_partkey, p_size <= 40 AND (p_size <= 5 OR p_size % 2 = 1) AS empty FROM part"),
    "judge_critics": (critics, "SELECT n_nationkey AS idx, n_name AS evaluator, r_name AS critic FROM nation JOIN region ON r_regionkey = n_nationkey % 5"),
    "set_union": (union_distinct, "SELECT p_size AS key FROM part UNION SELECT s_nationkey FROM supplier"),
}
