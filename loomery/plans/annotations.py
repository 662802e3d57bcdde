"""Queries on annotated documents: graphs of tokens, BioC trees, typed relations, spans; shapes of records and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import link, matching, nested, validate
from loomery.sources import corpora, sinks


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_NOTES = "array<struct<text:string,infons:struct<identifier:string,type:string>,locations:array<struct<offset:int,length:int>>>>"


def bioc(spark, d):
    """Documents written as BioC trees, the later passage first and one mention twice, and read again."""
    docs = _table(spark, d, "documents")
    name, body, size = (F.coalesce(c, F.lit("")) for c in (F.col("source"), F.col("text"), F.col("n_chars").cast("string")))
    i = F.col("doc_id").cast("string")
    note = lambda text, identifier, at: F.struct(text.alias("text"), F.struct(identifier.alias("identifier"), F.lit("Chemical").alias("type")).alias("infons"), F.array(F.struct(F.lit(at).alias("offset"), F.lit(3).alias("length"))).alias("locations"))
    notes = F.array(note(name, i, 0), note(F.lit("again"), i, 0), note(name, size, 5))
    passages = F.array(F.struct(F.lit(90).alias("offset"), body.alias("text"), notes.alias("annotations")), F.struct(F.lit(0).alias("offset"), name.alias("text"), F.array().cast(_NOTES).alias("annotations")))
    relation = F.struct(F.struct(F.lit("Bind").alias("type"), i.alias("entity1"), size.alias("entity2"), F.lit("Novel").alias("novel")).alias("infons"))
    tree = F.to_json(F.struct(F.array(F.struct(i.alias("id"), passages.alias("passages"), F.array(relation).alias("relations"))).alias("documents")))
    read = docs.select(F.explode(F.from_json(tree, corpora.BIOC).documents).alias("d")).select("d.*")
    got = corpora.parse_bioc(read)
    listed = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e.identifier, e.offset.cast("string"), e.text)), ",")
    r = F.get("relations", F.lit(0))
    return got.select("doc_id", F.md5("text").alias("hash"), listed.alias("entities"), r.entity2.alias("entity2"), r.novel.alias("novel"))


BIOC_SQL = """WITH d AS (SELECT doc_id::VARCHAR AS doc_id, coalesce(source, '') AS s, coalesce(text, '') AS t, coalesce(n_chars::VARCHAR, '') AS n FROM documents)
SELECT doc_id, md5(s || ' ' || t) AS hash, doc_id || ':0:' || s || ',' || n || ':5:' || s AS entities, n AS entity2, true AS novel FROM d"""


def typed_relations(spark, d):
    """Parts written as blocks of the typed dialect, with one relation each."""
    i = F.col("p_partkey").cast("string")
    block = F.concat(i, F.lit("|t|"), F.col("p_name"), F.lit("\n"), i, F.lit("|a|"), F.col("p_type"), F.lit("\n"), i, F.lit("\tBind\t"), F.col("p_brand"), F.lit("\t"), F.col("p_size").cast("string"), F.when(F.col("p_size") > 25, F.lit("\tNovel")).otherwise(F.lit("\tNo")))
    got = corpora.parse_pubtator(_table(spark, d, "part").select(block.alias("value")), "typed")
    r = F.get("relations", F.lit(0))
    return got.select("doc_id", "text", F.size("entities").alias("n_entities"), r.type.alias("type"), r.entity1.alias("entity1"), r.entity2.alias("entity2"), r.novel.alias("novel"))


TYPED_SQL = "SELECT p_partkey::VARCHAR AS doc_id, p_name || chr(10) || p_type AS text, 0 AS n_entities, 'Bind' AS type, p_brand AS entity1, p_size::VARCHAR AS entity2, p_size > 25 AS novel FROM part"


def graph_entities(spark, d):
    lines = _table(spark, d, "lineitem")
    vertices = lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("text"), F.col("l_returnflag").alias("type"))
    return corpora.graph_entities(vertices, {"R": "returned", "N": "kept"})


GRAPH_ENTITY_SQL = """WITH v AS (SELECT l_orderkey AS doc, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'N' THEN 'kept' END AS category, l_partkey::VARCHAR AS text, l_returnflag AS subtype, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
SELECT doc, category, text, subtype, row_number() OVER (PARTITION BY doc, category ORDER BY pos, text, subtype)::INT AS nth FROM v WHERE category IS NOT NULL"""


def graph_relations(spark, d):
    """Each line of an order points to the next one; the last points nowhere."""
    lines = _table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc")
    vertices = lines.select("doc", F.col("l_linenumber").alias("tokens"), F.col("l_partkey").cast("string").alias("text"), F.col("l_partkey").alias("pos"))
    edges = lines.select("doc", F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("left"), (F.col("l_linenumber") + 1).alias("right"))
    return corpora.graph_relations(edges, vertices)


GRAPH_RELATION_SQL = """WITH v AS (SELECT l_orderkey, l_linenumber, max(l_partkey)::VARCHAR AS text FROM lineitem GROUP BY ALL)
SELECT e.l_orderkey AS doc, l_returnflag AS type, a.text AS source, b.text AS target FROM lineitem e JOIN v a ON a.l_orderkey = e.l_orderkey AND a.l_linenumber = e.l_linenumber JOIN v b ON b.l_orderkey = e.l_orderkey AND b.l_linenumber = e.l_linenumber + 1"""


def spans(spark, d):
    named = corpora.relation_tuple(F.split("p_type", " "), ["first", "second", "third", "fourth"])
    inner = corpora.span_text(F.split("p_name", " "), F.lit(1), F.col("p_size") % 4)
    return _table(spark, d, "part").select("p_partkey", inner.alias("span"), named.alias("of")).select("p_partkey", "span", "of.*")


SPAN_SQL = """WITH w AS (SELECT p_partkey, p_size % 4 AS stop, string_split(p_name, ' ') AS n, string_split(p_type, ' ') AS t FROM part)
SELECT p_partkey, CASE WHEN stop > 1 THEN coalesce(array_to_string(n[2:stop], ' '), '') ELSE '' END AS span, CASE WHEN len(t) > 1 THEN t[1] END AS first, CASE WHEN len(t) > 1 THEN t[2] END AS second, CASE WHEN len(t) > 1 THEN t[3] END AS third, CASE WHEN len(t) > 1 THEN t[4] END AS fourth FROM w"""


def keys_allowed(spark, d):
    return _table(spark, d, "events").select("event_id", validate.only_keys(F.when(F.col("event_type") == "error", F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "code": 1}'))).otherwise(F.col("props")), ["k"]).alias("allowed"))


def wrapped(spark, d):
    """Bare lists of names, and those already under their key."""
    bare = F.concat(F.lit('["'), F.col("p_name"), F.lit('"]'))
    text = F.when(F.col("p_size") > 25, bare).otherwise(F.concat(F.lit('{"items":'), bare, F.lit("}")))
    return _table(spark, d, "part").select("p_partkey", F.get_json_object(validate.wrapped(text, "items"), "$.items[0]").alias("item"))


def token_alignment(spark, d):
    """Four vectors are a pair of two tokens each: those with even numbers are predicted, the others the reference."""
    e = _table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("pair"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    got = matching.token_alignment(e.where("idx % 2 = 0"), e.where("idx % 2 = 1"))
    return got.select("pair", F.round("score", 7).alias("score"))


TOKEN_SQL = """WITH s AS (SELECT a.vec_id // 4 AS pair, a.vec_id AS p, b.vec_id AS g, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a JOIN embeddings b ON a.vec_id // 4 = b.vec_id // 4 WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
c AS (SELECT pair, x FROM s UNION ALL SELECT pair, a.x + b.x FROM s a JOIN s b USING (pair) WHERE a.p < b.p AND a.g <> b.g),
n AS (SELECT vec_id // 4 AS pair, greatest(count(*) FILTER (vec_id % 2 = 0), count(*) FILTER (vec_id % 2 = 1)) AS n FROM embeddings GROUP BY 1)
SELECT pair, round(coalesce(greatest(max(x), 0), 0) / max(n), 7)::DOUBLE AS score FROM n LEFT JOIN c USING (pair) GROUP BY pair"""


def grown_dictionary(spark, d):
    """Brands as a dictionary, grown by the names of large parts that were linked to their size."""
    parts = _table(spark, d, "part")
    size = F.col("p_size").cast("string")
    linked = parts.select(F.col("p_name").alias("mention"), F.when(F.col("p_size") > 25, F.array(size)).otherwise(F.array().cast("array<string>")).alias("ids"))
    return link.grown(parts.select(F.col("p_brand").alias("synonym"), size.alias("id")), linked)


def readable_rows(spark, d):
    """Names as JSON, some cut short: what can be read, and what is rejected."""
    text = F.concat(F.lit('{"n": "'), F.col("s_name"), F.when(F.col("s_nationkey") < 5, F.lit("")).otherwise(F.lit('"}')))
    read, rejected = sinks.parsed_or_rejects(_table(spark, d, "supplier").select("s_suppkey", text.alias("raw")), "raw")
    return read.select("s_suppkey", F.variant_get("v", "$.n", "string").alias("name")).union(rejected.select("s_suppkey", F.lit(None).cast("string")))


def quantities(spark, d):
    """Records of a quantity and a list of quantities, some without a number."""
    value = lambda c: F.struct(F.struct(c.cast("double").alias("numericValue"), F.lit("mm").alias("unit")).alias("quantityValue"))
    odd, large = F.when(F.col("p_size") % 2 == 1, F.col("p_size")), F.when(F.col("p_size") > 25, F.col("p_retailprice"))
    rows = _table(spark, d, "part").select("p_partkey", F.struct(F.col("p_name").alias("name"), value(odd).alias("width"), F.array(value(odd), value(large), value(F.lit(0))).alias("others")).alias("record"))
    pruned = nested.prune_quantities(rows, "record")
    return pruned.select("p_partkey", "record.name", F.col("record.width.quantityValue.numericValue").alias("width"), F.col("record.width").isNull().alias("no_width"), F.size("record.others").alias("others"))


QUERIES = {
    "source_bioc": (bioc, BIOC_SQL),
    "source_pubtator_typed": (typed_relations, TYPED_SQL),
    "source_graph_entities": (graph_entities, GRAPH_ENTITY_SQL),
    "source_graph_relations": (graph_relations, GRAPH_RELATION_SQL),
    "source_spans": (spans, SPAN_SQL),
    "valid_keys_allowed": (keys_allowed, "SELECT event_id, event_type <> 'error' AND len(list_filter(json_keys(props), lambda x: x <> 'k')) = 0 AS allowed FROM events"),
    "valid_wrapped": (wrapped, "SELECT p_partkey, p_name AS item FROM part"),
    "score_token_alignment": (token_alignment, TOKEN_SQL),
    "link_grown": (grown_dictionary, "SELECT p_brand AS synonym, p_size::VARCHAR AS id FROM part UNION SELECT p_name, p_size::VARCHAR FROM part WHERE p_size > 25"),
    "sink_readable_rows": (readable_rows, "SELECT s_suppkey, CASE WHEN s_nationkey >= 5 THEN s_name END AS name FROM supplier"),
    "nest_prune_quantities": (quantities, "SELECT p_partkey, p_name AS name, CASE WHEN p_size % 2 = 1 THEN p_size::DOUBLE END AS width, p_size % 2 = 0 AS no_width, 1 + (p_size % 2 = 1)::INT + (p_size > 25 AND p_retailprice IS NOT NULL)::INT AS others FROM part"),
}
