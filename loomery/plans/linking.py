"""Queries on linking: the knowledge base is the part names; mentions are names with edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import cluster, link
from loomery.sources import kb as K


def _kb(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("synonym"), F.col("p_partkey").cast("string").alias("id"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names as they are, in lower case, without their third letter, or with something behind; by the key's remainder."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.lower("p_name")).when(k == 2, F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"))).otherwise(F.concat("p_name", F.lit(" of an unknown sort, long")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", name.alias("mention"))


_NAMES = """k AS (SELECT p_name AS synonym, p_partkey::VARCHAR AS id FROM part),
m AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN lower(p_name) WHEN 2 THEN substr(p_name, 1, 2) || substr(p_name, 4) ELSE p_name || ' of an unknown sort, long' END AS mention FROM part)"""


def exact(spark, d):
    found = link.exact(_mentions(spark, d), _kb(spark, d))
    return found.select("mention", F.array_join("ids", ",").alias("ids"))


def cascade(spark, d):
    kb = _kb(spark, d)
    got = link.cascade(_mentions(spark, d), ("exact", lambda m: link.exact(m, kb)), ("fuzzy", lambda m: link.fuzzy(m, kb, 90)))
    return got.select("mention", F.array_join("ids", ",").alias("ids"), "stage")


def best(spark, d):
    return link.best(_mentions(spark, d), _kb(spark, d), 90).withColumn("score", F.round("score", 6))


def two_branches(spark, d):
    m = _mentions(spark, d).withColumn("formula", F.concat(F.lit("Brand#"), (F.col("p_partkey") % 50).cast("string")))
    brands = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("synonym"), F.concat(F.lit("b"), F.col("p_size").cast("string")).alias("id")).distinct()
    return link.two_branches(m, _kb(spark, d), brands).select("mention", F.array_join("ids", ",").alias("ids"))


TWO_SQL = f"""WITH {_NAMES}, u AS (SELECT mention, id FROM m JOIN k ON mention = synonym UNION SELECT mention, 'b' || p_size FROM m JOIN part p ON p.p_brand = 'Brand#' || (m.p_partkey % 50))
SELECT mention, string_agg(id, ',' ORDER BY id) AS ids FROM u GROUP BY 1"""


def synonyms(spark, d):
    lines = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.col("p_partkey").cast("string"), F.lit("\t "), F.col("p_brand")).alias("value"), F.struct("p_partkey").alias("place"))
    return K.parse_synonyms(lines)


def representations(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), "n_name")
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("synonym"))
    return link.representations(n.select("id"), n, s).select("id", "n_name", F.array_join("synonyms", "|").alias("synonyms"))


def corrected(spark, d):
    values = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_brand").alias("value"), F.array("p_size").alias("ids"))
    fixes = spark.read.parquet(f"{d}/part.parquet").where("p_size < 3").groupBy(F.col("p_brand").alias("value")).agg(F.collect_set("p_size").alias("ids"))
    return link.corrected(values, fixes).select("p_partkey", "value", F.array_join("ids", ",").alias("ids"), "touched")


CORRECT_SQL = """WITH f AS (SELECT p_brand AS value, list_distinct(list(p_size)) AS more FROM part WHERE p_size < 3 GROUP BY 1)
SELECT p_partkey, p_brand AS value, array_to_string(list_sort(list_distinct(list_concat([p_size], coalesce(more, [])))), ',') AS ids, more IS NOT NULL AS touched FROM part LEFT JOIN f ON value = p_brand"""


def in_place(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    kb = _kb(spark, d)
    said = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" x")))
    records = parts.select("p_partkey", F.struct(F.struct(said.alias("name")).alias("main"), F.array(F.struct(F.col("p_brand").alias("name"), "p_size")).alias("other")).alias("r"))
    form = lambda ids: F.struct(F.array_join(ids, ",").alias("text"), F.size(ids).alias("n"))
    done = link.in_place(records, "p_partkey", "r", ["main.name", "other[*].name"], lambda m: link.exact(m, kb), form=form)
    return done.select("p_partkey", F.col("r.main.name.value").alias("value"), F.col("r.main.name.sameAs.text").alias("ids"), F.get("r.other.name", F.lit(0)).sameAs.n.alias("others"))


PLACE_SQL = """WITH k AS (SELECT p_name, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS ids FROM part GROUP BY 1)
SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN p_name ELSE p_name || ' x' END AS value, CASE p_partkey % 2 WHEN 0 THEN ids ELSE '' END AS ids, 0 AS others FROM part JOIN k USING (p_name)"""


def clusters(spark, d):
    points = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return cluster.density_clusters(points, eps=0.65)


CLUSTER_SQL = """WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e a, e b WHERE a.id <> b.id AND least(list_cosine_similarity(a.v, b.v), 1.0) >= 1 - 0.65),
c AS MATERIALIZED (SELECT DISTINCT a AS id FROM p), r(id, label) AS (SELECT id, id FROM c UNION SELECT p.b, r.label FROM r JOIN p ON p.a = r.id),
l AS (SELECT id, min(label) AS label FROM r GROUP BY id)
SELECT e.id, coalesce(dense_rank() OVER (ORDER BY l.label NULLS LAST) - 1, -1) AS cluster FROM e JOIN l ON l.id = e.id UNION ALL SELECT id, -1 FROM e WHERE id NOT IN (SELECT id FROM c)"""

QUERIES = {
    "link_exact": (exact, f"WITH {_NAMES} SELECT mention, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT mention FROM m) JOIN k ON mention = synonym GROUP BY 1"),
    "link_cascade": (cascade, None),
    "link_best": (best, None),
    "link_two_branches": (two_branches, TWO_SQL),
    "link_synonyms": (synonyms, "SELECT p_brand AS synonym, max_by(p_partkey, p_partkey)::VARCHAR AS id FROM part GROUP BY 1"),
    "link_representations": (representations, "SELECT n_nationkey AS id, any_value(n_name) AS n_name, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS synonyms FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "link_in_place": (in_place, PLACE_SQL),
    "link_corrected": (corrected, CORRECT_SQL),
    "cluster_density": (clusters, CLUSTER_SQL),
}
