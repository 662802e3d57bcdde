"""Queries on nested records: orders with their lines as JSON, event properties, pages and tagged tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text as X
from loomery.operators import nested, stats, validate
from loomery.sources import corpora, records, sinks


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records: order, status, customer {key, segment}, lines [{part, price, note}]."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    note = F.when(F.col("l_returnflag") == "N", F.lit(X.MISSING)).otherwise(F.col("l_returnflag"))
    each = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), note.alias("note")).alias("line")))), lambda x: x.line).alias("lines"))
    orders = spark.read.parquet(f"{d}/orders.parquet").join(each, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    customer = F.struct(F.col("o_custkey").alias("key"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"))
    return orders.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), customer.alias("customer"), "lines").alias("record"))


_LEAVES = """o AS (SELECT o_orderkey, o_orderstatus, o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority FROM orders),
n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, CASE WHEN l_returnflag = 'N' THEN 'Not Found' ELSE l_returnflag END) - 1 AS i, l_partkey, l_quantity, CASE WHEN l_returnflag = 'N' THEN 'Not Found' ELSE l_returnflag END AS note FROM lineitem),
l AS (SELECT o_orderkey, 'status' AS path, o_orderstatus AS value FROM o UNION ALL SELECT o_orderkey, 'customer.key', o_custkey::VARCHAR FROM o UNION ALL SELECT o_orderkey, 'customer.priority', priority FROM o
UNION ALL SELECT l_orderkey, 'lines.[' || i || '].part', l_partkey::VARCHAR FROM n JOIN o ON o_orderkey = l_orderkey UNION ALL SELECT l_orderkey, 'lines.[' || i || '].quantity', l_quantity::VARCHAR FROM n JOIN o ON o_orderkey = l_orderkey
UNION ALL SELECT l_orderkey, 'lines.[' || i || '].note', note FROM n JOIN o ON o_orderkey = l_orderkey UNION ALL SELECT o_orderkey, 'lines', NULL FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))"""


def flatten(spark, d):
    return nested.flatten(_orders(spark, d), "record", "o_orderkey")


def get_path(spark, d):
    return nested.get_path(_orders(spark, d), "record", "lines[*].part", "o_orderkey")


def set_path(spark, d):
    changed = nested.set_path(_orders(spark, d), "record", "lines[0].note", F.lit("seen"))
    return nested.get_path(changed, "record", "lines[*].note", "o_orderkey")


def prune(spark, d):
    kept = nested.prune_nulls(_orders(spark, d), "record")
    return kept.select("o_orderkey", F.get_json_object(F.to_json("record"), "$.customer.priority").alias("priority"), F.size(F.filter("record.lines", lambda x: x.note.isNotNull())).alias("notes"))


def distinct_values(spark, d):
    return nested.get_path(_orders(spark, d), "record", "customer.priority").select("value").distinct()


def property_statistics(spark, d):
    leaves = nested.flatten(_orders(spark, d), "record", "o_orderkey").withColumn("path", F.regexp_replace("path", r"\[\d+\]", "[]"))
    return stats.property_statistics(leaves, "o_orderkey", skip=["status"])


STATS_SQL = f"""WITH {_LEAVES},
k AS (SELECT o_orderkey, regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path, value FROM l WHERE value IS NOT NULL AND value NOT IN ('', 'Not Found') AND path NOT LIKE '%status%')
SELECT path, count(DISTINCT o_orderkey) AS docs, count(*) AS occurrences, count(DISTINCT CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END) AS distinct_texts, min(try_cast(value AS DOUBLE)) AS least, max(try_cast(value AS DOUBLE)) AS most FROM k GROUP BY path"""


def record_coverage(spark, d):
    leaves = nested.flatten(_orders(spark, d), "record", "o_orderkey")
    n = stats.coverage_per_record(leaves, "o_orderkey")
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


COVER_SQL = f"""WITH {_LEAVES}, c AS (SELECT o_orderkey, count(*) FILTER (value IS NOT NULL AND value NOT IN ('', 'Not Found')) AS n FROM l GROUP BY ALL) SELECT round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM c"""


def wide_table(spark, d):
    leaves = nested.flatten(_orders(spark, d), "record", "o_orderkey")
    leaves = leaves.where("value is not null").withColumn("nth", F.coalesce(F.regexp_extract("path", r"\[(\d+)\]", 1).try_cast("int"), F.lit(0))).withColumn("path", F.regexp_replace("path", r"\.?\[\d+\]", ""))
    return sinks.wide(leaves.withColumn("path", F.replace("path", F.lit("."), F.lit("_"))), ["o_orderkey"], ["customer_key", "customer_priority", "lines_note", "lines_part", "lines_quantity", "status"])


WIDE_SQL = f"""WITH {_LEAVES}, k AS (SELECT o_orderkey, regexp_replace(path, '\\.?\\[\\d+\\]', '') AS p, coalesce(try_cast(regexp_extract(path, '\\[(\\d+)\\]', 1) AS INT), 0) AS i, value FROM l WHERE value IS NOT NULL)
SELECT o_orderkey, {', '.join(f"coalesce(string_agg(value, ', ' ORDER BY i) FILTER (p = '{p}'), '') AS {p.replace('.', '_')}" for p in ('customer.key', 'customer.priority', 'lines.note', 'lines.part', 'lines.quantity', 'status'))} FROM k GROUP BY o_orderkey"""


def event_properties(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.try_parse_json("props").alias("v"))
    return nested.flatten_variant(e, "v", "event_id")


def event_frequency(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.get_json_object("props", "$.k").alias("k")).where("k is not null")
    return stats.document_frequency(e, "user_id", "k")


def event_pivot(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return stats.counts_pivot(e.withColumn("day", F.dayofweek("ts").cast("string")), "event_type", F.col("day"), [str(i) for i in range(1, 8)])


PIVOT_SQL = "SELECT event_type, " + ", ".join(f'count(*) FILTER (dayofweek(ts) = {i - 1}) AS "{i}"' for i in range(1, 8)) + " FROM events GROUP BY event_type"


def linked_triples(spark, d):
    leaves = nested.flatten(_orders(spark, d), "record", "o_orderkey")
    return sinks.triples(leaves, F.col("o_orderkey"))


TRIPLE_SQL = f"""WITH {_LEAVES} SELECT sha256(o_orderkey::VARCHAR) AS subject, path AS predicate, value AS object,
CASE WHEN regexp_full_match(value, '-?\\d+') THEN 'integer' WHEN regexp_full_match(value, '-?\\d+\\.\\d*([eE][+-]?\\d+)?') THEN 'decimal' WHEN value IN ('true', 'false') THEN 'boolean' WHEN value LIKE 'http%://%' THEN 'iri' ELSE 'string' END AS datatype FROM l WHERE value IS NOT NULL"""


def violations(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    rules = {"required": ("shipdate", F.col("l_shipdate").isNotNull()), "enum": ("returnflag", validate.one_of(F.col("l_returnflag"), ["R", "A"])), "range": ("discount", F.col("l_discount") <= 0.08)}
    return validate.violations(lines, "l_orderkey", rules).groupBy("path", "rule").agg(F.count("*").alias("n"))


VIOLATION_SQL = "SELECT * FROM (SELECT 'returnflag' AS path, 'enum' AS rule, count(*) AS n FROM lineitem WHERE coalesce(l_returnflag NOT IN ('R', 'A'), true) UNION ALL SELECT 'discount', 'range', count(*) FROM lineitem WHERE coalesce(l_discount > 0.08, true) UNION ALL SELECT 'shipdate', 'required', count(*) FROM lineitem WHERE l_shipdate IS NULL) WHERE n > 0"


def valid_documents(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return validate.valid(lines, "l_orderkey", {"enum": ("returnflag", validate.one_of(F.col("l_returnflag"), ["R", "A"])), "range": ("discount", F.col("l_discount") <= 0.08)})


#: Orders: two of three statuses, a priority that some lack, lines that some lack, few notes, no more than 45 pieces.
ORDER_SCHEMA = {
    "type": "object",
    "required": ["status", "customer", "lines"],
    "additionalProperties": False,
    "properties": {
        "status": {"type": "string", "enum": ["F", "O"]},
        "customer": {"$ref": "#/$defs/customer"},
        "lines": {"type": "array", "maxItems": 6, "items": {"type": "object", "required": ["part"], "additionalProperties": False, "properties": {"part": {"type": "integer"}, "quantity": {"anyOf": [{"type": "number", "maximum": 45}, {"type": "null"}]}, "note": {"enum": ["A", "R"]}}}},
    },
    "$defs": {"customer": {"type": "object", "required": ["key", "priority"], "properties": {"key": {"type": "integer", "minimum": 10}, "priority": {"type": "string", "pattern": "^[1-3]-"}}, "additionalProperties": {"type": "null"}}},
}


def schema_violations(spark, d):
    return validate.schema_violations(_orders(spark, d).withColumn("record", F.to_json("record")), "o_orderkey", "record", ORDER_SCHEMA)


SCHEMA_SQL = f"""WITH {_LEAVES}, c AS (SELECT l_orderkey, count(*) AS n FROM n GROUP BY 1)
SELECT o_orderkey, 'status' AS path, 'enum' AS rule FROM o WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'customer.priority', 'required' FROM o WHERE priority IS NULL
UNION ALL SELECT o_orderkey, 'customer.priority', 'pattern' FROM o WHERE priority NOT SIMILAR TO '[1-3]-.*'
UNION ALL SELECT o_orderkey, 'customer.key', 'minimum' FROM o WHERE o_custkey < 10
UNION ALL SELECT o_orderkey, 'lines', 'required' FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT o_orderkey, 'lines', 'maxItems' FROM o JOIN c ON l_orderkey = o_orderkey WHERE c.n > 6
UNION ALL SELECT o_orderkey, 'lines[' || i || '].quantity', 'anyOf' FROM o JOIN n ON l_orderkey = o_orderkey WHERE l_quantity > 45
UNION ALL SELECT o_orderkey, 'lines[' || i || '].note', 'enum' FROM o JOIN n ON l_orderkey = o_orderkey WHERE note NOT IN ('A', 'R')"""


def rebuilt(spark, d):
    """Taken apart to leaves and put together again: the same record, lists, numbers and all."""
    orders = _orders(spark, d)
    again = nested.rebuild(nested.leaves(orders, "record", "o_orderkey"), "o_orderkey").join(orders.withColumnRenamed("record", "before"), "o_orderkey")
    parts = F.transform(F.try_variant_get("record", "$.lines", "array<variant>"), lambda x: F.try_variant_get(x, "$.part", "string"))
    return again.select("o_orderkey", (F.to_json("record") == F.to_json(F.parse_json(F.to_json("before")))).alias("same"), F.schema_of_variant(F.try_variant_get("record", "$.customer.key", "variant")).alias("kind"), F.array_join(parts, ",").alias("parts"))


REBUILD_SQL = f"WITH {_LEAVES} SELECT o_orderkey, true AS same, 'BIGINT' AS kind, string_agg(l_partkey::VARCHAR, ',' ORDER BY i) AS parts FROM o LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY o_orderkey"


def page_metadata(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    m = records.path_metadata(F.regexp_replace("url", "[?#].*$", ""))
    return pages.select("page_id", m.alias("m")).select("page_id", "m.model", "m.condition", "m.stem")


PAGE_SQL = """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS s FROM pages)
SELECT page_id, nullif(s[-2], '') AS model, nullif(s[-3], '') AS condition, regexp_replace(s[-1], '\\.[^.]*$', '') AS stem FROM p""".replace("\\\\", "\\")


def page_text(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    made, _ = records.texts_or_rejects(pages, records.html_text(F.col("html")))
    return made.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("hash"))


PAGE_TEXT_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|footer|header|title|br)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\f]+', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g'), ' ' || chr(10)) AS t FROM b)
SELECT page_id, length(t) AS n_chars, md5(t) AS hash FROM c WHERE t <> ''"""


def folder_gold(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    g = records.gold_of_folder(F.replace("p_type", F.lit(" "), F.lit(" - ")), 1)
    return part.select("p_partkey", g.alias("g")).select("p_partkey", "g.*")


FOLDER_SQL = "WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS s FROM part) SELECT p_partkey, coalesce(s[1], '') AS precursor1, coalesce(s[2], '') AS coreactant1, coalesce(s[3], '') AS coreactant2, coalesce(s[4], '') AS coreactant3 FROM p"


def bio_spans(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    tokens = docs.select("doc_id", F.posexplode(F.split("text", "[ \n]+")).alias("pos", "token")).where("token <> ''")
    n = F.length("token")
    label = F.when(n >= 9, F.lit("B-CN")).when(n.between(6, 8), F.lit("I-CN")).when(n == 5, F.lit("B-PV")).when(n == 4, F.lit("I-PV")).otherwise("O")
    return corpora.bio_spans(tokens.withColumn("label", label), "doc_id").select("doc_id", "kind", "start", F.md5("text").alias("hash"))


BIO_SQL = r"""WITH t AS (SELECT doc_id, i - 1 AS pos, ts[i] AS token FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS ts FROM documents), unnest(range(1, len(ts) + 1)) u(i) WHERE ts[i] <> ''),
a AS (SELECT *, CASE WHEN length(token) >= 6 THEN 'CN' WHEN length(token) >= 4 THEN 'PV' END AS kind, length(token) BETWEEN 6 AND 8 OR length(token) = 4 AS inside FROM t),
b AS (SELECT *, CASE WHEN inside AND kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b)
SELECT doc_id, kind, min(pos)::INT AS start, md5(string_agg(token, ' ' ORDER BY pos)) AS hash FROM c WHERE kind IS NOT NULL GROUP BY doc_id, run, kind HAVING bool_or(NOT inside)"""


def remaining(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return sinks.remaining(e, e.where("event_id % 3 = 0"), "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {
    "nest_flatten": (flatten, f"WITH {_LEAVES} SELECT * FROM l"),
    "nest_get_path": (get_path, f"WITH {_LEAVES} SELECT l_orderkey AS o_orderkey, 'lines[' || i || '].part' AS path, l_partkey::VARCHAR AS value FROM n JOIN o ON o_orderkey = l_orderkey"),
    "nest_set_path": (set_path, f"WITH {_LEAVES} SELECT l_orderkey AS o_orderkey, 'lines[' || i || '].note' AS path, CASE WHEN i = 0 THEN 'seen' ELSE note END AS value FROM n JOIN o ON o_orderkey = l_orderkey WHERE i = 0 OR note IS NOT NULL"),
    "nest_prune": (prune, f"WITH {_LEAVES} SELECT o_orderkey, any_value(priority) AS priority, CASE WHEN count(l_orderkey) = 0 THEN NULL ELSE count(*) FILTER (note <> 'Not Found') END::INT AS notes FROM o LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "nest_distinct_values": (distinct_values, f"WITH {_LEAVES} SELECT DISTINCT priority AS value FROM o WHERE priority IS NOT NULL"),
    "nest_property_statistics": (property_statistics, STATS_SQL),
    "nest_record_coverage": (record_coverage, COVER_SQL),
    "nest_wide_table": (wide_table, WIDE_SQL),
    "nest_event_properties": (event_properties, "SELECT event_id, unnest(json_keys(props)) AS path, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events"),
    "stat_document_frequency": (event_frequency, "SELECT json_extract_string(props, '$.k') AS k, count(DISTINCT user_id) AS docs FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1"),
    "stat_pivot": (event_pivot, PIVOT_SQL),
    "sink_triples": (linked_triples, TRIPLE_SQL),
    "sink_remaining": (remaining, "SELECT event_type, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1"),
    "valid_violations": (violations, VIOLATION_SQL),
    "valid_documents": (valid_documents, "SELECT l_orderkey, bool_and(l_returnflag IN ('R', 'A') AND l_discount <= 0.08) AS valid FROM lineitem GROUP BY 1"),
    "valid_schema": (schema_violations, SCHEMA_SQL),
    "nest_rebuild_lists": (rebuilt, REBUILD_SQL),
    "source_page_metadata": (page_metadata, PAGE_SQL),
    "source_page_text": (page_text, PAGE_TEXT_SQL),
    "source_folder_gold": (folder_gold, FOLDER_SQL),
    "source_bio_spans": (bio_spans, BIO_SQL),
}
