"""Queries on jobs around models, feeds, sketches, files written and read again, and on what is chosen or printed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from loomery.functions import text as X
from loomery.operators import choose, idmatch, judge, matching, metrics, sketches, stats, validate
from loomery.plans.profiles import _named, _table
from loomery.plans.records import _LEAVES, _orders
from loomery.plans.scoring import _SIDES, _sides
from loomery.sources import records, sinks
from loomery.sources.ledger import Ledger
from loomery.sources.rounds import passing_folder, settled
from loomery.streaming import feed


def distinct_sketch(spark, d):
    """Sketches by day, written, merged to types of events and held against the exact count."""
    events = _table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = settled(sketches.distinct_sketches(events, ["event_type", "day"], "user_id"))
    found = sketches.merged(daily, "event_type").select("event_type", sketches.estimate("sketch").alias("about"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return exact.join(found, "event_type").select("event_type", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within"))


def _judge(rubric: str):
    """A stand-in for a model: it rates a text by its length, and fails on every seventh."""

    def model(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["text"].str.len()
            yield pd.DataFrame({"doc_id": f["doc_id"], "rubric": f["rubric"], "rating": ((n + len(rubric) + f["rubric"].str.len()) % 5 + 1).where(n % 7 != 0).astype("Int32"), "rationale": f["rubric"]})

    return model


def rated(spark, d):
    """Two judges and two rubrics, the calls kept in a ledger."""
    docs = _table(spark, d, "documents").select("doc_id", "text")
    rubrics = spark.createDataFrame([("clear", "reads well", True), ("complete", "says all", True), ("off", "", False)], "rubric string, description string, enabled boolean")
    ledger = Ledger(spark, passing_folder(spark, "ledger"), "doc_id long, rubric string, judge string", "rating int, rationale string")
    return judge.rate(docs, rubrics, [("first", _judge("a")), ("second", _judge("bc"))], ledger).select("doc_id", "rubric", "judge", "idx", "rating", "rationale")


RATED_SQL = """SELECT doc_id, rubric, judge, idx, ((length(text) + more + length(rubric)) % 5 + 1)::INT AS rating, rubric AS rationale
FROM documents, (VALUES ('clear'), ('complete')) r(rubric), (VALUES ('first', 0, 1), ('second', 1, 2)) j(judge, idx, more) WHERE length(text) % 7 <> 0"""


def _reader(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a model that breaks off every third reply."""
    for f in frames:
        yield pd.DataFrame({"doc_id": f["doc_id"], "reply": [f'{{"size": {len(p)}' + ("" if i % 3 == 0 else "}") for i, p in zip(f["doc_id"], f["prompt"], strict=True)]})


def extracted(spark, d):
    """Records from prompts; what no try could read is told apart."""
    docs = _table(spark, d, "documents").select("doc_id", "text")
    ledger = Ledger(spark, passing_folder(spark, "ledger"), "doc_id long, attempt int", "reply string")
    good, bad = judge.extract(docs, _reader, F.concat(F.lit("Read: "), F.col("text")), "size long", 2, ledger)
    return good.select("doc_id", F.col("record.size").alias("size"), F.lit(True).alias("read")).unionByName(bad.select("doc_id", F.lit(None).cast("long").alias("size"), F.lit(False).alias("read")))


def finished(spark, d):
    """Order records after validation, linking of the part numbers and cleaning, in this order."""
    orders = _orders(spark, d)
    sound = lambda df: df.where(validate.one_of(F.col("record.status"), ["F", "O"]))
    linked = lambda df: df.withColumn("ids", F.transform("record.lines", lambda x: F.concat(F.lit("p"), x.part.cast("string"))))
    clean = lambda df: df.withColumn("ids", F.coalesce(F.array_distinct("ids"), F.array().cast("array<string>")))
    done = judge.finished(orders, sound, linked, clean)
    return done.select("o_orderkey", F.array_join(F.array_sort("ids"), ",").alias("ids"))


FINISHED_SQL = f"WITH {_LEAVES} SELECT o_orderkey, coalesce(string_agg(DISTINCT 'p' || l_partkey, ',' ORDER BY 'p' || l_partkey), '') AS ids FROM o LEFT JOIN n ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1"


def linked_or_raw(spark, d):
    """The linked name where a supplier has one, else the raw one."""
    s, n = _table(spark, d, "supplier"), _table(spark, d, "nation")
    linked = s.join(n.where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return linked.select("s_suppkey", choose.linked_or_raw(F.col("n_name"), F.col("s_name")).alias("name"))


def running_ratings(spark, d):
    """Conversations as a feed, a file to a batch: the running counts of turns and their lengths by role."""
    target, checkpoint = passing_folder(spark, "running"), passing_folder(spark, "feed")
    rows = _table(spark, d, "conversations")
    step = lambda batch: batch.select(F.coalesce("role", F.lit("none")).alias("role"), F.length("text").alias("length"))
    feed.running_counts(spark, f"{d}/conversation[s].parquet", rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), step, ["role"], "length", target, checkpoint, files=1).awaitTermination()
    return feed.running(spark, target)


def of_document(spark, d):
    """Lines of benchmark results, named by folder and item, with the text of their item."""
    b = _table(spark, d, "benchmark")
    runs = b.select(F.explode(F.array(F.lit("one"), F.lit("two"))).alias("model"), F.concat(F.lit("results/"), "model", F.lit("/item-"), F.col("item_id").cast("string"), F.lit(".json")).alias("path"))
    docs = b.where("item_id % 5 <> 0").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("stem"), F.concat(F.lit("docs/"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return records.of_document(runs, docs, "left").select("path", "model", F.md5("text").alias("hash"))


def relation_profile(spark, d):
    """Lines as relations of part, supplier and, but for one status, quantity."""
    lines = _table(spark, d, "lineitem")
    r = lines.select(F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("kind"), "l_orderkey", "l_partkey", "l_suppkey", F.when(F.col("l_quantity") < 25, F.col("l_quantity")).alias("amount"), F.when(F.col("l_discount") > 0.02, 1).alias("more"), "l_tax")
    return stats.relation_profile(r, "split", "kind", "l_orderkey", ["l_partkey", "l_suppkey", "amount", "more"], F.col("l_tax") > 0.04)


RELATION_SQL = """WITH r AS (SELECT l_linestatus AS split, l_returnflag AS kind, l_orderkey, (2 + (l_quantity < 25)::INT + (l_discount > 0.02)::INT)::INT AS arity, (l_tax > 0.04)::INT AS novel FROM lineitem)
SELECT split, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, arity, count(*) AS relations, count(DISTINCT l_orderkey) AS docs, round(avg(novel), 6) AS novel FROM r GROUP BY GROUPING SETS ((split, kind, arity), (split, arity))"""


def similar_ids(spark, d):
    """Evaluation by ids with its similarity branch: gold names lack their third letter, so none is equal to a known one."""
    gold, predicted = _named(spark, d)
    side = lambda df, n, *more: df.select("l_orderkey", F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias(n), *more)
    gold = side(gold, "g", F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("text"))
    predicted = side(predicted, "p", F.array(F.col("l_partkey").cast("string")).alias("ids"), F.lit(None).cast("string").alias("value"))
    known = _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("name"), F.col("p_brand").alias("formula"), F.array("p_brand", "p_name").alias("synonyms"))
    return idmatch.by_ids(gold, predicted, known, ["l_orderkey"], {"O": "greedy", "F": "coverage"}, percent=85)


def extraction_tree(spark, d):
    """Nations as a tree of results, one file each, and one that can't be read; scanned with what the path says."""
    root = passing_folder(spark, "tree")
    nations = _table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("model"), F.when(F.col("n_nationkey") == 7, "{").otherwise(F.to_json(F.struct("n_name"))).alias("value"))
    files = nations.repartitionByRange(25, "n_nationkey").select("value", "model", "n_nationkey")
    files.write.partitionBy("model", "n_nationkey").option("compression", "none").text(f"{root}/raw")
    tree = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(f"{root}/raw").select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("record"))
    return tree.where("record is not null").select(F.regexp_extract("path", "model=([^/]+)", 1).alias("model"), F.try_variant_get("record", "$.n_name", "string").alias("name"))


def written_documents(spark, d):
    """Suppliers as JSON documents below folders by nation, read again as a tree of results."""
    root = passing_folder(spark, "documents")
    s = _table(spark, d, "supplier")
    sinks.write_documents(s.select("s_suppkey", "s_name", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"), F.col("s_nationkey").alias("nation")), root, "nation")
    return spark.read.json(root).groupBy("nation").agg(F.count("*").alias("n"), F.count("balance").alias("balances"), F.min("s_name").alias("first"))


def written_ratings(spark, d):
    """Ratings by line status, written after a look at their shape, and read again."""
    gold, predicted = _sides(spark, d, "l_orderkey", "l_partkey", "l_linestatus")
    found = metrics.micro(matching.set_counts(gold, predicted, ["l_orderkey"], ["l_partkey", "l_linestatus"]))
    path = passing_folder(spark, "ratings")
    sinks.write_ratings(found, path)
    return spark.read.schema("tp long, fp long, fn long").json(path)


def matching_members(spark, d):
    """Of each brand's part names those that hold a word of the brand's first type, in any case."""
    p = _table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"), F.min(F.upper(F.element_at(F.split("p_name", " "), 1))).alias("term"))
    return p.select("p_brand", F.array_join(X.matching(F.col("names"), F.col("term")), "|").alias("found"))


def named_columns(spark, d):
    """The columns of parts that are asked for, without those to skip."""
    p = _table(spark, d, "part")
    return p.select(*choose.names(p.columns, only=["p_size", "p_partkey", "p_brand"], skip=["p_brand"]))


def printable_values(spark, d):
    """An order's status, priority and customer as they are printed."""
    o = _orders(spark, d)
    return o.select("o_orderkey", X.printable(F.col("record.customer.priority")).alias("priority"), X.printable(F.col("record.customer.key")).alias("key"), X.printable(F.col("record.customer"), nested=True).alias("customer"))


QUERIES = {
    "stat_distinct_sketch": (distinct_sketch, "SELECT event_type, count(DISTINCT user_id) AS exact, true AS within FROM events GROUP BY 1"),
    "judge_rated": (rated, RATED_SQL),
    "judge_extracted": (extracted, "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN length(text) + 6 END AS size, doc_id % 3 <> 0 AS read FROM documents"),
    "judge_finished": (finished, FINISHED_SQL),
    "judge_linked_or_raw": (linked_or_raw, "SELECT s_suppkey, coalesce(n_name, s_name) AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3"),
    "stream_running_ratings": (running_ratings, "SELECT coalesce(role, 'none') AS role, count(text) AS n, sum(length(text))::BIGINT AS total, min(length(text)) AS least, max(length(text)) AS most FROM conversations GROUP BY 1"),
    "source_of_document": (of_document, "SELECT 'results/' || model || '/item-' || item_id || '.json' AS path, model, CASE WHEN item_id % 5 <> 0 THEN md5(text) END AS hash FROM benchmark, (VALUES ('one'), ('two')) v(model)"),
    "stat_relation_profile": (relation_profile, RELATION_SQL),
    "score_id_evaluation_similar": (similar_ids, None),
    "source_extraction_tree": (extraction_tree, "SELECT 'r' || n_regionkey AS model, n_name AS name FROM nation WHERE n_nationkey <> 7"),
    "sink_documents": (written_documents, "SELECT s_nationkey AS nation, count(*) AS n, count(*) FILTER (s_acctbal > 0) AS balances, min(s_name) AS first FROM supplier GROUP BY 1"),
    "sink_ratings": (written_ratings, f"WITH {_SIDES}, k AS (SELECT l_orderkey, l_partkey, l_linestatus, bool_or(l_returnflag = 'R') AS ing, bool_or(l_discount >= 0.05) AS inp FROM lineitem WHERE l_returnflag = 'R' OR l_discount >= 0.05 GROUP BY ALL), c AS (SELECT l_orderkey, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (inp AND NOT ing) AS fp, count(*) FILTER (ing AND NOT inp) AS fn FROM k GROUP BY 1 HAVING count(*) FILTER (ing) > 0 AND count(*) FILTER (inp) > 0) SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c"),
    "filter_matching": (matching_members, "WITH p AS (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS names, min(upper(string_split(p_name, ' ')[1])) AS term FROM part GROUP BY 1) SELECT p_brand, array_to_string(list_filter(names, lambda n: contains(lower(n), lower(term))), '|') AS found FROM p"),
    "filter_names": (named_columns, "SELECT p_partkey, p_size FROM part"),
    "nest_printable": (printable_values, f"WITH {_LEAVES} SELECT o_orderkey, coalesce(priority, '') AS priority, o_custkey::VARCHAR AS key, '{{\"key\":' || o_custkey || coalesce(',\"priority\":\"' || priority || '\"', '') || '}}' AS customer FROM o"),
}
