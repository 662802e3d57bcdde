"""Annotated corpora to flat documents: doc_id, text, entities, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_pubtator(spark: SparkSession, path: str, relation: str = "CID") -> DataFrame:
    """Blocks of ``id|t|title``, ``id|a|abstract``, mention lines of 6 tab-separated columns and relation lines. The text
    is title, newline, abstract; entities are sorted by offset. ``relation``: a relation type for ``id type chemical
    disease`` lines of 4 columns, or "typed" for ``id type entity1 entity2 novel`` lines of 5."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.length(F.trim("value")) > 0)
    return parse_pubtator(blocks, relation)


def parse_pubtator(blocks: DataFrame, relation: str = "CID") -> DataFrame:
    """The same from a column ``value`` with one block per row; no shuffle."""
    lines = F.filter(F.split(F.replace("value", F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    parts = lambda kind: F.filter(lines, lambda x: x.rlike(rf"^[^|\t]*\|{kind}\|"))
    body = lambda kind: F.coalesce(F.regexp_extract(F.get(parts(kind), F.lit(0)), rf"^[^|]*\|{kind}\|(.*)$", 1), F.lit(""))
    cells = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("\t"))), lambda x: F.split(x, "\t"))
    number = lambda c, i: F.get(c, F.lit(i)).try_cast("int")
    spans = F.filter(cells, lambda c: (F.size(c) >= 6) & number(c, 1).isNotNull() & number(c, 2).isNotNull())
    entity = lambda c: F.struct(number(c, 1).alias("offset"), (number(c, 2) - number(c, 1)).alias("length"), F.get(c, F.lit(3)).alias("text"), F.get(c, F.lit(4)).alias("type"), F.get(c, F.lit(5)).alias("identifier"))
    if relation == "typed":
        pairs = F.filter(cells, lambda c: (F.size(c) == 5) & number(c, 1).isNull())
        made = F.transform(pairs, lambda c: F.struct(F.get(c, F.lit(1)).alias("type"), F.get(c, F.lit(2)).alias("entity1"), F.get(c, F.lit(3)).alias("entity2"), (F.get(c, F.lit(4)) == "Novel").alias("novel")))
    else:
        pairs = F.filter(cells, lambda c: (F.size(c) >= 4) & (F.get(c, F.lit(1)) == relation))
        made = F.transform(pairs, lambda c: F.struct(F.get(c, F.lit(1)).alias("type"), F.get(c, F.lit(2)).alias("chemical"), F.get(c, F.lit(3)).alias("disease")))
    doc = F.regexp_extract(F.get(lines, F.lit(0)), r"^([^|\t]*)[|\t]", 1)
    return blocks.select(doc.alias("doc_id"), F.concat(body("t"), F.lit("\n"), body("a")).alias("text"), F.array_sort(F.transform(spans, entity)).alias("entities"), made.alias("relations"))


BIOC = """documents array<struct<id:string, passages:array<struct<offset:int, text:string, annotations:array<struct<text:string,
infons:struct<identifier:string,type:string>, locations:array<struct<offset:int,length:int>>>>>>,
relations:array<struct<infons:struct<type:string,entity1:string,entity2:string,novel:string>>>>>"""


def read_bioc(spark: SparkSession, path: str) -> DataFrame:
    """BioC JSON: entities once per (identifier, offset, length), the first standing; passages by offset make the text."""
    docs = spark.read.schema(BIOC).option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")
    return parse_bioc(docs)


def parse_bioc(docs: DataFrame) -> DataFrame:
    each = F.flatten(F.flatten(F.transform("passages", lambda p: F.transform(p.annotations, lambda a: F.transform(a.locations, lambda x: F.struct(a.text.alias("text"), a.infons.type.alias("type"), a.infons.identifier.alias("identifier"), x.offset.alias("offset"), x.length.alias("length")))))))
    # The least place of each (identifier, offset, length), by one sort.
    placed = F.array_sort(F.transform(each, lambda x, i: F.struct(x.identifier.alias("identifier"), x.offset.alias("offset"), x.length.alias("length"), i.alias("nth"))))
    firsts = F.filter(placed, lambda x, i: (i == 0) | ~(x.identifier.eqNullSafe(F.get(placed, i - 1).identifier) & x.offset.eqNullSafe(F.get(placed, i - 1).offset) & x.length.eqNullSafe(F.get(placed, i - 1).length)))
    kept = F.transform(F.array_sort(F.transform(firsts, lambda x: x.nth)), lambda i: F.get(each, i))
    text = F.array_join(F.transform(F.array_sort(F.transform("passages", lambda p: F.struct(p.offset, p.text))), lambda p: p.text), " ")
    relations = F.transform("relations", lambda r: F.struct(r.infons.type.alias("type"), r.infons.entity1.alias("entity1"), r.infons.entity2.alias("entity2"), (r.infons.novel == "Novel").alias("novel")))
    return docs.select(F.col("id").alias("doc_id"), text.alias("text"), kept.alias("entities"), relations.alias("relations"))


def graph_entities(vertices: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(doc, category, text, subtype, nth) from vertices (doc, pos, text, type): routed by type, once per category and
    text, in order of place."""
    route = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv))
    routed = vertices.withColumn("category", route[F.col("type")]).where(F.col("category").isNotNull())
    first = routed.groupBy("doc", "category", F.col("text"), F.col("type").alias("subtype")).agg(F.min("pos").alias("pos"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "category").orderBy("pos", "text", "subtype"))).drop("pos")


def graph_relations(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(doc, type, source, target): ends resolved through token positions, the last vertex of equal positions standing;
    edges with an unresolved end are dropped."""
    at = vertices.groupBy("doc", "tokens").agg(F.max_by("text", "pos").alias("text"))
    left = at.select("doc", F.col("tokens").alias("left"), F.col("text").alias("source"))
    right = at.select("doc", F.col("tokens").alias("right"), F.col("text").alias("target"))
    return edges.join(left, ["doc", "left"]).join(right, ["doc", "right"]).select("doc", "type", "source", "target")


def bio_spans(tokens: DataFrame, *sentence: str) -> DataFrame:
    """(sentence.., kind, start, text) from rows (sentence.., pos, token, label): B- opens, I- of the same kind goes on,
    any other label closes, and an I- without its B- is left out. One window per sentence."""
    order = Window.partitionBy(*sentence).orderBy("pos")
    kind = F.when(F.col("label") != "O", F.substring("label", 3, 100))
    begins = F.startswith(F.col("label"), F.lit("B-"))
    follows = F.startswith(F.col("label"), F.lit("I-"))
    marked = tokens.withColumn("kind", kind).withColumn("breaks", F.when(follows & (F.col("kind") == F.lag("kind").over(order)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("kind is not null")
    spans = runs.groupBy(*sentence, "run", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("ts"), F.max(F.when(begins, 1).otherwise(0)).alias("opened"), F.min("pos").alias("start"))
    return spans.where("opened = 1").select(*sentence, "kind", "start", F.array_join(F.transform("ts", lambda t: t.token), " ").alias("text"))


def span_text(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens [start, end) joined by blanks."""
    return F.array_join(F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0))), " ")


def relation_tuple(relation: Column, names: list[str], least: int = 2) -> Column:
    """A tuple's members by name, those it lacks null; a tuple of fewer than ``least`` is null."""
    return F.when(F.size(relation) >= least, F.struct(*[F.get(relation, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def positions(df: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays to rows with their ``idx``."""
    return df.select(F.posexplode(F.arrays_zip(*arrays)).alias("idx", "x")).select("idx", *[F.col(f"x.{a}").alias(a) for a in arrays])


def document_text(sentences: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Sentences in order, joined by one blank."""
    return sentences.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("text"))
