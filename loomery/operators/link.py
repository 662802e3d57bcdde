"""Linking mentions to a synonym knowledge base. Mentions are made distinct first; every stage sees only what the stages
before it left over; fuzzy stages compare only candidates that share a block."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.similarity import edit_ratio, token_set_ratio, tokens
from loomery.operators.nested import steps, values_at, with_path
from loomery.operators.skewed import join_apart, split_join
from loomery.sources.rounds import settled


def exact(mentions: DataFrame, kb: DataFrame) -> DataFrame:
    """(mention, ids): case-sensitive equality of ``mention`` and ``synonym``."""
    found = mentions.select("mention").distinct().join(kb, F.col("mention") == F.col("synonym"))
    return found.groupBy("mention").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _spare(length: Column, percent: int) -> Column:
    """The most characters that may be over, on both sides together, between a text of this length and one of any length
    whose edit ratio with it is ``percent`` or more."""
    return F.floor(length * (2 * (100 - percent)) / percent + 1e-9).cast("int")


def _segment(i: Column, length: Column, parts: Column) -> tuple[Column, Column]:
    """Start, from 0, and length of segment i of ``parts``."""
    at = lambda k: F.floor(k * length / parts).cast("int")
    return at(i), at(i + 1) - at(i)


def blocked(mentions: DataFrame, kb: DataFrame, percent: int = 85, form: Callable[[Column], Column] = F.lower) -> DataFrame:
    """Pairs (mention, low, synonym, id) that an edit ratio of ``percent`` or more may join, between a mention and a
    synonym's ``form`` (low). No such pair is lost.

    A synonym with up to d characters over is cut in d + 1 segments. One of them, the i-th, stands whole in the mention, at most
    i places from its own place counted from the left, and at most d - i counted from the right: of the first segments whose
    sum of changes is no more than their number, the last is unchanged. So a mention looks up, for every length that a partner
    can have, its pieces at those places. Pieces that many synonyms share are dealt over several tasks."""
    ends = lambda c: F.length(c).alias("len")
    right = kb.select(form(F.col("synonym")).alias("low")).where("low is not null").distinct().select("low", ends("low"))
    parts = _spare(F.col("len"), percent) + 1
    right = right.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start, size = _segment(F.col("i"), F.col("len"), F.col("parts"))
    right = right.select("low", F.col("len").alias("len2"), "i", F.substring("low", start + 1, size).alias("piece"))

    left = mentions.select("mention").where(F.col("mention").isNotNull()).distinct().select("mention", ends("mention"))
    lowest, highest = F.ceil(F.col("len") * percent / (200 - percent) - 1e-9).cast("int"), F.floor(F.col("len") * (200 - percent) / percent + 1e-9).cast("int")
    left = left.withColumn("len2", F.explode(F.sequence(lowest, highest))).withColumn("d", _spare(F.col("len2"), percent))
    left = left.withColumn("i", F.explode(F.sequence(F.lit(0), "d"))).withColumn("over", F.col("len") - F.col("len2"))
    start, size = _segment(F.col("i"), F.col("len2"), F.col("d") + 1)
    left = left.withColumn("start", start).withColumn("size", size)
    least = F.greatest(-F.col("i"), F.col("over") - (F.col("d") - F.col("i")), -F.col("start"))
    most = F.least(F.col("i"), F.col("over") + (F.col("d") - F.col("i")), F.col("len") - F.col("size") - F.col("start"))
    left = left.where(least <= most).withColumn("shift", F.explode(F.sequence(least, most)))
    left = left.select("mention", "len2", "i", F.substring("mention", F.col("start") + F.col("shift") + 1, F.col("size")).alias("piece")).distinct()

    pairs = split_join(right, left, ["len2", "i", "piece"], F.col("low")).select("mention", "low").distinct()
    return pairs.join(kb.withColumn("low", form(F.col("synonym"))), "low").select("mention", "low", "synonym", "id")


def contained(inner: DataFrame, x: str, outer: DataFrame, y: str, n: int = 3) -> DataFrame:
    """Pairs (x, y) of distinct texts where x, in any case, is part of y. A part's runs of n characters are all in the
    whole, so a part looks only where the rarest of its runs is; parts shorter than n look by themselves."""
    runs = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k) if isinstance(k, int) else k)))
    parts = inner.select(x).where(F.col(x) != "").distinct().withColumn("low", F.lower(x)).withColumn("k", F.least(F.lit(n), F.length("low")))
    parts = parts.select(x, "low", F.explode(runs(F.col("low"), F.col("k"))).alias("g"))
    wholes = outer.select(y).where(F.col(y) != "").distinct().withColumn("whole", F.lower(y))
    every = F.flatten(F.array(*[F.when(F.length("whole") >= k, runs(F.col("whole"), k)).otherwise(F.array().cast("array<string>")) for k in range(1, n + 1)]))
    wholes = wholes.select(y, "whole", F.explode(F.array_distinct(every)).alias("g")).join(parts.select("g").distinct(), "g", "left_semi")
    often = wholes.groupBy("g").agg(F.count("*").alias("f"))
    rarest = parts.join(often, "g", "left").groupBy(x, "low").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g")).alias("r"))
    met = split_join(wholes, rarest.select(x, "low", F.col("r.g").alias("g")), "g", F.col(y))
    return met.where(F.contains("whole", F.col("low"))).select(x, y)


def substring(mentions: DataFrame, kb: DataFrame) -> DataFrame:
    """(mention, synonym, id): a mention is part of the synonym or the synonym of the mention, in any case."""
    pairs = contained(mentions, "mention", kb, "synonym").unionByName(contained(kb, "synonym", mentions, "mention"))
    return pairs.distinct().join(kb, "synonym").select("mention", "synonym", "id")


def lookup(mentions: DataFrame, kb: DataFrame, percent: int | None = None) -> DataFrame:
    """(mention, synonym, id): equal synonyms; for mentions without any, substring hits, with ``percent`` only those of at
    least that edit ratio."""
    asked = mentions.select("mention").where(F.col("mention").isNotNull()).distinct()
    equal = asked.join(kb, F.col("mention") == F.col("synonym")).select("mention", "synonym", "id")
    near = substring(asked.join(equal, "mention", "left_anti"), kb)
    return equal.unionByName(near if percent is None else near.where(edit_ratio("mention", "synonym") >= percent))


def shared_words(mentions: DataFrame, kb: DataFrame, percent: int = 85) -> DataFrame:
    """Pairs (mention, synonym) whose common words may make up ``percent`` of the ratio with either text: they must then
    hold 100 / (200 / percent - 1) percent of its characters, so among the rarest words of one of the two, up to the rest,
    is a common one."""
    words = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct().withColumn("w", F.explode(F.array_distinct(tokens(F.col(c)))))
    left, right = words(mentions, "mention"), words(kb, "synonym")
    often = left.union(right).groupBy("w").agg(F.count("*").alias("f"))
    free = 1 - 1 / (200 / percent - 1)

    def rare(x: DataFrame, c: str) -> DataFrame:
        order = Window.partitionBy(c).orderBy("f", "w")
        before = F.coalesce(F.sum(F.length("w") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum(F.length("w") + 1).over(Window.partitionBy(c))
        return x.join(often, "w").withColumn("before", before).withColumn("total", total).where(F.col("before") <= free * F.col("total") + 1).select(c, "w")

    one, two = split_join(right, rare(left, "mention"), "w", F.col("synonym")), split_join(rare(right, "synonym"), left, "w", F.col("synonym"))
    return one.select("mention", "synonym").union(two.select("mention", "synonym")).distinct()


def _words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(c)))


def reordered(mentions: DataFrame, kb: DataFrame, percent: int = 85) -> DataFrame:
    """Pairs (mention, synonym) that may reach ``percent`` with their common words put first in both and the rest behind,
    in order. Without a common word these are the texts of their sorted words, which ``blocked`` joins. With one, the pair meets at
    that word and at the synonym's length, if the counts of characters, in 16 classes, differ by no more than may be over:
    no order of the words can make up for a character that is missing. Words that many synonyms share are dealt over several
    tasks, and only the first common word of a pair, the rarest, hands it on."""
    text = lambda c: F.array_join(_words(c), " ")
    asked = mentions.select("mention").where(F.size(tokens(F.col("mention"))) > 0).distinct().withColumn("said", text(F.col("mention")))
    known = kb.select("synonym").where(F.size(tokens(F.col("synonym"))) > 0).distinct().withColumn("low", text(F.col("synonym")))
    apart = blocked(asked.select(F.col("said").alias("mention")), kb, percent, form=text).select(F.col("mention").alias("said"), "synonym")

    def sides(df: DataFrame, name: str) -> DataFrame:
        chars = F.split(name, "")
        counts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.size(F.filter(chars, lambda c: (c != "") & (F.pmod(F.ascii(c), F.lit(16)) == k))))
        return df.withColumn("n", F.length(name)).withColumn("counts", counts).withColumn("ws", F.split(name, " "))

    a, b = sides(asked, "said"), sides(known, "low")
    often = b.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("f"))

    def rarest_first(df: DataFrame, key: str) -> DataFrame:
        each = df.select(key, F.explode("ws").alias("w")).join(often, "w").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda x: x.w).alias("ws"))
        return df.drop("ws").join(each, key).withColumn("w", F.explode("ws"))

    lowest, highest = F.ceil(F.col("n") * percent / (200 - percent) - 1e-9).cast("int"), F.floor(F.col("n") * (200 - percent) / percent + 1e-9).cast("int")
    a = rarest_first(a.select("mention", "said", "n", "counts", "ws"), "mention").withColumn("n2", F.explode(F.sequence(lowest, highest)))
    a = a.select("mention", "w", "n2", "n", F.col("counts").alias("counts1"), F.col("ws").alias("ws1"))
    b = rarest_first(b.select("synonym", "low", "n", "counts", "ws"), "synonym").select("synonym", "w", F.col("n").alias("n2"), "counts", "ws")
    over = F.aggregate(F.zip_with("counts", "counts1", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    met = split_join(b, a, ["w", "n2"], F.col("synonym")).where(100 * over <= (100 - percent) * (F.col("n") + F.col("n2")))
    met = met.where(F.get(F.array_intersect("ws1", "ws"), F.lit(0)) == F.col("w")).select("mention", "synonym")
    return asked.join(apart, "said").select("mention", "synonym").union(met).distinct()


def fuzzy(mentions: DataFrame, kb: DataFrame, percent: int = 85) -> DataFrame:
    """(mention, ids): the ids of the first synonym, in order, whose lower-cased form is similar enough to the mention."""
    scored = blocked(mentions, kb, percent).where(edit_ratio("mention", "low") >= percent)
    first = scored.groupBy("mention").agg(F.min("synonym").alias("synonym"))
    return scored.join(first, ["mention", "synonym"]).groupBy("mention").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def best(mentions: DataFrame, kb: DataFrame, percent: int = 85) -> DataFrame:
    """(mention, synonym, score): the synonym that scores best from ``percent`` on, the earliest on ties. A synonym that
    holds the mention, in any case, scores 100, others their edit ratio; below ``percent`` the token-set ratio counts.
    Candidates come from substrings, blocks of edit ratios, shared words and reordered words; no pair that reaches
    ``percent`` is lost."""
    asked = settled(mentions.select("mention").where(F.col("mention") != "").distinct())
    kb = settled(kb.select("synonym").where(F.col("synonym").isNotNull()).distinct()).withColumn("id", F.lit(None).cast("string"))  # ids have no say
    plain = lambda c: c
    pairs = contained(asked, "mention", kb, "synonym").unionByName(blocked(asked, kb, percent, form=plain).select("mention", "synonym"))
    pairs = pairs.unionByName(reordered(asked, kb, percent)).unionByName(shared_words(asked, kb, percent)).distinct()
    first = F.when(F.contains(F.lower("synonym"), F.lower("mention")), 100.0).otherwise(edit_ratio("mention", "synonym"))
    scored = pairs.withColumn("score", first)
    scored = scored.where(F.col("score") >= percent).unionByName(scored.where(F.col("score") < percent).withColumn("score", token_set_ratio(F.col("mention"), F.col("synonym"))))
    pick = F.struct(-F.col("score"), F.col("synonym"))
    return scored.where(F.col("score") >= percent).groupBy("mention").agg(F.min_by("synonym", pick).alias("synonym"), F.max("score").alias("score"))


def by_formula(mentions: DataFrame, formulas: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(mention, ids): mentions looked up again under the ``formula`` that a table (mention, formula) gives for them."""
    said = mentions.select("mention").distinct().join(formulas.select("mention", "formula").where("formula <> ''"), "mention")
    found = stage(said.select(F.col("formula").alias("mention")).distinct())
    return said.join(found.select(F.col("mention").alias("formula"), "ids"), "formula").groupBy("mention").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def synonym_of_id(ids: DataFrame, kb: DataFrame, order: str = "synonym") -> DataFrame:
    """(id, synonym): for each id its first synonym."""
    return ids.select("id").distinct().join(kb, "id").groupBy("id").agg(F.min_by("synonym", order).alias("synonym"))


def cascade(mentions: DataFrame, *stages) -> DataFrame:
    """(mention, ids, stage): each stage, a function of the mentions left, in turn; unlinked mentions get no ids."""
    left = mentions.select("mention").where(F.col("mention").isNotNull()).distinct()
    done: DataFrame | None = None
    for name, stage in stages:
        got = stage(left).where(F.size("ids") > 0).withColumn("stage", F.lit(name))
        done = got if done is None else done.unionByName(got)
        left = left.join(got, "mention", "left_anti")
    rest = left.select("mention", F.array().cast("array<string>").alias("ids"), F.lit("none").alias("stage"))
    kind = dict(done.dtypes)["ids"] if done is not None else "array<string>"
    rest = rest.withColumn("ids", F.col("ids").cast(kind))
    return done.unionByName(rest) if done is not None else rest


def two_branches(mentions: DataFrame, by_name: DataFrame, by_formula: DataFrame) -> DataFrame:
    """(mention, ids): ids found under the name or under the formula, each once. Mentions, mentions with their formula and
    synonyms meet as distinct ones, so copies are not multiplied with each other."""
    by_name, by_formula = (kb.select("synonym", "id").distinct() for kb in (by_name, by_formula))
    name = split_join(by_name.withColumnRenamed("synonym", "mention"), mentions.select("mention").distinct(), "mention", F.col("id")).select("mention", "id")
    formula = mentions.select("mention", "formula").distinct().join(by_formula, F.col("formula") == F.col("synonym")).select("mention", "id")
    return name.union(formula).groupBy("mention").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def grown(kb: DataFrame, linked: DataFrame) -> DataFrame:
    """The dictionary with what this run linked, once per run, so that results do not depend on the order of rows."""
    new = linked.where(F.size("ids") > 0).select(F.col("mention").alias("synonym"), F.explode("ids").alias("id"))
    return kb.select("synonym", "id").union(new).distinct()


def representations(ids: DataFrame, names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Per id its name columns and sorted synonyms."""
    listed = synonyms.groupBy("id").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))
    return ids.select("id").distinct().join(names, "id", "left").join(listed, "id", "left")


def corrected(values: DataFrame, corrections: DataFrame) -> DataFrame:
    """(.., value, ids): ids with those of the correction for the value added, each once, and ``touched``."""
    joined = values.join(corrections.select(F.col("value").alias("of"), F.col("ids").alias("more")), F.col("value") == F.col("of"), "left")
    union = F.array_sort(F.array_union("ids", F.coalesce("more", F.array().cast(dict(values.dtypes)["ids"]))))
    return joined.select(*[c for c in values.columns if c != "ids"], union.alias("ids"), F.col("more").isNotNull().alias("touched"))


SHARE = 5000  # fixed value: records that one task gives the ids of one mention, of which each task gets a copy

#: The paths of process records that name compounds.
COMPOUND_PATHS = (
    "aldSystem.aldMethod[*].compound", "aldSystem.materialDeposited", "reactantSelection.precursor[*].compound", "reactantSelection.precursor[*].precursor", "reactantSelection.coReactant[*].compound",
    "reactantSelection.coReactant[*].coReactant", "reactantSelection.carrierGas", "reactantSelection.purgingGas", "processParameters.substrate",
)


def in_place(df: DataFrame, key: str, col: str, paths: Sequence[str], linker: Callable[[DataFrame], DataFrame], skip: Sequence[str] = (), form: Callable[[Column], Column] | None = None) -> DataFrame:
    """The records with each value at the paths, but those in ``skip``, as {value, sameAs}; unlinked values have no ids. The distinct mentions of
    the whole corpus are linked once, and each record gets only the links of its own mentions back. Paths through lists get
    theirs in a map, by the record's key; a path without a list meets its links by its value, one path after another, so
    that ids that many records share are not gathered by record before they are put in, and records that share a mention with
    many others come in tasks of their own. ``form``: what sameAs holds, made of the ids once for a mention, not in each record."""
    kind = df.schema[col].dataType
    paths = [p for p in paths if p not in set(skip)]
    at = lambda p: F.transform(values_at(F.col(col), kind, steps(p)), lambda x: x.value)
    mentions = df.select(F.explode(F.array_distinct(F.concat(*map(at, paths)))).alias("mention")).distinct()
    links, made = linker(mentions).select("mention", "ids"), form or (lambda ids: ids)
    none = made(F.array().cast(dict(links.dtypes)["ids"]))
    links = settled(links.select("mention", made(F.col("ids")).alias("ids")))
    many = [p for p in paths if None in steps(p)]
    out, rows, temporary = F.col(col), df, []
    if many:
        asked = df.select(key, F.explode(F.array_distinct(F.concat(*map(at, many)))).alias("mention"))
        of_record = split_join(asked, links, "mention", F.col(key)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("mention", "ids"))).alias("__links"))
        rows, temporary = rows.join(of_record, key, "left"), ["__links"]
    for i, p in enumerate(p for p in paths if p not in many):
        rows = rows.withColumn(f"__mention{i}", F.get(at(p), F.lit(0)))
        rows = join_apart(rows, links.select(F.col("mention").alias(f"__mention{i}"), F.col("ids").alias(f"__ids{i}")), f"__mention{i}", f"__ids{i}", F.col(key), SHARE)
        temporary += [f"__mention{i}", f"__ids{i}"]
        out = with_path(out, kind, steps(p), lambda old, i=i: F.struct(old.alias("value"), F.coalesce(F.col(f"__ids{i}"), none).alias("sameAs")))
    for p in many:
        out = with_path(out, kind, steps(p), lambda old: F.struct(old.alias("value"), F.coalesce(F.try_element_at(F.col("__links"), old), none).alias("sameAs")))
    return rows.withColumn(col, out).drop(*temporary).select(*df.columns)
