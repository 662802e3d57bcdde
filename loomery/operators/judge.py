"""Extraction, judging and refinement as batch jobs around a caller's model functions.

A model function maps an iterator of pandas frames to an iterator of pandas frames. Loops are bounded; each round only
sees the rows that are not finished, and is written to the shared folder so that a lost executor repeats no model call of
an earlier round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.sources.ledger import Ledger
from loomery.sources.rounds import settled

ModelFunction = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def extract(docs: DataFrame, model: ModelFunction, prompt: Column, schema: str, tries: int = 3, ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): the model sees ``doc_id`` and ``prompt`` and returns ``doc_id`` and ``reply``; replies that are
    not JSON of the schema are asked for again, up to ``tries`` times in all. A ``ledger`` of (doc_id, attempt) and (reply)
    keeps the replies for later runs."""
    left = docs.select("doc_id", prompt.alias("prompt"))
    records: DataFrame | None = None
    for attempt in range(tries):
        if ledger is None:
            said = left.mapInPandas(model, "doc_id long, reply string")
        else:
            numbered = lambda frames, attempt=attempt: (f.assign(attempt=attempt) for f in model(frames))
            said = ledger.ask(left.withColumn("attempt", F.lit(attempt)), numbered).select("doc_id", "reply")
        replies = settled(left.join(said, "doc_id", "left"))
        parsed = replies.withColumn("record", F.from_json("reply", schema)).withColumn("ok", F.col("record").isNotNull() & F.try_parse_json("reply").isNotNull())
        good = parsed.where("ok").select("doc_id", "record")
        records = good if records is None else records.unionByName(good)
        left = parsed.where("not ok").select("doc_id", "prompt")
    return records, left


def rate(docs: DataFrame, rubrics: DataFrame, judges: list[tuple[str, ModelFunction]], ledger: Ledger | None = None) -> DataFrame:
    """(doc_id, rubric, judge, idx, rating, rationale) by every judge for every enabled rubric; failed ratings left out. A
    judge is called once for a document and rubric: the ratings are written to the shared folder, or to a ``ledger`` of (doc_id,
    rubric, judge) and (rating, rationale), which later runs find again."""
    few = F.array(*[F.struct(F.lit(r.rubric).alias("rubric"), F.lit(r.description).alias("description")) for r in rubrics.where("enabled").collect()])
    asked = docs.withColumn("r", F.explode(few)).select(*docs.columns, "r.*")
    out: DataFrame | None = None
    for idx, (name, model) in enumerate(judges):
        if ledger is None:
            one = settled(asked.mapInPandas(model, "doc_id long, rubric string, rating int, rationale string").where("rating is not null"))
        else:
            named = lambda frames, model=model, name=name: (f.assign(judge=name) for f in model(frames))
            one = ledger.ask(asked.withColumn("judge", F.lit(name)), named)
        one = one.select("doc_id", "rubric", F.lit(name).alias("judge"), F.lit(idx).alias("idx"), "rating", "rationale")
        out = one if out is None else out.unionByName(one)
    return out


def consolidated(ratings: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One rating per (doc_id, rubric): a single one as it is; else the summariser's where there is one; else the highest,
    of equals the first judge's."""
    each = ratings.groupBy("doc_id", "rubric").agg(F.count("*").alias("n"), F.max_by(F.struct("rating", "judge"), F.struct("rating", -F.col("idx"))).alias("top"))
    if summaries is None:
        return each.select("doc_id", "rubric", "n", "top.rating", "top.judge")
    joined = each.join(summaries.select("doc_id", "rubric", F.col("rating").alias("summary")), ["doc_id", "rubric"], "left")
    use = (F.col("n") > 1) & F.col("summary").isNotNull()
    return joined.select("doc_id", "rubric", "n", F.when(use, F.col("summary")).otherwise(F.col("top.rating")).alias("rating"), F.when(use, F.lit("summary")).otherwise(F.col("top.judge")).alias("judge"))


def concluded(rounds: DataFrame, *pair: str, most: int = 3) -> DataFrame:
    """Debates replayed from (pair.., round, rating, satisfied): the round at which each ended, the first in which the
    critic was satisfied or the last of ``most``, and the rating that stood then (the latest that is not null)."""
    kept = rounds.where(F.col("round") <= most)
    stop = kept.groupBy(*pair).agg(F.min(F.when(F.col("satisfied"), F.col("round"))).alias("agreed"), F.max("round").alias("last"))
    stop = stop.select(*pair, F.coalesce("agreed", "last").alias("ended"), F.col("agreed").isNotNull().alias("satisfied"))
    told = kept.where("rating is not null").select(*pair, "round", "rating").join(stop, list(pair)).where(F.col("round") <= F.col("ended"))
    final = told.groupBy(*pair).agg(F.max_by("rating", "round").alias("rating"))
    return stop.join(final, list(pair), "left")


def debate(pairs: DataFrame, critic: ModelFunction, most: int = 3) -> DataFrame:
    """(pair_id, rating, round, satisfied): rounds over the unfinished pairs only. The critic sees pair_id and rating and
    returns pair_id, satisfied and suggested; a missing reply ends the pair as it stands."""
    active = pairs.select("pair_id", "rating")
    out: DataFrame | None = None
    for n in range(1, most + 1):
        said = settled(active.join(active.mapInPandas(critic, "pair_id long, satisfied boolean, suggested int"), "pair_id", "left"))
        over = F.col("satisfied").isNull() | F.col("satisfied") | F.lit(n == most)
        rating = F.when(F.col("satisfied") | F.col("satisfied").isNull(), F.col("rating")).otherwise(F.coalesce("suggested", "rating"))
        done = said.where(over).select("pair_id", rating.alias("rating"), F.lit(n).alias("round"), F.coalesce("satisfied", F.lit(False)).alias("satisfied"))
        out = done if out is None else out.unionByName(done)
        active = said.where(~over).select("pair_id", rating.alias("rating"))
    return out


def refined(scores: DataFrame, enough: float = 4.0, retries: int = 3) -> DataFrame:
    """Refinement replayed from (doc_id, attempt, rating): per document the attempt at which it stopped, the first whose
    mean rating is enough or the last of ``retries`` + 1, and that mean."""
    means = scores.where(F.col("attempt") <= retries).groupBy("doc_id", "attempt").agg(F.avg("rating").alias("mean"))
    first = F.struct(F.when(F.col("mean") >= enough, 0).otherwise(1), F.when(F.col("mean") >= enough, F.col("attempt")).otherwise(-F.col("attempt")))
    return means.groupBy("doc_id").agg(F.min_by("attempt", first).alias("attempt"), F.min_by("mean", first).alias("mean"), F.bool_or(F.col("mean") >= enough).alias("converged"))


def refine(docs: DataFrame, attempt: ModelFunction, enough: float = 4.0, retries: int = 3) -> DataFrame:
    """(doc_id, reply, rating, attempt): ``attempt`` gets doc_id and feedback and returns doc_id, reply, rating, feedback;
    documents below ``enough`` go round again, at most ``retries`` times."""
    active = docs.select("doc_id", F.lit(None).cast("string").alias("feedback"))
    out: DataFrame | None = None
    for n in range(retries + 1):
        got = settled(active.mapInPandas(attempt, "doc_id long, reply string, rating double, feedback string"))
        over = (F.col("rating") >= enough) | F.lit(n == retries)
        done = got.where(over).select("doc_id", "reply", "rating", F.lit(n).alias("attempt"))
        out = done if out is None else out.unionByName(done)
        active = got.where(~F.coalesce(over, F.lit(False))).select("doc_id", "feedback")
    return out


def feedback(ratings: DataFrame, base: Column) -> DataFrame:
    """(doc_id, prompt): the base prompt and the ratings below it, by rubric and judge, braces doubled."""
    from loomery.functions.text import escaped_braces

    line = F.concat(F.lit("- "), "rubric", F.lit(" ("), "judge", F.lit("): "), F.col("rating").cast("string"), F.lit(" "), F.coalesce("rationale", F.lit("")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rubric", "judge", line.alias("line")))), lambda x: x.line), "\n")
    return ratings.groupBy("doc_id").agg(F.concat(base, F.lit("\n"), escaped_braces(text)).alias("prompt"))


def critics(evaluators: DataFrame, critics: DataFrame) -> DataFrame:
    """Evaluators (idx, evaluator) with critics (idx, critic) in turn."""
    n = critics.agg(F.count("*")).first()[0]
    return evaluators.withColumn("c", F.pmod("idx", F.lit(n))).join(critics.withColumnRenamed("idx", "c"), "c").drop("c")


def score_summary(scores: DataFrame, model: str, rating: str) -> DataFrame:
    """Mean and greatest rating by model and, as "overall", of all."""
    rolled = scores.rollup(model).agg(F.avg(rating).alias("mean"), F.max(rating).alias("top"), F.grouping(model).alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "overall").otherwise(F.col(model).cast("string")).alias(model), "mean", "top")


def timings(events: DataFrame, steps: list[str]) -> DataFrame:
    """From (doc, iteration, step, seconds): a column per step and their total."""
    return events.groupBy("doc", "iteration").agg(*[F.sum(F.when(F.col("step") == s, F.col("seconds"))).alias(s) for s in steps], F.sum("seconds").alias("total"))



def finished(records: DataFrame, valid: Callable[[DataFrame], DataFrame], linked: Callable[[DataFrame], DataFrame] | None = None, clean: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Extracted records after the steps in their fixed order: validation, then linking and cleaning where they are given."""
    for step in (valid, linked, clean):
        if step is not None:
            records = records.transform(step)
    return records
