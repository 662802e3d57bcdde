"""Queries on judging: a conversation's turns are rounds, roles are judges, ratings follow from the texts' lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import judge


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("r"), (F.col("turn") % 2).cast("string")).alias("rubric"), F.coalesce("role", F.lit("none")).alias("judge"), F.col("turn").alias("idx"), (F.length("text") % 5 + 1).alias("rating"), "turn")


_SQL = "r AS (SELECT conv_id AS doc_id, 'r' || (turn % 2) AS rubric, coalesce(role, 'none') AS judge, turn AS idx, length(text) % 5 + 1 AS rating, turn FROM conversations)"


def consolidated(spark, d):
    return judge.consolidated(_ratings(spark, d).where("rating is not null")).select("doc_id", "rubric", "n", "rating")


def concluded(spark, d):
    rounds = _ratings(spark, d).groupBy("doc_id", (F.col("turn") + 1).alias("round")).agg(F.max("rating").alias("rating")).withColumn("satisfied", F.col("rating") >= 5)
    return judge.concluded(rounds, "doc_id")


CONCLUDE_SQL = f"""WITH {_SQL}, x AS (SELECT doc_id, turn + 1 AS round, max(rating) AS rating FROM r GROUP BY ALL HAVING turn + 1 <= 3),
s AS (SELECT doc_id, min(round) FILTER (rating >= 5) AS agreed, max(round) AS last FROM x GROUP BY 1)
SELECT s.doc_id, coalesce(agreed, last) AS ended, agreed IS NOT NULL AS satisfied, max_by(rating, round) FILTER (rating IS NOT NULL AND round <= coalesce(agreed, last)) AS rating FROM s JOIN x USING (doc_id) GROUP BY ALL"""


def refined(spark, d):
    scores = _ratings(spark, d).select("doc_id", F.col("turn").alias("attempt"), "rating")
    return judge.refined(scores).withColumn("mean", F.round("mean", 6))


REFINE_SQL = f"""WITH {_SQL}, m AS (SELECT doc_id, turn AS attempt, avg(rating) AS mean FROM r WHERE turn <= 3 GROUP BY ALL)
SELECT doc_id, coalesce(min(attempt) FILTER (mean >= 4), max(attempt)) AS attempt, round(coalesce(min_by(mean, attempt) FILTER (mean >= 4), max_by(mean, attempt)), 6) AS mean, coalesce(bool_or(mean >= 4), false) AS converged FROM m GROUP BY 1"""


def summary(spark, d):
    return judge.score_summary(_ratings(spark, d), "judge", "rating").withColumn("mean", F.round("mean", 6))


def timings(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("doc"), F.dayofmonth("ts").alias("iteration"), F.col("event_type").alias("step"), F.floor("value").cast("long").alias("seconds"))
    return judge.timings(e, ["click", "view"])


TIME_SQL = "SELECT user_id AS doc, day(ts)::INT AS iteration, sum(floor(value)::BIGINT) FILTER (event_type = 'click')::BIGINT AS click, sum(floor(value)::BIGINT) FILTER (event_type = 'view')::BIGINT AS view, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL"


def feedback(spark, d):
    r = _ratings(spark, d).withColumn("rationale", F.lit("{x}"))
    return judge.feedback(r, F.lit("Again:")).select("doc_id", F.md5("prompt").alias("prompt"))


FEEDBACK_SQL = f"""WITH {_SQL}, t AS (SELECT doc_id, rubric, judge, '- ' || rubric || ' (' || judge || '): ' || rating || ' {{{{x}}}}' AS line FROM r)
SELECT doc_id, md5('Again:' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY rubric, judge, line), '')) AS prompt FROM t GROUP BY 1"""

QUERIES = {
    "judge_consolidated": (consolidated, f"WITH {_SQL} SELECT doc_id, rubric, count(*) AS n, max(rating) AS rating FROM r WHERE rating IS NOT NULL GROUP BY ALL"),
    "judge_concluded": (concluded, CONCLUDE_SQL),
    "judge_refined": (refined, REFINE_SQL),
    "judge_score_summary": (summary, f"WITH {_SQL} SELECT coalesce(judge, 'overall') AS judge, round(avg(rating), 6) AS mean, max(rating) AS top FROM r GROUP BY ROLLUP (judge)"),
    "judge_timings": (timings, TIME_SQL),
    "judge_feedback": (feedback, FEEDBACK_SQL),
}
