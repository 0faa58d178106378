"""Scores against the answer keys: an extraction run, and the answers to the gold questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolore.functions.vectors import cosine
from chronolore.lineage import cut
from chronolore.operators import models, scoring
from chronolore.operators.acl import literal_grants
from chronolore.plans import ask
from chronolore.sources import runs


def score_run(run: DataFrame, gold: DataFrame, embedder: models.Embedder = models.hashing_embedder, least: float = scoring.MATCH) -> dict[str, DataFrame]:
    """matches, by_type and total (one row) of a run (runs.read_run) against gold facts; each different statement is embedded once."""
    found = runs.accepted(run).withColumn("seq", F.row_number().over(Window.partitionBy("episode_id").orderBy("type", "statement")))
    matches = scoring.best_matches(models.embed(gold, "statement", embedder), models.embed(found, "statement", embedder), least)
    by_type = scoring.recall_by_type(gold, matches)
    issues = run.select(F.size("accepted").alias("ok"), F.explode_outer("rejected").alias("r"))
    quoted = F.size(F.filter(F.coalesce("r.issues", F.array().cast("array<struct<severity:string,field:string,message:string>>")), lambda i: (i["severity"] == "REJECT") & F.startswith(i["field"], F.lit("evidence"))))
    proposed = run.agg(F.coalesce(F.sum(F.size("accepted") + F.size("rejected")), F.lit(0))).first()[0]
    ungrounded = issues.agg(F.coalesce(F.sum(quoted), F.lit(0))).first()[0]
    return {"matches": matches, "by_type": by_type, "total": scoring.extraction_score(by_type, proposed, ungrounded)}


def grade_questions(t: dict[str, DataFrame], questions: DataFrame, embedder: models.Embedder = models.hashing_embedder, chat: models.Chat = ask.extractive_chat, as_of: str | None = None) -> DataFrame:
    """Every gold question asked by a reader of its own grants, and graded: a plan for each set of grants, all its questions in it."""
    spark, answers = questions.sparkSession, []
    asked = questions.select(F.col("id").alias("query_id"), "question", F.array_sort(F.array_distinct("principal")).alias("grants"))
    for r in asked.select("grants").distinct().collect():
        grants = list(r["grants"])
        own = asked.where(F.col("grants") == literal_grants(grants)).select("query_id", "question")
        answers.append(ask.ask_many(t, own, ask.Reader("evaluation", grants), as_of, chat, embedder=embedder).select(F.col("query_id").alias("id"), "answer", "refused", "n_cards"))
    none = spark.createDataFrame([], f"id {questions.schema['id'].dataType.simpleString()}, answer string, refused boolean, n_cards int")
    both = models.embed(models.embed(cut(reduce(DataFrame.unionByName, answers, none)), "answer", embedder, "_a").join(questions.select("id", "expected"), "id"), "expected", embedder, "_e")
    return scoring.grade(questions, both.select("id", "answer", "refused", "n_cards", F.coalesce(cosine(F.col("_a"), F.col("_e")), F.lit(0.0)).alias("similarity")))


def exit_code(graded: DataFrame) -> int:
    """1 if an answer says what it must not, or says it without a source."""
    return int(not graded.where(F.col("verdict").isin("FORBIDDEN", "UNSUPPORTED")).isEmpty())
