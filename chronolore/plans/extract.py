"""Extraction as one plan: episodes to prompts, a model's answers to facts, facts repaired and checked, results as a stored run."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolore import schemas
from chronolore.lineage import cut
from chronolore.operators import models, validate
from chronolore.sources import runs
from chronolore.sources.episodes import render


def instructions() -> str:
    """What stands before an episode in its prompt."""
    kinds = "; ".join(f"{kind} (needs {', '.join(f.lower() for f in fields)})" for kind, fields in schemas.REQUIRED_FIELDS.items())
    return f"List the facts of the conversation below, each with word for word quotes and the numbers of the utterances they are from.\nTypes: {kinds}.\nAnswer with JSON of this schema: {json.dumps(schemas.payload_json_schema())}\n\n"


def prompts(episodes: DataFrame, utterances: DataFrame) -> DataFrame:
    """episode_id, occurred_at, prompt."""
    return episodes.select("episode_id", "occurred_at").join(render(episodes, utterances), "episode_id").select("episode_id", "occurred_at", F.concat(F.lit(instructions()), "rendered").alias("prompt"))


def stored_fact() -> Column:
    """An extracted fact as a run stores it."""
    instant, c = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col
    evidence = F.transform("evidence", lambda e: F.struct(e["episode_id"].alias("episodeId"), e["ordinal"].alias("utteranceOrdinal"), e["span"].alias("verbatimSpan")))
    return F.struct(
        "type", "statement", c("owner_mention").alias("ownerMention"), c("participant_mentions").alias("participantMentions"), instant(c("occurred_at")).alias("occurredAt"), c("due_date").cast("string").alias("dueDate"), "status", "topics", evidence.alias("evidence"), "confidence"
    )


def run(episodes: DataFrame, utterances: DataFrame, chat: models.Chat | models.CountingChat) -> DataFrame:
    """schemas.RUN, one row per episode. Each different prompt is asked once; an answer that can't be read, or that the model failed to give, gives no facts.
    elapsed and tokens are those of the model's call."""
    asked = cut(models.ask_counted(prompts(episodes, utterances), "prompt", chat))
    numbered = cut(models.payload_facts(asked).withColumn("fact_no", F.monotonically_increasing_id()))
    checked = validate.validate(validate.repair_citations(numbered, utterances), utterances)
    warned = F.filter("issues", lambda i: i["severity"] == "WARN")
    found = checked.groupBy("episode_id").agg(
        F.collect_list(F.when(F.col("accepted"), stored_fact())).alias("accepted"),
        F.collect_list(F.when(~F.col("accepted"), F.struct(stored_fact().alias("fact"), "issues"))).alias("rejected"),
        F.flatten(F.collect_list(warned)).alias("warnings"),
    )
    joined = asked.join(found, "episode_id", "left")
    filled = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("accepted", "rejected", "warnings")]
    return joined.select(F.col("episode_id").alias("episodeId"), *filled, F.lit(schemas.PROMPT_SIGNATURE).alias("promptSignature"), F.format_string("PT%.3fS", F.col("call.milliseconds") / 1000).alias("elapsed"), F.col("call.input_tokens").alias("inputTokens"), F.col("call.output_tokens").alias("outputTokens"))


def stored(results: DataFrame, folder: str, now: datetime | None = None) -> DataFrame:
    """results, written as the newest run of folder and read back."""
    return runs.read_run(results.sparkSession, runs.write_run(results, folder, now))
