"""Extraction runs (<folder>/<yyyyMMdd-HHmmss>/extraction.json) and answer keys (ground-truth/*.json)."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolore import schemas
from chronolore.functions.dates import date_of, instant_of


def newest_run(spark: SparkSession, folder: str) -> str | None:
    """The run with the greatest name, as names are times."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/extraction.json")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return max((str(f.getPath()) for f in found or []), default=None)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """One row per episode of a run."""
    return spark.read.schema(schemas.RUN).option("multiLine", True).json(path)


def accepted(run: DataFrame) -> DataFrame:
    """The accepted facts of a run, in the columns of extracted facts."""
    f = run.select(F.col("episodeId").alias("episode_id"), F.explode("accepted").alias("f"))
    evidence = F.transform("f.evidence", lambda e: F.struct(e["episodeId"].alias("episode_id"), e["utteranceOrdinal"].alias("ordinal"), e["verbatimSpan"].alias("span")))
    return f.select(
        "episode_id", "f.type", "f.statement", F.col("f.ownerMention").alias("owner_mention"), F.col("f.participantMentions").alias("participant_mentions"),
        instant_of(F.col("f.occurredAt")).alias("occurred_at"), date_of(F.col("f.dueDate")).alias("due_date"), "f.status", "f.topics", evidence.alias("evidence"), "f.confidence",
    )


def write_run(results: DataFrame, folder: str, now: datetime | None = None) -> str:
    """Writes a run, an array of results per file, as read_run() reads it."""
    path = f"{folder}/{(now or datetime.now(UTC)):%Y%m%d-%H%M%S}/extraction.json"
    rows = results.select(F.struct(*results.columns).alias("r"), F.spark_partition_id().alias("part"))
    rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value")).select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


def gold_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GOLD_FACTS).option("multiLine", True).json(path).select(F.inline("facts"))


def gold_questions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.GOLD_QUESTIONS).option("multiLine", True).json(path).select(F.inline("questions"))
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("principal", "expected_facts", "must_not_say", "must_not_lead_with")})


def gold_entities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(canonical, email, aliases) and (pair, why): names that are not one person."""
    rows = spark.read.schema(schemas.GOLD_ENTITIES).option("multiLine", True).json(path)
    return rows.select(F.inline("entities")), rows.select(F.inline("non_matches"))


def key_faults(facts: DataFrame, questions: DataFrame, entities: DataFrame, episodes: DataFrame) -> DataFrame:
    """What the answer key names and nothing defines: rows (kind, holder, missing)."""
    cited = facts.select("id", F.explode("sources").alias("missing")).join(episodes.select(F.col("episode_id").alias("missing")), "missing", "left_anti")
    asked = questions.select("id", F.explode("expected_facts").alias("missing")).join(facts.select(F.col("id").alias("missing")), "missing", "left_anti")
    owned = facts.where("owner IS NOT NULL").select("id", F.col("owner").alias("missing")).join(entities.select(F.col("canonical").alias("missing")), "missing", "left_anti")
    kinds = {"source": cited, "fact": asked, "entity": owned}
    frames = [df.select(F.lit(kind).alias("kind"), F.col("id").alias("holder"), "missing") for kind, df in kinds.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """side (gone or new), n and the columns: which rows two runs don't share, and how often; a row that one has twice and the other once differs once."""
    one = lambda a, b, side: a.exceptAll(b.select(*a.columns)).groupBy(*a.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return one(before, after, "gone").unionByName(one(after, before, "new"))
