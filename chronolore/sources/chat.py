"""Chat threads: slack/users.json and slack/threads/*.json, a file per thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolore import schemas
from chronolore.functions.dates import message_ts
from chronolore.functions.text import ellipsis, strip
from chronolore.lineage import cut
from chronolore.sources.episodes import Episodes, assemble, exists, none
from chronolore.sources.files import gathered


def users(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/slack/users.json"
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.USERS)
    return spark.read.schema(schemas.USERS).option("multiLine", True).json(path)


def thread_title(channel: Column, opener: Column) -> Column:
    """A thread has no subject, so its first message stands in."""
    text = strip(F.regexp_replace(opener, r"\s+", " "))
    return F.when(opener.isNull(), F.concat(F.lit("#"), channel)).otherwise(F.concat(F.lit("#"), channel, F.lit(" — "), ellipsis(text, 70)))


def read(spark: SparkSession, root: str) -> Episodes:
    if not exists(spark, f"{root}/slack/threads"):
        return none(spark)
    # A folder is listed once, where a pattern would make each file a path of its own; and each file is opened once.
    threads = cut(gathered(spark.read.schema(schemas.THREAD).option("multiLine", True).option("pathGlobFilter", "*.json").json(f"{root}/slack/threads")))
    threads = threads.select("channel", F.concat("channel.id", F.lit("/"), "thread_ts").alias("external_id"), F.coalesce("messages", F.array().cast("array<struct<ts:string,user:string,text:string,permalink:string>>")).alias("messages"))
    said = threads.select("external_id", F.posexplode("messages").alias("place", "m")).select("external_id", "place", message_ts(F.col("m.ts")).alias("at"), F.coalesce("m.user", F.lit("")).alias("raw_id"), F.coalesce("m.text", F.lit("")).alias("text"), "m.permalink")
    said = said.withColumn("ordinal", F.row_number().over(Window.partitionBy("external_id").orderBy("at", "place")) - 1)
    # Chats have far fewer users than messages; whether they fit a broadcast is for Spark to find from their size.
    names = users(spark, root).groupBy("id").agg(F.first(F.coalesce("profile.display_name", "real_name", "id")).alias("name"))
    said = said.join(names, said["raw_id"] == names["id"], "left").withColumn("speaker", F.coalesce("name", "raw_id")).withColumn("system", F.lit("SLACK"))
    first = said.where("ordinal = 0").select("external_id", "at", "permalink", F.col("text").alias("opener"))
    heads = threads.join(first, "external_id", "left").select(
        F.lit("SLACK").alias("system"),
        "external_id",
        F.lit("SLACK_THREAD").alias("kind"),
        thread_title(F.coalesce("channel.name", "channel.id"), F.col("opener")).alias("title"),
        F.coalesce("at", F.timestamp_seconds(F.lit(0))).alias("occurred_at"),
        "permalink",
        F.col("channel.id").alias("scope_id"),
        F.coalesce("channel.visibility", F.lit("PUBLIC")).alias("visibility"),
    )
    return assemble(heads, said)


