"""Meeting transcripts: zoom/*.vtt, each with <stem>.meta.json beside it, which may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolore import schemas
from chronolore.functions.dates import cue_offset_ms
from chronolore.functions.text import is_blank, strip
from chronolore.lineage import cut
from chronolore.sources.episodes import Episodes, assemble, exists, merge_turns, none
from chronolore.sources.files import gathered

#: A colon further into a cue is punctuation, no speaker.
SPEAKER_MOST = 39


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """stem and the fields of the metadata files."""
    if not exists(spark, f"{root}/zoom"):
        return spark.createDataFrame([], f"stem string, {schemas.MEETING}")
    return gathered(spark.read.schema(schemas.MEETING).option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(f"{root}/zoom").select(F.regexp_replace("_metadata.file_name", r"\.meta\.json$", "").alias("stem"), "*"))


def cues(transcripts: DataFrame, text: str = "value") -> DataFrame:
    """The cues of each transcript: its other columns, place, offset_ms, speaker, said."""
    others = [c for c in transcripts.columns if c != text]
    blocks = transcripts.select(*others, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), r"\n\s*\n")).alias("place", "block"))
    lines = F.filter(F.split(strip(F.col("block")), r"\n"), lambda x: ~is_blank(x))
    blocks = blocks.withColumn("lines", lines).where((F.size("lines") > 0) & ~F.startswith(F.get("lines", F.lit(0)), F.lit("WEBVTT")))
    timing: Column = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True)
    blocks = blocks.withColumn("timing", timing.cast("int")).where((F.col("timing") > 0) & (F.col("timing") < F.size("lines")))
    payload = F.array_join(F.slice("lines", F.col("timing") + 1, F.size("lines")), " ")
    blocks = blocks.withColumn("offset_ms", cue_offset_ms(F.split(F.get("lines", F.col("timing") - 1), "-->")[0])).withColumn("payload", payload)
    colon = F.instr("payload", ":") - 1
    named = (colon > 0) & (colon <= SPEAKER_MOST)
    speaker = F.when(named, strip(F.substring_index("payload", ":", 1))).otherwise("Unknown")
    said = F.when(named, strip(F.substring(F.col("payload"), colon + 2, F.length("payload")))).otherwise(strip(F.col("payload")))
    return blocks.select(*others, "place", "offset_ms", speaker.alias("speaker"), said.alias("said"))


def read(spark: SparkSession, root: str) -> Episodes:
    if not exists(spark, f"{root}/zoom"):
        return none(spark)
    files = cut(gathered(spark.read.text(f"{root}/zoom", wholetext=True, pathGlobFilter="*.vtt").select(F.regexp_replace("_metadata.file_name", r"\.vtt$", "").alias("stem"), "value")))
    heads = files.select("stem").join(cut(metadata(spark, root)), "stem", "left").select(
        "stem",
        F.lit("ZOOM").alias("system"),
        F.coalesce("uuid", "stem").alias("external_id"),
        F.lit("MEETING_TRANSCRIPT").alias("kind"),
        F.coalesce("topic", "stem").alias("title"),
        F.coalesce(F.try_to_timestamp("start_time"), F.timestamp_seconds(F.lit(0))).alias("occurred_at"),
        F.lit(None).cast("string").alias("permalink"),
        F.coalesce("scope.id", "stem").alias("scope_id"),
        F.coalesce("scope.visibility", F.lit("PUBLIC")).alias("visibility"),
    )
    turns = merge_turns(cues(files), ["stem"], ["place", "offset_ms"], "speaker", "said").join(heads.select("stem", "system", "external_id", "occurred_at"), "stem")
    said = turns.select(
        "system",
        "external_id",
        F.col("turn_no").alias("ordinal"),
        F.concat("stem", F.lit(":"), "speaker").alias("raw_id"),  # a label means another person in each meeting
        "speaker",
        F.timestamp_millis(F.unix_millis("occurred_at") + F.col("offset_ms")).alias("at"),
        F.col("said").alias("text"),
        F.lit(None).cast("string").alias("permalink"),
    )
    return assemble(heads.drop("stem"), said)
