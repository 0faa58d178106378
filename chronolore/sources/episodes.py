"""The common shape of all readers: one frame of episodes and one of their utterances."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolore import schemas
from chronolore.functions.ids import alias_key, content_hash, source_key
from chronolore.operators.acl import grants_of


@dataclass
class Episodes:
    episodes: DataFrame
    utterances: DataFrame

    def __add__(self, other: Episodes) -> Episodes:
        return Episodes(self.episodes.unionByName(other.episodes), self.utterances.unionByName(other.utterances))

    def by_time(self) -> DataFrame:
        """Episodes in the order of their time; ties by id."""
        return self.episodes.orderBy("occurred_at", "episode_id")


def none(spark: SparkSession) -> Episodes:
    return Episodes(spark.createDataFrame([], schemas.EPISODES), spark.createDataFrame([], schemas.UTTERANCES))


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder fits the pattern, in whatever store Spark reads. Asked of folders and single files: a pattern of files would list them all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def assemble(heads: DataFrame, utterances: DataFrame) -> Episodes:
    """heads: system, external_id, kind, title, occurred_at, permalink, scope_id, visibility. utterances: system, external_id, ordinal,
    raw_id, speaker, at, text, permalink. One shuffle of the utterances by episode makes the hashes."""
    said = utterances.select(source_key(F.col("system"), F.col("external_id")).alias("episode_id"), F.col("ordinal").cast("int"), "system", "raw_id", "speaker", "at", "text", "permalink")
    hashes = said.groupBy("episode_id").agg(content_hash(F.col("ordinal"), alias_key(F.col("system"), F.col("raw_id")), F.col("text")).alias("content_hash"))
    named = heads.withColumn("episode_id", source_key(F.col("system"), F.col("external_id"))).withColumn("ingested_at", F.current_timestamp())
    named = named.withColumn("acl_grants", grants_of(F.col("system"), F.col("scope_id"), F.col("visibility")))
    named = named.join(hashes, "episode_id", "left").withColumn("content_hash", F.coalesce("content_hash", F.sha2(F.lit(""), 256)))
    return Episodes(named.select("episode_id", "system", "external_id", "kind", "title", "occurred_at", "ingested_at", "permalink", "scope_id", "visibility", "acl_grants", "content_hash"), said)


def read_all(readers: list[Episodes]) -> Episodes:
    return reduce(lambda a, b: a + b, readers)


def changed(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Episodes whose content is not stored yet."""
    return new.join(stored.select("episode_id", "content_hash"), ["episode_id", "content_hash"], "left_anti")


def counts_by_system(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("system").agg(F.count(F.lit(1)).alias("episodes"))


def merge_turns(turns: DataFrame, key: list[str], order: list[str], speaker: str, text: str) -> DataFrame:
    """Neighbouring turns of one speaker as one: key, turn_no (from 0), speaker, the first turn's order columns, text, n_turns.

    The only shuffle is by key; islands are running sums over it.
    """
    by_order = Window.partitionBy(*key).orderBy(*order)
    starts = F.when(F.col(speaker).eqNullSafe(F.lag(speaker).over(by_order)) & (F.row_number().over(by_order) > 1), 0).otherwise(1)
    islands = turns.withColumn("_start", starts).withColumn("turn_no", (F.sum("_start").over(by_order) - 1).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    merged = islands.groupBy(*key, "turn_no").agg(F.first(speaker).alias(speaker), parts.alias("_parts"))
    return merged.select(*key, "turn_no", speaker, *[F.col("_parts")[0][o].alias(o) for o in order], F.array_join(F.col("_parts._text"), " ").alias(text), F.size("_parts").alias("n_turns"))


def render(episodes: DataFrame, utterances: DataFrame) -> DataFrame:
    """Episodes as the text that facts are extracted from: episode_id, rendered. Evidence cites the numbers in brackets."""
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    line = F.format_string("[%d] %s (%s): %s\n", F.col("ordinal"), F.col("speaker"), time(F.col("at")), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    said = utterances.groupBy("episode_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("lines"))
    head = F.format_string("# %s\nSource: %s\nOccurred: %s\n\n", F.coalesce("title", "kind"), F.col("episode_id"), time(F.col("occurred_at")))
    return episodes.join(said, "episode_id", "left").select("episode_id", F.concat(head, F.coalesce("lines", F.lit(""))).alias("rendered"))


def sessions(turns: DataFrame, key: list[str], at: str, gap: str) -> DataFrame:
    """key, started, ended, n: runs of turns of which none is more than gap after the one before; turns without a time are in none. Parts of a session are merged before the shuffle."""
    found = turns.groupBy(*key, F.session_window(at, gap).alias("_w")).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n"))
    return found.drop("_w")
