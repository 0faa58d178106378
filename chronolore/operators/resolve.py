"""Who a speaker or a mention is. Cheap and certain ways come first; what stays open is unresolved, with a reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolore import schemas
from chronolore.functions.text import is_blank, match_name, normalise_name, strip
from chronolore.functions.vectors import ratio
from chronolore.sources.directory import Directory

#: (labels with candidates) -> the same rows with a column answer; asked only for labels that no alias settles.
Adjudicator = Callable[[DataFrame], DataFrame]


def self_identifying(system: Column) -> Column:
    """Whether a source names its speakers by handles of its own."""
    return system.isin("SLACK", "NOTION")


def confidence(method: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in schemas.METHOD_CONFIDENCE.items() for x in pair])[method]


def speakers(utterances: DataFrame, directory: Directory, adjudicate: Adjudicator | None = None) -> DataFrame:
    """One row per episode and speaker: episode_id, system, raw_id, label, person_id, method, rationale."""
    who = utterances.select("episode_id", "system", "raw_id", F.col("speaker").alias("label")).distinct()
    alias = directory.aliases.groupBy("system", "value").agg(F.min("person_id").alias("person"))
    by_id = alias.select("system", F.col("value").alias("raw_id"), F.col("person").alias("_by_id"))
    by_label = alias.select("system", F.col("value").alias("label"), F.col("person").alias("_by_label"))
    found = who.join(by_id, ["system", "raw_id"], "left").join(by_label, ["system", "label"], "left").withColumn("person_id", F.coalesce("_by_id", "_by_label")).drop("_by_id", "_by_label")
    method, why = F.lit("HANDLE"), F.lit("the source's own handle")
    if adjudicate is None:
        open_reason = F.lit("no alias of this source, and nobody was asked")
        return _speaker(found, F.when(F.col("person_id").isNotNull(), method).otherwise("UNRESOLVED"), F.when(F.col("person_id").isNotNull(), why).otherwise(open_reason))
    attendees = directory.participants.join(directory.people.select("person_id", "name"), "person_id").groupBy("episode_id").agg(F.array_sort(F.collect_set("name")).alias("candidates"))
    asked = adjudicate(found.where("person_id IS NULL").select("episode_id", "raw_id", "label").join(attendees, "episode_id"))
    # The answer must be one of the attendees, whatever was asked for.
    named = asked.withColumn("_name", match_name(F.col("answer"), F.col("candidates"))).where("_name IS NOT NULL").select("episode_id", "raw_id", "_name")
    people = directory.participants.join(directory.people, "person_id").select("episode_id", F.col("name").alias("_name"), F.col("person_id").alias("_asked"))
    settled = found.join(named, ["episode_id", "raw_id"], "left").join(people, ["episode_id", "_name"], "left")
    kind = F.when(F.col("person_id").isNotNull(), method).when(F.col("_asked").isNotNull(), "LLM_ADJUDICATED").otherwise("UNRESOLVED")
    reason = F.when(F.col("person_id").isNotNull(), why).when(F.col("_asked").isNotNull(), F.lit("chosen among those present")).otherwise(F.lit("no alias, and no choice among those present"))
    return _speaker(settled.withColumn("_kind", kind).withColumn("_why", reason).withColumn("person_id", F.coalesce("person_id", "_asked")), F.col("_kind"), F.col("_why"))


def _speaker(rows: DataFrame, method: Column, rationale: Column) -> DataFrame:
    return rows.select("episode_id", "system", "raw_id", "label", "person_id", method.alias("method"), rationale.alias("rationale"))


def missing_handles(speaker_rows: DataFrame) -> DataFrame:
    """system, raw_id, label, n_episodes: handles that their own source gave and no alias has, so that the directory lacks a person or an alias; whom
    other sources name by a label only is nothing to be put right there. Of several labels of a handle the least is told."""
    lacking = speaker_rows.where(self_identifying(F.col("system")) & (F.col("method") == "UNRESOLVED") & ~is_blank(F.col("raw_id")))
    return lacking.groupBy("system", "raw_id").agg(F.min("label").alias("label"), F.count_distinct("episode_id").alias("n_episodes"))


def beginnings(names: DataFrame, key: list[str]) -> DataFrame:
    """Per key and beginning of a name: n_exact and exact (how many people have exactly that name, and the least of them), n_start and start
    (how many have a name that begins so). Names are short, so all their beginnings are made rows and a prefix is found by equality;
    people are only counted, never gathered."""
    whole = F.length("name")
    parts = names.select(*key, "person_id", "name", F.explode(F.sequence(F.lit(1), whole)).alias("_n"))
    marked = parts.groupBy(*key, F.expr("substring(name, 1, _n)").alias("_norm"), "person_id").agg(F.max(F.col("_n") == whole).alias("_whole"))
    return marked.groupBy(*key, "_norm").agg(
        F.count_if("_whole").alias("n_exact"), F.min(F.when(F.col("_whole"), F.col("person_id"))).alias("exact"), F.count(F.lit(1)).alias("n_start"), F.min("person_id").alias("start")
    )


def mentions(rows: DataFrame, directory: Directory, speaker_rows: DataFrame) -> DataFrame:
    """rows: mention_no (unique), episode_id, mention. Adds cleaned, person_id, method, rationale, confidence.

    Rungs: e-mail; a resolved speaker label of the episode; the one person of exactly this name; of several, the one present;
    the one person present whose name starts so; the one in the directory whose name starts so.
    """
    people, names = directory.people, directory.names()
    cleaned = strip(F.col("mention"))
    asked = rows.withColumn("cleaned", cleaned).withColumn("_norm", normalise_name(cleaned)).withColumn("_lower", F.lower(cleaned))
    resolved = speaker_rows.where("person_id IS NOT NULL")
    emails = people.where(~is_blank(F.col("email"))).groupBy(F.lower("email").alias("_lower")).agg(F.min("person_id").alias("_email"))
    labels = resolved.groupBy("episode_id", F.lower("label").alias("_lower")).agg(F.min(F.struct("person_id", "method", "rationale")).alias("_label"))
    known = beginnings(names, [])
    present = beginnings(resolved.select("episode_id", "person_id").distinct().join(names, "person_id"), ["episode_id"])
    here = present.select("episode_id", "_norm", F.col("n_exact").alias("n_exact_here"), F.col("exact").alias("exact_here"), F.col("n_start").alias("n_start_here"), F.col("start").alias("start_here"))
    found = asked.join(emails, "_lower", "left").join(labels, ["episode_id", "_lower"], "left").join(known, "_norm", "left").join(here, ["episode_id", "_norm"], "left")
    found = found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_exact", "n_start", "n_exact_here", "n_start_here")})
    one = lambda who, method, why: F.struct(F.col(who).alias("person_id"), F.lit(method).alias("method"), why.alias("rationale"))
    nobody = lambda why: F.struct(F.lit(None).cast("string").alias("person_id"), F.lit("UNRESOLVED").alias("method"), why.alias("rationale"))
    c = F.col
    outcome = (
        F.when(is_blank(c("mention")), nobody(F.lit("empty mention")))
        .when(F.contains("cleaned", F.lit("@")) & F.contains("cleaned", F.lit(".")) & c("_email").isNotNull(), one("_email", "EMAIL", F.lit("same e-mail")))
        .when(c("_label").isNotNull(), F.struct("_label.person_id", "_label.method", "_label.rationale"))
        .when(c("n_exact") == 1, one("exact", "EXACT_NAME", F.lit("the only one of this name")))
        .when((c("n_exact") > 1) & (c("n_exact_here") == 1), one("exact_here", "UNIQUE_IN_EPISODE", F.format_string("%d people have this name; one of them is present", "n_exact")))
        .when(c("n_exact") > 1, nobody(F.format_string("%d people have this name and the episode does not tell which", "n_exact")))
        .when(c("n_start_here") == 1, one("start_here", "UNIQUE_IN_EPISODE", F.format_string("%d people match; one of them is present", "n_start")))
        .when(c("n_start") == 1, one("start", "EXACT_NAME", F.lit("the only name that starts so")))
        .when(c("n_start") == 0, nobody(F.lit("nobody in the directory has this name")))
        .otherwise(nobody(F.format_string("%d people match and none is the only one present", "n_start")))
    )
    out = found.withColumn("_o", outcome).select(*rows.columns, "cleaned", "_o.*")
    return out.withColumn("confidence", confidence(F.col("method")))


def by_method(resolutions: DataFrame) -> DataFrame:
    return resolutions.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def deterministic_share(resolutions: DataFrame) -> DataFrame:
    """One row: n, certain (resolved by a certain method), share (0 of nothing)."""
    certain = F.count_if(F.col("person_id").isNotNull() & F.col("method").isin(schemas.DETERMINISTIC_METHODS))
    return resolutions.agg(F.count(F.lit(1)).alias("n"), certain.alias("certain")).withColumn("share", ratio(F.col("certain"), F.col("n"), 0.0))


def fused_people(resolved_names: DataFrame, non_matches: DataFrame) -> DataFrame:
    """Pairs of names (pair array, why) that are not one person but were resolved to one; resolved_names: name, person_id."""
    side = lambda i, p: resolved_names.select(F.col("name").alias(f"n{i}"), F.col("person_id").alias(p))
    pairs = non_matches.select("pair", "why", F.col("pair")[0].alias("n0"), F.col("pair")[1].alias("n1"))
    return pairs.join(side(0, "p0"), "n0").join(side(1, "p1"), "n1").where("p0 = p1").select("pair", "why", F.col("p0").alias("person_id")).distinct()


