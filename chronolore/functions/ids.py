"""Identifiers that follow from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolore.functions.text import is_blank, normalise_name, strip


def source_key(system: Column, external_id: Column) -> Column:
    """Key of a source or a container: slack:C1."""
    return F.concat(F.lower(system), F.lit(":"), external_id)


def alias_key(system: Column, value: Column) -> Column:
    """Key of an alias or a speaker: SLACK:U1."""
    return F.concat(system, F.lit(":"), value)


def utterance_id(episode_id: Column, ordinal: Column) -> Column:
    return F.concat(episode_id, F.lit("#"), ordinal.cast("string"))


def person_id(email: Column, name: Column) -> Column:
    return F.when(~is_blank(email), F.concat(F.lit("person:email:"), F.lower(strip(email)))).otherwise(F.concat(F.lit("person:name:"), normalise_name(name)))


def fact_id(episode_id: Column, fact_type: Column, statement: Column) -> Column:
    """fact: and 24 digits of the SHA-256 of episode, type and statement with zero bytes between; a null statement counts as 'null'."""
    zero = F.lit(b"\x00")
    parts = F.concat(F.encode(episode_id, "UTF-8"), zero, F.encode(fact_type, "UTF-8"), zero, F.encode(F.coalesce(statement, F.lit("null")), "UTF-8"))
    return F.concat(F.lit("fact:"), F.substring(F.sha2(parts, 256), 1, 24))


def content_hash(ordinal: Column, speaker_key: Column, text: Column) -> Column:
    """Aggregate: SHA-256 of all utterances' speaker and text, each followed by a zero byte, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(ordinal.alias("o"), speaker_key.alias("s"), text.alias("t"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda u: F.concat(u["s"], F.lit("\x00"), u["t"], F.lit("\x00"))), ""), 256)
