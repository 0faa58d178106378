"""Access: a fact is readable by who holds all grants of all containers it derives from. No grants needed: public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolore.functions.ids import source_key
from chronolore.schemas import VISIBILITIES


def grants_of(system: Column, scope_id: Column, visibility: Column) -> Column:
    """Grants that one container asks for."""
    return F.when(visibility == "PUBLIC", F.array().cast("array<string>")).otherwise(F.array(source_key(system, scope_id)))


def literal_grants(grants: list[str]) -> Column:
    return F.array(*[F.lit(g) for g in grants]).cast("array<string>")


def readable(acl: Column, grants: list[str] | Column) -> Column:
    """Whether all grants are held. A null list (people, topics) is public."""
    held = grants if isinstance(grants, Column) else literal_grants(grants)
    return acl.isNull() | (F.size(F.array_except(acl, held)) == 0)


def visibility_rank(visibility: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VISIBILITIES]), visibility).cast("int")


def inherit(sources: DataFrame, key: list[str], acl: str = "acl_grants", visibility: str = "visibility") -> DataFrame:
    """The access of what derives from several containers: key, acl_grants (all grants, sorted), visibility (the tightest), n_sources.

    A row without any container (visibility null, as from an outer join) stops the query: nothing may be public for want of a source.
    """
    rank = F.max(visibility_rank(F.col(visibility)))
    stop = F.raise_error(F.lit("nothing derives from no source")).cast("int")
    grants = F.array_sort(F.array_distinct(F.flatten(F.collect_set(acl))))  # of different containers, not of all sources
    merged = sources.groupBy(*key).agg(grants.alias("acl_grants"), rank.alias("_rank"), F.count(visibility).cast("int").alias("n_sources"))
    named = F.element_at(F.array(*[F.lit(v) for v in VISIBILITIES]), F.when(F.col("n_sources") > 0, F.col("_rank")).otherwise(stop))
    return merged.select(*key, "acl_grants", named.alias("visibility"), "n_sources")


def withheld(rows: DataFrame, acl: str, grants: list[str]) -> DataFrame:
    """Rows that the reader may not see."""
    return rows.where(~readable(F.col(acl), grants))
