"""The engine's operators applied to the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalog:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.oracles[query.__name__] = sql
            return query

        return add


# The driver's tables in the engine's terms.
FACT_TYPES = {"purchase": "DECISION", "click": "ACTION_ITEM", "signup": "COMMITMENT", "error": "RISK", "view": "OPEN_QUESTION"}
HELD = "2024-01-16 12:00:00"


def event_facts(events: DataFrame) -> DataFrame:
    """Events as facts: consecutive events of one user and type are versions of one fact."""
    kind = F.create_map(*[F.lit(x) for pair in FACT_TYPES.items() for x in pair])[F.col("event_type")]
    acl = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("team:ops"))).otherwise(F.array().cast("array<string>"))
    return events.select(
        F.col("event_id").alias("fact_id"), kind.alias("type"), F.concat("event_type", F.lit(" "), "props").alias("statement"), F.col("user_id"), F.col("ts").alias("occurred_at"), "value", acl.alias("acl_grants"),
    )


EVENT_FACTS_SQL = """
    f AS (
        SELECT event_id AS fact_id, user_id, ts AS occurred_at, value, event_type || ' ' || props AS statement,
            CASE event_type WHEN 'purchase' THEN 'DECISION' WHEN 'click' THEN 'ACTION_ITEM' WHEN 'signup' THEN 'COMMITMENT' WHEN 'error' THEN 'RISK' ELSE 'OPEN_QUESTION' END AS type,
            event_id % 5 = 0 AS hidden
        FROM events
    )"""
VERSIONS_SQL = f"""{EVENT_FACTS_SQL}, v AS (
        SELECT *, occurred_at AS valid_from, lead(occurred_at) OVER w AS valid_to, lead(fact_id) OVER w AS next_id, row_number() OVER w AS place FROM f
        WINDOW w AS (PARTITION BY user_id, type ORDER BY occurred_at, fact_id)
    )"""
