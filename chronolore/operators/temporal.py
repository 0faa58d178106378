"""Facts hold in half-open intervals [valid_from, valid_to); a null end means still."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolore.functions.dates import closed_at


def held_at(moment: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether the interval holds at the moment; a null moment asks for nothing."""
    return moment.isNull() | ((F.col(start) <= moment) & (F.col(end).isNull() | (F.col(end) > moment)))


def current(end: str = "valid_to") -> Column:
    return F.col(end).isNull()


def versions(rows: DataFrame, key: list[str], at: str, order: list[str]) -> DataFrame:
    """rows with valid_from and valid_to: each holds until the next of its key."""
    return rows.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(Window.partitionBy(*key).orderBy(at, *order)))


def held_at_each(facts: DataFrame, moments: DataFrame, keys: list[str], start: str = "valid_from", end: str = "valid_to", at: str = "moment") -> DataFrame:
    """moments (keys, at, ...) joined with the facts (of the same keys) that hold then, by equality alone.

    Time is cut into cells of 1, 2, 4, ... seconds. An interval is put into the one or two cells that it meets of the least width that is not
    below its length, a moment into its cell of each width that there is, so they meet exactly once if at all, and mostly only where the moment is near the
    interval. Facts that still hold end after the last moment. Other columns of both must have different names.

    The join is a merge join: both sides are as large as the tables, and columns that shuffle to a few bytes a row would be taken for small enough to broadcast."""
    seconds = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000)
    last = moments.agg(F.max(seconds(at)).alias("s")).first()["s"]
    known = facts.where(F.col(start).isNotNull()).withColumn("_from", seconds(start)).withColumn("_to", F.coalesce(seconds(end), F.greatest(F.lit(last or 0), F.col("_from")) + 1))
    known = known.withColumn("_width", F.greatest(F.ceil(F.log2(F.col("_to") - F.col("_from") + 1.0)), F.lit(0)).cast("int"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_width"))).cast("long")
    placed = known.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("_from"), cell("_to"))))).drop("_from", "_to")
    widths = [r["_width"] for r in known.select("_width").distinct().collect()]  # fewer than the bits of a number
    asked = moments.withColumn("_at", seconds(at)).withColumn("_width", F.explode(F.array(*[F.lit(w) for w in widths]) if widths else F.array().cast("array<int>"))).withColumn("_cell", cell("_at")).drop("_at")
    return asked.join(placed.hint("merge"), [*keys, "_width", "_cell"]).where(held_at(F.col(at), start, end)).drop("_width", "_cell")


def close(facts: DataFrame, closures: DataFrame) -> DataFrame:
    """facts (fact_id, valid_from, status, ...) with their ends from closures (fact_id, closed_at, superseded_by); a closed fact's status is
    SUPERSEDED. An end never comes before its start."""
    ends = closures.select("fact_id", F.col("closed_at").alias("_at"), F.col("superseded_by").alias("_by"))
    closed = facts.drop("valid_to", "superseded_by").join(ends, "fact_id", "left")
    end = F.when(F.col("_at").isNotNull(), closed_at(F.col("valid_from"), F.col("_at")))
    return closed.withColumn("valid_to", end).withColumn("superseded_by", F.col("_by")).withColumn("status", F.when(F.col("_at").isNotNull(), "SUPERSEDED").otherwise(F.col("status"))).drop("_at", "_by")


def zero_width(facts: DataFrame) -> DataFrame:
    """Facts that never held."""
    return facts.where("valid_to <= valid_from")
