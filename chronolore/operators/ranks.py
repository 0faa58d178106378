"""Ranks within a query, and over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolore.lineage import cut


def top(rows: DataFrame, query: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each query, with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*query).orderBy(*order)).cast("int")).where(F.col(rank) <= k)


def global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank (from 1) over all of them: dealt by ranges of the order, counted, and numbered within each range, so that no task
    holds all rows. One shuffle, kept in the checkpoint folder."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(base.select("_part", "_base"), "_part").withColumn("rank", (F.col("_base") + F.col("_local")).cast("int")).drop("_part", "_base", "_local")
