"""Lineage cuts and connected components, for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir is used. Only where it is unset and Spark runs in this one process (tests, a laptop) a temporary
    folder is made; on a cluster that would be the driver's own disk, so it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="chronolore-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (not made yet) beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: later reads survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v: numbers or strings): rows (node, label), label the component's least node.

    Alternates two star contractions until the edges stop changing; each round is a few shuffles of the edges alone, ends in a
    checkpoint, and the number of rounds grows with the logarithm of the longest path. Loops and repeated edges do no harm.

    A node of a large star has as many rows as neighbours. Its least neighbour is found by sums merged before the shuffle and kept, so that
    the join with it reads two plain exchanges, of which adaptive execution splits the uneven one.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("x").alias("node"), F.col("y").alias("label")).union(now.select("y", "y")).distinct()
        seen = mark
        both = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        root = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(root, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = cut(small.union(root.select("x", "m")).distinct())
