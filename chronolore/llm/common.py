"""What several operators share: words, ranks without a hot task, and the lineage cuts and components of the engine."""

from __future__ import annotations

import ctypes
import functools
import gc
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolore.lineage import components, cut, ensure_checkpoint_dir, shared_folder

__all__ = ["BLANKS", "WORD", "balanced_buckets", "components", "cut", "delete", "ensure_checkpoint_dir", "free_shuffles", "give_back", "given_back", "ranked", "shared_folder", "small_batches", "words_in_blocks"]

#: A word is a longest run of characters other than space and the controls 9 to 13; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"


def words_in_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists that cover about size bytes each, so a huge text never becomes one huge list."""
    if len(text) <= size:
        yield text.split()
        return
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        while end < n and text[end] not in BLANKS:
            end += 1
        yield text[start:end].split()
        start = end


def give_back() -> None:
    """Memory that Arrow and the C library hold free goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def given_back(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """kernel, with what it has freed given back when its batches end: an idle worker keeps its free memory otherwise, beside the tasks of the
    stages that follow."""

    @functools.wraps(kernel)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of shuffles when the driver's collector finds that no plan has them any more; a driver with memory left
    collects seldom, and disks fill meanwhile."""
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the store that it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is computed inside, where rows carry several texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def balanced_buckets(rows: int, per_bucket: int = 2048) -> int:
    """Buckets for ranked(): about the square root of the rows, none much over per_bucket while tables are small."""
    return max(1, math.ceil(rows / max(per_bucket, math.isqrt(rows))))


def ranked(df: DataFrame, group: list[str], order: list[Column], spread: list[Column], buckets: int, name: str = "rank") -> DataFrame:
    """Adds the long column name: 0, 1, 2, ... within each group (columns without nulls), by bucket of spread and then order.

    A group is dealt over buckets; counts per bucket give each bucket its first rank, so no task sees a whole group.
    """
    tagged = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return tagged.withColumn("_local", local).join(base, keys).withColumn(name, (F.col("_base") + F.col("_local")).cast("long")).drop("_bucket", "_local", "_base")
