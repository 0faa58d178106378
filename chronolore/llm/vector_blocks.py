"""Search of a query set against all rows, in blocks: what the two vector searches (operators 5 and 6) share.

Every row is dealt to one of the index blocks, every query to one of the query blocks; a pair of blocks is one group, so a task holds
at most one block of either kind whatever the table's size. Each group returns its own best k per query, and one window over these
few rows picks the final ones. What a query finds does not depend on the blocks.

A repeated id is one query (its least vector); it is made one before queries are dealt, so all its groups ask the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an index block: as many as give each core a block, within these bounds. Queries of a query block.
LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK = 8192, 65_536, 65_536

#: (index ids, index vectors, query ids, queries) -> (query number, index number, score) arrays.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vectors: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """Rows (id, vec array<double>) without null ids and null, empty, non-finite and, unless allowed, zero vectors."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").where(~bad)
    return rows if allow_zero else rows.where(F.exists("vec", lambda x: x != 0))


def by_length(rows: DataFrame) -> list[DataFrame]:
    """rows by the length of their vectors, which have inner products with their like only. Tables have one length, or a few."""
    lengths = [r["n"] for r in rows.select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]
    return [rows.where(F.size("vec") == n) for n in lengths] or [rows]


def queries_of(rows: DataFrame, is_query: str) -> DataFrame:
    """The rows for which is_query (of id) holds, one for each id."""
    return rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(rows: DataFrame, queries: DataFrame, kernel: Kernel, k: int, score_type: str) -> DataFrame:
    """rows and queries (id, vec), ids of queries different, all vectors of one length. Returns query_id, rank, vec_id, score."""
    n, q = rows.count(), queries.count()
    per_block = min(max(math.ceil(n / rows.sparkSession.sparkContext.defaultParallelism), LEAST_BLOCK), MOST_BLOCK)
    index_blocks, query_blocks = max(1, math.ceil(n / per_block)), max(1, math.ceil(q / QUERY_BLOCK))
    # Dealt by row number, so rows that share an id don't share a block.
    deal = lambda by, blocks: F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int")
    all_blocks = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    index = rows.select(deal(F.monotonically_increasing_id(), index_blocks).alias("i"), "id", "vec").select("i", all_blocks(query_blocks).alias("q"), "id", "vec")
    asked = queries.select(all_blocks(index_blocks).alias("i"), deal(F.col("id"), query_blocks).alias("q"), "id", "vec")
    score = pa.int64() if score_type == "long" else pa.float64()

    def run(index_part: pa.Table, query_part: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if len(index_part) and len(query_part):
            ids, query_ids = index_part.column("id").to_numpy(), query_part.column("id").to_numpy()
            at, to, s = kernel(ids, matrix(index_part.column("vec")), query_ids, matrix(query_part.column("vec")))
            found = [query_ids[at], ids[to], s]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2]).cast(score)})

    best = index.groupBy("i", "q").cogroup(asked.groupBy("i", "q")).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]
