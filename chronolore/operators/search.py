"""Hybrid search over facts: exact vector neighbours, BM25, reciprocal rank fusion, currency and diversity.

Access and as-of are filters before any ranking, so a limit never runs short for want of readable rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolore.operators.ranks import global_rank, top
from chronolore.operators.text_index import bm25_top, tokens

__all__ = ["best_of_blocks", "bm25_top", "document_frequencies", "fuse", "global_rank", "nearest", "rerank", "term_frequencies", "tokens", "top", "vector_top", "vector_top_all", "vector_top_many"]

# Fixed values.
RRF_K, SEEDS, FINAL, PER_EPISODE, HISTORY_DEPTH = 60, 40, 8, 3, 5
#: Query vectors that one pass carries along.
MOST_QUERIES = 1024
#: Rows and queries of one pair of blocks, and queries scored at once in it.
BLOCK, AT_ONCE = 8192, 512
#: Rows and questions of one pair of wide blocks, where what travels is as many vectors as blocks meet; questions of such a pair at least.
WIDE, FEWEST = 32768, 512


def nearest(rows: DataFrame, queries: dict[int, list[float]], k: int, id_col: str, own: bool) -> DataFrame:
    """query_id, id, score: for each Arrow batch of rows the k greatest cosines (rounded to six places) for each query, ties by id; without own, a
    row is no answer to the query of its own id. The queries are a stated set, sent along; scores are one matrix product per batch, and
    only k rows per batch and query leave it."""
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} query vectors; call again for others")
    numbers = np.array(list(queries), np.int64)
    asked = np.array([list(map(float, v)) for v in queries.values()], np.float64).reshape(len(queries), -1)
    asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist())
            vectors = [np.asarray(v, np.float64)[: asked.shape[1]] for v in batch.column(1).to_pylist()]
            x = np.stack([np.pad(v, (0, asked.shape[1] - len(v))) for v in vectors]) if vectors else np.zeros((0, asked.shape[1]))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            scores, best = np.round(x @ asked.T, 6) + 0.0, []
            for j, number in enumerate(numbers):
                at = np.arange(len(ids)) if own else np.flatnonzero(ids != number)
                if len(at) > k:
                    at = at[scores[at, j] >= np.partition(scores[at, j], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((ids[at], -scores[at, j]))[:k]]
                best.append((np.full(len(at), number), at, scores[at, j]))
            number, at, score = (np.concatenate(b) for b in zip(*best, strict=True)) if best else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(score, pa.float64())], names=["query_id", id_col, "score"])

    vectors = rows.where(F.col("embedding").isNotNull()).select(id_col, "embedding")
    return vectors.mapInArrow(run, f"query_id long, {id_col} {rows.schema[id_col].dataType.simpleString()}, score double")


def vector_top(facts: DataFrame, vector: list[float], k: int = SEEDS, id_col: str = "fact_id") -> DataFrame:
    """id, score, rank: the k facts of greatest cosine; ties by id."""
    return top(nearest(facts, {0: vector}, k, id_col, True), ["query_id"], [F.desc("score"), F.col(id_col)], k).drop("query_id")


def vector_top_many(rows: DataFrame, queries: dict[int, list[float]], k: int, id_col: str) -> DataFrame:
    """query_id, id, score, rank for a stated set of query vectors (their ids are of the kind of id_col)."""
    return top(nearest(rows, queries, k, id_col, False), ["query_id"], [F.desc("score"), F.col(id_col)], k)


def vector_top_all(rows: DataFrame, queries: DataFrame, k: int, id_col: str, own: bool = False) -> DataFrame:
    """query_id, id, score, rank for any number of queries (rows of id_col and embedding; a repeated id is one query): rows and queries are
    dealt to blocks, each pair of blocks is one group and returns its own best k per query. Without own, a row is no answer to the query
    of its own id."""
    vectors, asked = (df.where(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), F.col("embedding").alias("vector")) for df in (rows, queries))
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    row_blocks, query_blocks = (max(1, math.ceil(df.count() / BLOCK)) for df in (vectors, asked))
    deal = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = vectors.select(deal(row_blocks).alias("r"), each(query_blocks).alias("q"), "id", "vector")
    right = asked.select(each(row_blocks).alias("r"), deal(query_blocks).alias("q"), "id", "vector")
    return top(best_of_blocks(left, right, ["r", "q"], k, id_col, own), ["query_id"], [F.desc("score"), F.col(id_col)], k)


def at_least(scores: np.ndarray, k: int) -> np.ndarray | None:
    """For each row of scores a number that k of it or more reach: the k-th greatest of the maxima of groups of columns. Few scores reach it, and it costs one look at
    each. None if columns are too few, or a score is no number."""
    groups = 4 * k
    width = scores.shape[1] // groups
    if width < 2 or np.isnan(scores).any():
        return None
    greatest = scores[:, : groups * width].reshape(len(scores), groups, width).max(axis=2)
    return np.partition(greatest, groups - k, axis=1)[:, groups - k]


def best_of_blocks(left: DataFrame, right: DataFrame, keys: list[str], k: int, id_col: str, own: bool) -> DataFrame:
    """query_id, id, score: where a block of rows (keys, id, vector) meets a block of questions of the same keys, the k greatest cosines (rounded to six
    places) of each question, ties by id. Where right has floor, rows of a lesser score are left out of that question's (null: none)."""
    floored = "floor" in right.columns
    kind, query_kind = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()

    def unit(column: pa.ChunkedArray, width: int) -> np.ndarray:
        if pc.all(pc.equal(pc.list_value_length(column), width)).as_py():
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.float64).reshape(-1, width)
        else:
            given = [np.asarray(v, np.float64)[:width] for v in column.to_pylist()]
            x = np.stack([np.pad(v, (0, width - len(v))) for v in given])
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(there: pa.Table, wanted: pa.Table) -> pa.Table:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(there) and len(wanted):
            ids, numbers = np.array(there.column("id").to_pylist()), wanted.column("id").to_pylist()
            width = pc.max(pc.list_value_length(wanted.column("vector"))).as_py()
            floor = wanted.column("floor").to_numpy() if floored else np.full(len(wanted), np.nan)
            x, y = unit(there.column("vector"), width), unit(wanted.column("vector"), width)
            most = np.unique(ids, return_counts=True)[1].max()  # rows of one id, which are no answer to its question
            step = max(1, min(AT_ONCE, AT_ONCE * BLOCK // len(ids)))
            for first in range(0, len(numbers), step):
                scores = y[first : first + step] @ x.T
                np.round(scores, 6, out=scores)
                scores += 0.0
                least = at_least(scores, k if own else k + int(most))
                if least is not None:
                    least = np.fmax(least, floor[first : first + step])
                for j, number in enumerate(numbers[first : first + step]):
                    at = np.arange(len(ids)) if least is None else np.flatnonzero(scores[j] >= least[j])
                    at = at if own else at[ids[at] != number]
                    if len(at) > k:
                        at = at[scores[j, at] >= np.partition(scores[j, at], len(at) - k)[len(at) - k]]
                    at = at[np.lexsort((ids[at], -scores[j, at]))[:k]]
                    best.append((np.full(len(at), first + j), at, scores[j, at]))
        query, at, score = (np.concatenate(b) for b in zip(*best, strict=True))
        take = lambda table, n: table.column("id").take(pa.array(n, pa.int64()))
        return pa.table({"query_id": take(wanted, query), id_col: take(there, at), "score": pa.array(score, pa.float64())})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id {query_kind}, {id_col} {kind}, score double")


def term_frequencies(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, length, term, tf. The inverted index: worth keeping as a table partitioned by term if many questions are asked."""
    split = docs.select(id_col, tokens(F.col(text)).alias("_t"))
    return split.select(id_col, F.size("_t").alias("length"), F.explode("_t").alias("term")).groupBy(id_col, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """term, df over the different tokens of each document."""
    return docs.select(id_col, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def fuse(rankings: DataFrame, query: list[str], id_col: str) -> DataFrame:
    """Reciprocal rank fusion of rows (query, id, rank), one per strategy: query, id, score."""
    return rankings.groupBy(*query, id_col).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))


def rerank(facts: DataFrame, query: list[str], k: int = FINAL, per_episode: int = PER_EPISODE) -> DataFrame:
    """facts (query, fact_id, score, valid_to, occurred_at, title) by score, current before closed, newest first, at most so many of one
    title; rank from 1. As rows are visited in rank order, the cap of a greedy loop is a rank within the title."""
    order = [F.desc("score"), F.col("valid_to").isNull().desc(), F.desc("occurred_at"), F.col("fact_id")]
    in_title = F.row_number().over(Window.partitionBy(*query, F.coalesce("title", F.lit("?"))).orderBy(*order))
    return top(facts.withColumn("_in", in_title).where(F.col("_in") <= per_episode).drop("_in"), query, order, k)
