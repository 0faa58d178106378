"""Exact top-k inner products by an impact-ordered, score-at-a-time index (operator 6).

Components become whole numbers floor(scale * x). The index of a block holds, for each component, the rows in order of their value, cut
into segments of equal quantised value (LEVELS steps over the component's range). For a query q the impact of a posting is
q[d] * value - (the least such product in the block): never negative, and least products add up to a floor all rows share.

A query takes segments of all components in the order of descending impact bound, in rounds. After each, a row's sum of impacts so far is
a lower bound of its score, and that sum plus what the next segments of all components can still add is an upper bound. The search stops
only on that proof: rows whose upper bound is below the k-th lower bound can't be among the best. The possible members left
are scored again exactly, in 64-bit integers, which the final order is taken from. If the proof never comes, all segments are read.

Numbers: sums of products are whole. Where the greatest sum that a block's numbers allow is below 2^53, impacts are summed as doubles, which is
exact; else all rows are possible members and are scored in 64-bit integers. A table in which a score could pass 2^63 stops the
query with an error (a score is a long).

Nulls and edges: see vector_blocks.usable(); zero vectors take part; vectors of different lengths are different tables. Rows with the
query's own id are not its candidates; a repeated id is one query, its rows are rows. Other columns are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolore.llm.vector_blocks import by_length, first_k, queries_of, search, usable

LEVELS, ROUNDS = 32, 12
#: A round of rescoring costs as much as reading this share of the postings.
POSSIBLE_SHARE = 32


class Index:
    """Postings of one block, by component and descending value, with the places where segments start."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.n, self.dims = rows, *rows.shape
        self.order = np.ascontiguousarray(np.argsort(-rows, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(rows.T, self.order, axis=1)
        high, low = self.values[:, 0], self.values[:, -1]
        self.step = np.maximum((high - low + LEVELS) // LEVELS, 1)
        # starts[d, s] is the first posting of segment s; segment s holds values from top[d, s] down to bottom[d, s].
        level = (high[:, None] - self.values) // self.step[:, None]
        self.starts = np.stack([np.searchsorted(level[d], np.arange(LEVELS + 1)) for d in range(self.dims)])
        edge = np.arange(LEVELS)
        self.top = high[:, None] - edge * self.step[:, None]
        self.bottom = np.maximum(self.top - self.step[:, None] + 1, low[:, None])

    def possible(self, query: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Places of all rows that may be among the k best for the query; own marks rows that are not candidates."""
        least = np.minimum(query * self.values[:, 0], query * self.values[:, -1])
        bound = np.maximum(query[:, None] * self.top, query[:, None] * self.bottom) - least[:, None]
        backward = query < 0  # the greatest impacts are then at the end of the postings
        bound[backward] = bound[backward][:, ::-1]
        bound = np.minimum.accumulate(np.maximum(bound, 0), axis=1)
        # Rounds end at falling impact bounds, so that each reads about as many postings.
        sizes = np.diff(self.starts, axis=1)
        sizes[backward] = sizes[backward][:, ::-1]
        by_impact = np.argsort(-bound, axis=None, kind="stable")
        read = np.cumsum(sizes.ravel()[by_impact])
        ends = np.searchsorted(read, read[-1] * np.arange(1, ROUNDS + 1) / ROUNDS)
        sums, done = np.zeros(self.n), np.zeros(self.dims, np.int64)
        candidates = np.flatnonzero(~own)
        for end in ends:
            count = np.bincount(by_impact[: end + 1] // LEVELS, minlength=self.dims)
            new, added = [], []
            for d in np.flatnonzero(count > done):
                a, b = (self.starts[d, LEVELS - count[d]], self.starts[d, LEVELS - done[d]]) if backward[d] else (self.starts[d, done[d]], self.starts[d, count[d]])
                new.append(self.order[d, a:b])
                added.append(query[d] * self.values[d, a:b] - least[d])
            done = np.maximum(done, count)
            if new:
                sums += np.bincount(np.concatenate(new), np.concatenate(added), self.n)  # whole numbers far below 2^53: exact
            ahead = np.where(done < LEVELS, np.take_along_axis(bound, np.minimum(done, LEVELS - 1)[:, None], axis=1)[:, 0], 0).sum()
            if len(candidates) > k:
                at = sums[candidates]
                candidates = candidates[at + ahead >= np.partition(at, len(at) - k)[len(at) - k]]
            if len(candidates) <= max(4 * k, self.n // POSSIBLE_SHARE):
                break
        return candidates


def whole_number(x: Column) -> Column:
    """floor(x) as double; doubles from 2^53 on are whole already, and floor() as a long would clip them."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def best(k: int, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, queries = rows.astype(np.int64), queries.astype(np.int64)
    # An impact is a difference of two products, so its sums are within twice those of products.
    small = 2.0 * rows.shape[1] * float(np.abs(rows).max()) * float(np.abs(queries).max()) < 2.0**53
    index, out = Index(rows), []
    for i, query in enumerate(queries):
        own = ids == query_ids[i]
        found = index.possible(query, own, k) if small else np.flatnonzero(~own)
        scores = rows[found] @ query
        top = first_k(scores, ids[found], k)
        out.append((np.full(len(top), i), found[top], scores[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def exact_top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows query_id, rank, vec_id, score (long): the k greatest inner products for each row for which is_query (of id) holds."""
    parts = []
    for rows in by_length(usable(vectors, id_col, vec_col, allow_zero=True)):
        whole = rows.select("id", F.transform("vec", lambda x: whole_number(x * scale)).alias("vec"))
        greatest, n = whole.agg(F.max(F.array_max(F.transform("vec", F.abs))), F.max(F.size("vec"))).first()
        if greatest is not None and n * greatest * greatest >= 2.0**63:
            raise ValueError(f"components up to {greatest:g} over {scale} in {n} dimensions: a score could pass 64 bits")
        parts.append(search(whole, queries_of(whole, is_query), lambda *a: best(k, *a), k, "long"))
    return reduce(DataFrame.unionByName, parts)
