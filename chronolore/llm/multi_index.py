"""Approximate nearest neighbours by multi-index hashing (operator 5).

Codes: on a bounded sample (SAMPLE rows, those with the least hash of id) the mean is taken off, the TURNED principal axes are found, and
rotations of them, each from a random start, are learned that bring the projections near the corners of a cube (iterative quantisation:
alternate signs and an orthogonal Procrustes fit). Signs are bits; a rotation's bits make as many codes as fit into it. For inner products of
vectors of unlike length, a component sqrt(longest^2 - length^2) is added to rows and 0 to queries, which makes the nearest angle the
greatest product.

Index: a code of b bits is split into substrings; each has a table of the rows by its value. A query that looks for all codes within
radius r looks into each table at the values within t bits of its own, where the t of all substrings plus one each add up to r + 1:
by the pigeonhole principle a code within r bits is within t in one of the substrings. What the tables give is all that is looked at:
no query meets a row that it shares no probed value with. Rows found are kept if the whole code is within r, and what several codes or tables
give counts once. These rows are scored by the vectors themselves in double precision.

Setting: how many codes, of how many bits and with which radius, is learned. For JUDGES rows of the table the true neighbours are found
by an exact pass over all rows; of the settings that reach RECALL of these pairs (each pair by any of the codes) the one is taken with the least
work by its numbers of look-ups, of rows looked up and of rows scored. The larger the table, the nearer are neighbours and the smaller is
the radius that is needed, so the share of the table that a query looks at falls. Where nothing short of everything reaches RECALL (small
tables), the radius is the whole code and all rows are scored.

A query that finds fewer than k rows asks again with the radius of the whole code, so k rows always come back where there are k.

Nulls and edges: see vector_blocks.usable(); zero vectors take no part; vectors of different lengths are different tables. Rows with the
query's own id are not its candidates; a repeated id is one query, its rows are rows. Other columns are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolore.llm.common import cut
from chronolore.llm.vector_blocks import by_length, first_k, queries_of, search, usable

SAMPLE, JUDGES, TURNED, ROTATIONS, RECALL = 4096, 96, 64, 16, 0.95
#: Code lengths that are tried, each in two substrings.
LENGTHS = (16, 20, 24, 28)
#: What a look-up, a row looked up and a row scored cost, in nanoseconds or so.
LOOK_UP, LOOKED_UP, SCORED = 12, 20, 250


@dataclass
class Codes:
    """mean and planes (columns, a rotation's side by side) make bits; the first `number` codes of `bits` bits are used, within `radius`."""

    mean: np.ndarray
    planes: np.ndarray
    longest: float
    turned: int
    bits: int = 0
    number: int = 1
    radius: int = 0
    #: Shares of the sample: looked up, scored; and the recall of the judges' pairs.
    measured: dict[str, float] = field(default_factory=dict)

    def raised(self, x: np.ndarray, query: bool) -> np.ndarray:
        """x with the component that makes rows equally long."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack([x, more])

    def places(self, bits: int) -> list[np.ndarray]:
        """The columns of planes of each code of so many bits."""
        per, rotations = max(1, self.turned // bits), self.planes.shape[1] // max(1, self.turned)
        return [r * self.turned + np.arange(c * bits, min((c + 1) * bits, self.turned)) for r in range(rotations) for c in range(per)]

    def of(self, x: np.ndarray, query: bool, bits: int, number: int) -> np.ndarray:
        """Codes x rows: whole numbers of so many bits."""
        x = self.raised(x, query) - self.mean
        out = np.zeros((number, len(x)), np.uint32)
        for n, at in enumerate(self.places(bits)[:number]):
            out[n] = (x @ self.planes[:, at] > 0) @ (1 << np.arange(len(at), dtype=np.uint32))
        return out


def learn(sample: np.ndarray, longest: float, rounds: int = 8, seed: int = 5) -> Codes:
    """Learns the rotations from a sample."""
    rng, width = np.random.default_rng(seed), sample.shape[1] + 1
    codes = Codes(np.zeros(width), np.zeros((width, 0)), longest, 1)
    x = codes.raised(sample, False)
    codes.mean = x.mean(axis=0)
    x = x - codes.mean
    axes = np.linalg.svd(x, full_matrices=False)[2].T[:, :TURNED]
    codes.turned, v = axes.shape[1], x @ axes
    planes = []
    for _ in range(ROTATIONS):
        turn = np.linalg.qr(rng.normal(size=(codes.turned,) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ turn > 0, 1.0, -1.0), full_matrices=False)
            turn = u @ w
        planes.append(axes @ turn)
    codes.planes = np.concatenate(planes, axis=1)
    return codes


def radii(bits: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each of the two substrings; a radius of -1 is no probe."""
    half = bits // 2
    return [(0, half, (radius + 2) // 2 - 1), (half, bits - half, (radius + 1) // 2 - 1)]


@lru_cache
def probes(bits: int, radius: int) -> np.ndarray:
    """The numbers of so many bits with at most radius of them set."""
    flips = [sum(1 << b for b in c) for r in range(min(radius, bits) + 1) for c in itertools.combinations(range(bits), r)]
    return np.array(flips, np.uint32)


def choose(codes: Codes, queries: np.ndarray, near: np.ndarray, which: np.ndarray, sample: np.ndarray, rows: int) -> None:
    """Sets bits, number and radius by the true pairs (queries[which], near) of a table of so many rows."""
    best = None
    for bits in sorted({min(b, codes.turned) for b in LENGTHS}):
        number = len(codes.places(bits))
        asked = codes.of(queries, True, bits, number)
        far = np.bitwise_count(asked[:, which] ^ codes.of(near, False, bits, number))
        any_far = np.bitwise_count(asked[:, :, None] ^ codes.of(sample[:512], False, bits, number)[:, None, :])
        for radius in range(bits + 1):
            # Once the two substrings are probed whole, a greater radius means the whole code.
            radius = bits if radius > bits // 2 else radius
            reached = np.maximum.accumulate(far <= radius, axis=0).mean(axis=1)
            scored = np.maximum.accumulate(any_far <= radius, axis=0).mean(axis=(1, 2))
            looks = [(sum(comb(n, i) for i in range(min(t, n) + 1)), n) for _, n, t in radii(bits, radius)]
            use = int(np.argmax(reached >= RECALL)) if (reached >= RECALL).any() else None
            if use is not None:
                up, rows_up = sum(a for a, _ in looks) * (use + 1), sum(a / 2**n for a, n in looks) * (use + 1)
                cost = up * LOOK_UP * max(1, rows / 32_768) + rows * (rows_up * LOOKED_UP + scored[use] * SCORED)
                if best is None or cost < best[0]:
                    best = (cost, bits, use + 1, radius, {"recall": float(reached[use]), "looked_up": rows_up, "scored": float(scored[use])})
            if radius == bits:
                break
    _, codes.bits, codes.number, codes.radius, codes.measured = best


def found_by_tables(row_codes: np.ndarray, query_codes: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """Sorted numbers query * rows + row of all codes within the radius (codes x rows, codes x queries), by look-ups in tables of substrings."""
    n = row_codes.shape[1]
    found = np.zeros(query_codes.shape[1] * n, bool)  # so that what several tables give counts once
    for own, asked in zip(row_codes, query_codes, strict=True):
        for first, width, reach in radii(bits, radius):
            if reach < 0:
                continue
            part = (own >> np.uint32(first)) & np.uint32((1 << width) - 1)
            order = np.argsort(part, kind="stable")
            starts = np.searchsorted(part[order], np.arange((1 << width) + 1, dtype=np.int64))
            values = ((asked >> np.uint32(first)) & np.uint32((1 << width) - 1))[:, None] ^ probes(width, reach)
            low, counts = starts[values], starts[values + 1] - starts[values]
            query = np.repeat(np.arange(len(asked)), counts.sum(axis=1))
            counts = counts.ravel()
            ends = np.cumsum(counts)
            row = order[np.repeat(low.ravel() - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
            within = np.bitwise_count(asked[query] ^ own[row]) <= radius
            found[query[within] * n + row[within]] = True
    return np.flatnonzero(found)


def nearest(codes: Codes, k: int, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row_codes, query_codes = codes.of(rows, False, codes.bits, codes.number), codes.of(queries, True, codes.bits, codes.number)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    at_once = max(1, (1 << 22) // len(rows))
    for first in range(0, len(queries), at_once):
        query, row = np.divmod(found_by_tables(row_codes, query_codes[:, first : first + at_once], codes.bits, codes.radius), len(rows))
        other = ids[row] != query_ids[first + query]
        query, row = first + query[other], row[other]
        cuts = np.searchsorted(query, np.arange(first, min(first + at_once, len(queries)) + 1))
        for i, (a, b) in enumerate(itertools.pairwise(cuts), first):
            found = row[a:b]
            products = rows[found] @ queries[i]
            if len(found) > k:  # rounding differs by place in a matrix product; what is near the k-th is summed again, row by row
                found = found[products >= np.partition(products, len(found) - k)[len(found) - k] - 1e-9 * (1 + np.abs(products).max())]
            scores = (rows[found] * queries[i]).sum(axis=1)
            best = first_k(scores, ids[found], k)
            out.append((np.full(len(best), i), found[best], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def everything(k: int, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exact pass for a few queries."""
    out = []
    for i, query in enumerate(queries):
        found = np.flatnonzero(ids != query_ids[i])
        scores = rows[found] @ query
        best = first_k(scores, ids[found], k)
        out.append((np.full(len(best), i), found[best], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def learned(rows: DataFrame, k: int) -> Codes | None:
    """Codes and setting for a table (id, vec); None for an empty one."""
    longest, n = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), F.count(F.lit(1))).first()
    if not n:
        return None
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample = np.array([r["vec"] for r in picked])
    codes = learn(sample, float(np.sqrt(longest)))
    asked = {r["id"]: r["vec"] for r in reversed(picked[:JUDGES])}
    judges = rows.sparkSession.createDataFrame(list(asked.items()), "id long, vec array<double>")
    pairs = cut(search(rows, judges, lambda *a: everything(k, *a), k, "double").select("query_id", "vec_id"))
    # A repeated id is one vector here: JUDGES * k ids at most come back.
    vectors = {r["id"]: r["vec"] for r in queries_of(rows.join(F.broadcast(pairs.select(F.col("vec_id").alias("id")).distinct()), "id", "left_semi"), "true").collect()}
    number = {q: i for i, q in enumerate(asked)}
    true = [(number[r["query_id"]], vectors[r["vec_id"]]) for r in pairs.collect()]
    queries = np.array(list(asked.values()))
    near = np.array([v for _, v in true]).reshape(len(true), sample.shape[1]) if true else queries
    which = np.array([i for i, _ in true], np.int64) if true else np.arange(len(queries))
    choose(codes, queries, near, which, sample, n)
    return codes


def search_nearest(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows query_id, rank, vec_id, score: the k greatest inner products found for each row for which is_query (of id) holds."""
    parts = []
    for rows in by_length(usable(vectors, id_col, vec_col, allow_zero=False)):
        queries, codes = queries_of(rows, is_query), learned(rows, k)
        ask = lambda asked, c, rows=rows: search(rows, asked, lambda *a: nearest(c, k, *a), k, "double")
        if codes is None:
            return search(rows, queries, lambda *a: everything(k, *a), k, "double")
        if codes.radius == codes.bits:
            parts.append(ask(queries, codes))
            continue
        first = cut(ask(queries, codes))
        full = first.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
        short = cut(queries.join(full, "id", "left_anti"))
        whole = Codes(codes.mean, codes.planes, codes.longest, codes.turned, codes.bits, 1, codes.bits)
        parts.append(first if short.isEmpty() else first.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(*first.columns).unionByName(ask(short, whole)))
    return reduce(DataFrame.unionByName, parts)
