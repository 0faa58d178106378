"""Centroid clustering in whole numbers (operator 13): float32 screening with error bounds that are proven, exact distances where they overlap.

Each vector's components become floor(scale * x). The first centroids are the vectors whose ids hash least; each round assigns every vector to
its nearest centroid (squared Euclidean distance, ties: smaller number) and puts every centroid that has any at the floor of their mean.

A batch meets all centroids in one float32 product. |c|^2 - 2 x.c orders centroids as distances do, and however the product is summed, x.c is wrong by at
most (d + 2) u / (1 - (d + 2) u) |x| |c|, u = 2^-24, d components (two for rounding x and c themselves). So each centroid has an interval that holds the true value;
a centroid whose interval lies wholly above another's is not the nearest. Where several are left, their distances are counted in 64-bit integers.
The result is therefore that of exact arithmetic, whatever the processor does.

The table is read once for each round; what leaves a task is a sum for each centroid. Centroids (clusters times components, no matter how many rows) are sent to
every task.

Nulls and edges: vectors null, of another length or with null or non-finite components take no part. A null id hashes as the word null. Repeated ids and
vectors are rows of their own; of equal hashes the lesser vector is first. Fewer rows than clusters: a centroid for each. A component beyond LARGEST stops with an error, as distances
would pass 64 bits. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolore.llm.common import cut, given_back

#: Components beyond it could make squared distances that no long holds.
LARGEST = 1 << 27
#: Rows that meet the centroids at once.
AT_ONCE = 8192


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """Rows id, vec (array<double>) of dim finite components."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where((F.size("vec") == dim) & ~bad)


def whole(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST}: squared distances would not be exact in 64 bits")
    return x.astype(np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, exact."""
    apart = x - c
    return np.einsum("ij,ij->i", apart, apart)


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest that |c|^2 - 2 x.c can be, for each row of x and each of c."""
    gamma = (x.shape[1] + 2) * 2.0**-24
    gamma /= 1 - gamma
    squares = np.einsum("ij,ij->i", c, c).astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))
    middle = squares - 2.0 * (x.astype(np.float32) @ c.astype(np.float32).T)
    # The bound itself and middle are doubles: a millionth more than covers how these are rounded.
    error = 2 * gamma * (1 + 1e-6) * np.outer(length, np.sqrt(squares)) + 2.0**-50 * (squares + np.abs(middle))
    return middle - error, middle + error


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of the nearest of c for each row of x, ties to the smaller; and how many rows the screening left open."""
    low, high = intervals(x, c)
    left = low <= high.min(axis=1, keepdims=True)
    best = left.argmax(axis=1)
    open_rows = np.flatnonzero(left.sum(axis=1) > 1)
    if len(open_rows):
        row, number = np.nonzero(left[open_rows])
        exact = np.full((len(open_rows), len(c)), np.iinfo(np.int64).max)
        exact[row, number] = distances(x[open_rows[row]], c[number])
        best[open_rows] = exact.argmin(axis=1)  # the first of equals
    return best, len(open_rows)


def first_centroids(rows: DataFrame, clusters: int, seed: int, scale: int) -> np.ndarray:
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    found = rows.select(named.alias("hash"), "vec").orderBy("hash", "vec").limit(clusters).toArrow().sort_by("hash")
    # Equal hashes keep the order of their vectors: sort_by is stable only on some versions, so both keys are sorted here.
    given = sorted(zip(found.column("hash").to_pylist(), found.column("vec").to_pylist(), strict=True))
    return whole(pa.array([v for _, v in given], pa.list_(pa.float64())), len(given[0][1]), scale) if given else np.zeros((0, 1), np.int64)


def moved(rows: DataFrame, c: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after a round: floors of means of the rows nearest to each; those without rows stay."""
    dim = c.shape[1]

    @given_back
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for batch in batches:
            x = whole(batch.column(0), dim, scale)
            for start in range(0, len(x), AT_ONCE):
                own = x[start : start + AT_ONCE]
                at, _ = nearest(own, c)
                order = np.argsort(at, kind="stable")
                numbers, firsts = np.unique(at[order], return_index=True)
                total[numbers] += np.add.reduceat(own[order], firsts, axis=0)
                n += np.bincount(at, minlength=len(c))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = rows.select("vec").mapInArrow(sums, "cluster int, n long, total array<long>")
    counted = parts.select("cluster", F.posexplode("total").alias("at", "x"), "n").groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = c.copy()
    for r in counted.collect():  # a number for each centroid and component
        out[r["cluster"], r["at"]] = r["x"] // r["n"]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, clusters: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """Rows vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>) for every usable vector."""
    rows = usable(vectors, id_col, vec_col, dim)
    kind = vectors.schema[id_col].dataType.simpleString()
    c = first_centroids(rows, clusters, seed, scale)
    if not len(c):
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        c = moved(rows, c, scale)

    @given_back
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(1), dim, scale)
            at = np.concatenate([np.zeros(0, np.int64), *(nearest(x[i : i + AT_ONCE], c)[0] for i in range(0, len(x), AT_ONCE))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(distances(x, c[at]), pa.int64())], names=["vec_id", "cluster", "distance"])

    placed = cut(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    within = dict.fromkeys(range(len(c)), 0) | {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    known = placed.sparkSession.createDataFrame([(i, d, sum(within.values()), c[i].tolist()) for i, d in within.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def with_digest(placed: DataFrame) -> DataFrame:
    """The centroid as its components in decimal, joined by commas, hashed."""
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return placed.withColumn("centroid_sha256", F.sha2(text, 256)).drop("centroid")


def digest(c: np.ndarray) -> str:
    """with_digest() of one centroid."""
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
