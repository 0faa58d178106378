"""Operator 13 against exact arithmetic on the driver; the bounds of the screening; its edges."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SF

from chronolore.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, extra string, distance int"


def plain(rows, dim=64, clusters=16, rounds=3, scale=64):
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in hashed[:clusters]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[nearest(v)].append(v)
        c = [tuple(sum(x) // len(o) for x in zip(*o, strict=True)) if o else before for o, before in zip(own, c, strict=True)]
    out = [(i, nearest(v), far(v, c[nearest(v)]), hashlib.sha256(",".join(map(str, c[nearest(v)])).encode()).hexdigest()) for i, v in kept]
    within = [sum(d for _, j, d, _ in out if j == n) for n in range(len(c))]
    return sorted(((i, j, d, within[j], sum(within), h) for i, j, d, h in out), key=str)


def got(df):
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[c] for c in columns) for r in centroids.with_digest(df).collect()), key=str)


def given(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


def test_against_plain(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got(centroids.cluster(rows)) == plain(given(rows))


@pytest.mark.parametrize(("clusters", "rounds", "scale"), [(1, 2, 64), (5, 0, 1), (40, 4, 3)])
def test_other_parameters(spark, clusters, rounds, scale):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(120)
    assert got(centroids.cluster(rows, clusters=clusters, rounds=rounds, scale=scale)) == plain(given(rows), clusters=clusters, rounds=rounds, scale=scale)


def test_traps(spark):
    rng = np.random.default_rng(2)
    near = rng.integers(-2, 3, (60, 3)) / 2  # many ties, and repeated vectors
    rows = [(i % 50, [float(x) for x in v], "x", 1) for i, v in enumerate(near)]
    rows += [(90, None, None, None), (91, [1.0, None, 2.0], "x", 1), (92, [1.0, float("nan"), 2.0], "x", 1), (93, [float("inf"), 0.0, 0.0], "x", 1), (94, [], "x", 1), (95, [1.0, 2.0], "x", 1), (None, [0.5, 0.5, -0.5], "x", 1), (None, [0.0, 0.0, 0.0], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for clusters in (4, 16, 200):
        assert got(centroids.cluster(df, dim=3, clusters=clusters, scale=2)) == plain([r[:2] for r in rows], dim=3, clusters=clusters, scale=2)
    for none in (df.limit(0), df.where("vec_id > 89")):
        assert centroids.cluster(none, dim=3).count() == 0


def test_equal_vectors_go_to_the_smaller_number(spark):
    df = spark.createDataFrame([(i, [1.0, -1.0], None, None) for i in range(30)], SCHEMA)
    assert {r["cluster"] for r in centroids.cluster(df, dim=2).collect()} == {0}


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], None, None)], SCHEMA)
    with pytest.raises(Exception, match="would not be exact"):
        centroids.cluster(df, dim=2).collect()


@pytest.mark.parametrize("size", [3, 100, 1 << 24, 1 << 27])
def test_intervals_hold_the_truth(size):
    """Where float32 can't tell centroids apart, the exact distance decides."""
    rng = np.random.default_rng(size)
    x = rng.integers(-size, size + 1, (300, 64))
    c = np.concatenate([x[:20], x[:20] + rng.integers(-1, 2, (20, 64)), rng.integers(-size, size + 1, (20, 64))]).clip(-size, size)
    low, high = centroids.intervals(x, c)
    true = [[sum(int(b) ** 2 for b in v) - 2 * sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in c] for u in x[:50]]
    for i, own in enumerate(true):
        assert all(low[i, j] <= t <= high[i, j] for j, t in enumerate(own))
    exact = np.array([centroids.distances(x, np.broadcast_to(v, x.shape)) for v in c]).T
    best, open_rows = centroids.nearest(x, c)
    assert (best == exact.argmin(axis=1)).all() and open_rows >= (20 if size > 1 << 20 else 0)


def test_most_rows_need_no_second_look(spark):
    x = np.array([[math.floor(64 * float(a)) for a in r["embedding"]] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    _, open_rows = centroids.nearest(x, x[:16])
    assert open_rows < 0.02 * len(x)
