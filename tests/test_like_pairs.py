"""Like pairs by pivots against all pairs: the same rows, with far fewer meetings where vectors lie in clusters."""

import datetime as dt

import numpy as np
import pytest

from chronolore.operators import supersede

SCHEMA = "fact_id string, type string, statement string, occurred_at timestamp, embedding array<double>, seq long"
START = dt.datetime(2026, 1, 1)


def rows_of(vectors, types=1, minutes=1):
    return [(f"f{i}", f"t{i % types}", "s", START + dt.timedelta(minutes=i // minutes), None if v is None else [float(x) for x in v], i) for i, v in enumerate(vectors)]


def clustered(n, clusters, dim=16, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * spread


def plain(rows, least):
    out = set()
    kept = [r for r in rows if r[4]]
    for a in kept:
        for b in kept:
            if a[1] == b[1] and b[3] < a[3] and len(a[4]) == len(b[4]):
                x, y = np.array(a[4]), np.array(b[4])
                lengths = np.linalg.norm(x) * np.linalg.norm(y)
                if round(float(x @ y / lengths) if lengths else 0.0, 9) >= least:
                    out.add((a[0], b[0]))
    return out


def found(spark, rows, least, tile, block=None):
    got = supersede.like_pairs(spark.createDataFrame(rows, SCHEMA), least, block, tile).select("newer", "older").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("tile", [7, 40, 4096])
@pytest.mark.parametrize("least", [0.1, 0.8, 0.99])
def test_same_pairs_as_all_pairs(spark, tile, least):
    rng = np.random.default_rng(4)
    vectors = [*clustered(120, 6, 5), *rng.normal(size=(40, 5)), *([[1.0, 2, 3, 4, 5]] * 15), None, [], [0.0] * 5, [0.0] * 5, [1.0, 2.0], [2.0, 4.0]]
    rows = rows_of(vectors, types=2, minutes=2)
    assert found(spark, rows, least, tile) == plain(rows, least)


def test_no_bound_below_zero(spark):
    rows = rows_of([*np.random.default_rng(1).normal(size=(40, 3)), [0.0] * 3])
    assert found(spark, rows, -0.5, 5) == plain(rows, -0.5)


def test_one_statement_holds_most_rows(spark):
    rows = rows_of([*([[3.0, 4.0, 0.0]] * 60), *np.random.default_rng(2).normal(size=(60, 3))])
    assert found(spark, rows, 0.9, 10) == plain(rows, 0.9)


def test_empty(spark):
    assert found(spark, [], 0.8, 10) == set()
    assert supersede.pairs_met(spark.createDataFrame([], SCHEMA)).count() == 0


def test_meetings_grow_slower_than_pairs(spark):
    """Clusters of about 25 facts each: the share of pairs that meet falls as the table grows."""
    shares = []
    for n in (500, 1000, 2000):
        rows = rows_of(clustered(n, n // 25))
        r = supersede.pairs_met(spark.createDataFrame(rows, SCHEMA), 0.8, tile=50).first()
        assert r["possible"] == n * (n - 1) // 2
        shares.append(r["met"] / r["possible"])
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.2, shares
