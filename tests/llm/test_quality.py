"""Operator 11: held-out accuracy, statistics and calibration against plain versions, and its edges."""

import math
import zlib

import numpy as np
import pytest
from conftest import SF, documents

from chronolore.llm import quality

LABELS = "doc_id long, quality int, toxic int, extra string"


def tables(spark, sf="0.01"):
    return (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_statistics():
    got = dict(zip(quality.STATISTICS, quality.statistics(b"A a a b!\n\nA a a b!\nx | y#\n"), strict=True))
    assert got["words"] == pytest.approx(math.log1p(11)) and got["lines"] == pytest.approx(math.log1p(3))
    assert got["again"] == pytest.approx(2 / 11) and got["commonest_word"] == pytest.approx(4 / 11) and got["repeated_lines"] == pytest.approx(1 / 3)
    assert got["worst_again"] == pytest.approx(1 / 4) and got["worst_symbols"] == pytest.approx(2 / 6) and got["one_byte_words"] == pytest.approx(8 / 11)
    assert quality.statistics(None) == quality.statistics(b"") == quality.statistics(b" \n\t ") == [0.0] * len(quality.STATISTICS)


def test_statistics_of_a_long_text(monkeypatch):
    """Words that are listed a block at a time count as if they were listed at once."""
    line = b"ab ab cd " * 5000
    want = quality.statistics(line)
    real = quality.words_in_blocks
    monkeypatch.setattr(quality, "words_in_blocks", lambda text: real(text, 64))
    assert quality.statistics(line) == want


def test_features_are_a_gaussian_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, len(quality.STATISTICS))) * 0.5
    mean, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    z = quality.features(x, mean, scale, 1.0)[:, :-1] / quality.UNIT
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(2 * (z @ z.T) / quality.WIDTH - np.exp(-apart / (2 * x.shape[1]))).max() < 0.3


def test_pooled_is_isotonic_regression():
    rng = np.random.default_rng(5)
    x, n = np.arange(60.0), rng.integers(1, 9, 60).astype(float)
    ones = rng.binomial(n.astype(int), np.clip(x / 60, 0, 1)).astype(float)
    at, value = quality.pooled(x, ones, n)
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
    # The greatest over beginnings of the least share up to an end: what least squares under monotony gives.
    share = lambda a, b: ones[a : b + 1].sum() / n[a : b + 1].sum()
    want = sorted({round(max(min(share(a, b) for b in range(i, 60)) for a in range(i + 1)), 12) for i in range(60)})
    assert np.round(value, 12).tolist() == want


def test_equations_add_up(spark):
    docs, labels = tables(spark, "0.001")
    stats = quality.measured(docs)
    rows = stats.join(labels.select("doc_id", labels.quality.cast("double").alias("y")), "doc_id").selectExpr("x", "y", "cast(pmod(doc_id, 4) as int) AS part")
    mean, scale = np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS))
    sums = quality.equations(rows.repartition(3), mean, scale)
    given = rows.toPandas()
    for (k, p), got in sums.items():
        own = given[given["part"] == p]
        z = np.column_stack([quality.features(np.array(own["x"].tolist()), mean, scale, quality.LENGTHS[k]) / quality.UNIT, own["y"]])
        assert np.allclose(got, z.T @ z, rtol=0, atol=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    out = quality.rate(docs, labels).toPandas()
    assert sorted(out["doc_id"]) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]).all()
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    both = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert len(both) > 50 and (both["predicted"] == both["quality"]).mean() >= 0.97


def test_held_out_labels_are_not_learned(spark):
    """Turning every held-out label round changes no score."""
    docs, labels = tables(spark, "0.001")
    turned = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r["doc_id"]: r["score"] for r in quality.rate(docs, t).collect()} for t in (labels, turned))
    assert a == b


def test_edges(spark, traps):
    rows = documents()
    some = [(d, i % 2, 0, "x") for i, d in enumerate(sorted({r[0] for r in rows if r[0] is not None}))]
    for given in (some, [(d, 1, 0, None) for d, *_ in some], [*some, (None, 1, 1, None), (5, None, None, None), (3, 0, 0, None), (3, 1, 1, None)], []):
        out = quality.rate(traps, spark.createDataFrame(given, LABELS)).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["doc_id"] == 0}) == 1
    assert {r["score"] for r in out} == {0.5}
    assert quality.rate(traps.limit(0), spark.read.parquet(f"{SF}/labels.parquet")).count() == 0
