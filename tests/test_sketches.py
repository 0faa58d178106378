"""Percentiles and different members from sketches by day, against those of all rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from chronolore.operators import stats

SF = Path("/root/testdata/sf0.01")
SHARES = [0.5, 0.95, 0.99]


def sketched(spark, rows, tmp_path):
    """The sketches of each half of the days, written one after the other."""
    for n in (0, 1):
        half = rows.where(F.pmod(F.datediff(F.to_date("ts"), F.lit("2020-01-01")), F.lit(2)) == n)
        stats.daily_sketches(half, ["event_type"], "ts", "value", "user_id").write.mode("append").parquet(str(tmp_path / "days"))
    return spark.read.parquet(str(tmp_path / "days"))


def test_close_to_exact(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").cache()
    kept = sketched(spark, rows, tmp_path)
    got = {r["event_type"]: r for r in stats.from_sketches(kept, ["event_type"], SHARES).collect()}
    exact = {r["event_type"]: r for r in stats.percentiles(rows, ["event_type"], "value", SHARES).collect()}
    users = {r["event_type"]: r["n"] for r in rows.groupBy("event_type").agg(F.count_distinct("user_id").alias("n")).collect()}
    assert got.keys() == exact.keys()
    for kind, r in got.items():
        assert r["n"] == exact[kind]["n"] and abs(r["members"] - users[kind]) <= 0.05 * users[kind]
        for s in SHARES:
            below, upto = rows.where(F.col("event_type") == kind).agg(F.count_if(F.col("value") < r[f"p{round(100 * s)}"]), F.count_if(F.col("value") <= r[f"p{round(100 * s)}"])).first()
            assert below - 0.017 * r["n"] <= s * r["n"] <= upto + 0.017 * r["n"] + 1


def test_some_days_only(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    kept = sketched(spark, rows, tmp_path)
    day = kept.agg(F.min("day")).first()[0]
    want = rows.where(F.to_date("ts") == F.lit(day)).count()
    assert stats.from_sketches(kept.where(F.col("day") == F.lit(day)), [], SHARES).first()["n"] == want


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, None, None, None), ("a", "2024-01-01", None, None), ("a", "2024-01-01", 2.0, "u")], "kind string, at string, value double, who string")
    got = {r["kind"]: tuple(r)[1:] for r in stats.from_sketches(stats.daily_sketches(rows, ["kind"], "at", "value", "who"), ["kind"], [0.5]).collect()}
    assert got["a"] == (1, 2.0, 1) and got[None] == (0, None, 0)
    assert stats.from_sketches(stats.daily_sketches(rows.limit(0), ["kind"], "at", "value", "who"), ["kind"], [0.5]).count() == 0
