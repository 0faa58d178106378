"""Versions as a stream: late facts take back what was told, and the end is that of a batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronolore.streaming import restated

HOUR, START = 3600, 1_700_000_000


@pytest.fixture
def store(spark):
    with restated.store_in_use(spark):
        yield


def streamed(spark, tmp_path, batches, late):
    """The changes after each of the batches (lists of key, fact_id, second), and the last state's rows."""
    source, kept = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    stream = spark.readStream.schema("key string, fact_id string, at timestamp").parquet(str(source))
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "key string, fact_id string, s long").select("key", "fact_id", F.timestamp_seconds("s").alias("at"))
        df.coalesce(1).write.mode("append").parquet(str(source))
        told = restated.changes(stream, late).writeStream.format("parquet").option("path", str(kept)).option("checkpointLocation", str(tmp_path / "state"))
        told.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "open").load()
    return spark.read.schema(restated.CHANGES).parquet(str(kept)), state


def plain(facts):
    """Sorted once, each until the next of its key."""
    out = set()
    for key in {f[0] for f in facts}:
        own = sorted({(s, i) for k, i, s in facts if k == key})
        for (s, i), (to, by) in zip(own, [*own[1:], (None, None)], strict=True):
            out.add((key, i, s * 10**6, None if to is None else to * 10**6, by))
    return out


def test_late_fact_takes_back(spark, tmp_path, store):
    batches = [[("k", "a", 10), ("k", "c", 30)], [("k", "b", 20)]]
    told, _ = streamed(spark, tmp_path, batches, "1 hour")
    rows = sorted((r.fact_id, r.change, r.to_us, r.superseded_by) for r in told.where("fact_id = 'a'").collect())
    assert rows == [("a", -1, 30 * 10**6, "c"), ("a", 1, 20 * 10**6, "b"), ("a", 1, 30 * 10**6, "c")]
    assert {tuple(r) for r in restated.settled(told).collect()} == plain([f for b in batches for f in b])


def test_shuffled_stream_ends_at_the_batch(spark, tmp_path, store):
    draw = random.Random(4)
    facts = [(draw.choice([None, "a", "b", "hot", "hot", "hot"]), f"f{i:03d}", START + draw.randrange(60) * 60) for i in range(120)]
    draw.shuffle(facts)
    batches = [facts[i::4] + facts[:5] for i in range(4)]  # some come again
    told, _ = streamed(spark, tmp_path, batches, "2 hours")
    assert {tuple(r) for r in restated.settled(told).collect()} == plain(facts)
    assert told.where("change < 0").count() > 20


def test_state_is_what_may_still_change(spark, tmp_path, store):
    """Facts an hour apart, each batch a little out of order, lateness two hours: at the end only the last few are held, the quiet key's one."""
    batches = [[("quiet", "q0", START), ("quiet", "q1", START + HOUR)]] + [[("k", f"f{n + d:02d}", START + (n + d) * HOUR) for d in (1, 0)] for n in range(0, 12, 2)]
    told, state = streamed(spark, tmp_path, batches, "2 hours")
    assert {tuple(r) for r in restated.settled(told).collect()} == plain([f for b in batches for f in b])
    held = sorted((r.key.key, r.map_key.fact_id) for r in state.selectExpr("key", "user_map_key AS map_key").collect())
    assert [i for k, i in held if k == "quiet"] == ["q1"]
    assert len([i for k, i in held if k == "k"]) <= 5
