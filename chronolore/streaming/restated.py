"""Versions of facts as a stream that takes back what a late fact changes.

Each fact of a key holds from its moment until the next fact of the key. A fact that comes late cuts an interval that was already told:
that row is taken back (change -1), and two new ones are told (+1). settled() nets the changes to the versions that hold after all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "key string, fact_id string, from_us long, to_us long, superseded_by string, change int"
# Fixed value: the store of state that Spark asks for under its state processors.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = [part.split()[0] for part in CHANGES.split(", ")]
CHANGE = Row(*COLUMNS)

Fact = tuple[int, str]


def told(key: str, versions: list[Fact]) -> dict[Fact, tuple]:
    """The row of each version, in order of time and id; the last still holds (no end)."""
    ends: list[Fact | tuple[None, None]] = [*versions[1:], (None, None)]
    return {fact: (key, fact[1], fact[0], *end) for fact, end in zip(versions, ends, strict=False)}


class Versions(StatefulProcessor):
    """Takes and gives rows, as a key has a few of them and a pandas table for each would cost more than they do. State of a key: its facts that a late one may still stand before or after, i.e. those after the watermark and the last one up to it.
    A timer at the newest fact releases the others of a key that went quiet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "at_us long, fact_id string", "seen int")

    def release(self, facts: list[Fact], watermark_ms: int, timed: bool = True) -> None:
        """Forgets what no fact that still may come can meet, and sets the timer for the rest. A key that is new has no timer (timed) to take back."""
        passed = [f for f in facts if f[0] <= watermark_ms * 1000]
        for fact in passed[:-1]:
            self.open.removeKey(fact)
        for at in list(self.handle.listTimers()) if timed else []:
            self.handle.deleteTimer(at)
        if len(facts) > max(len(passed), 1):
            self.handle.registerTimer(facts[-1][0] // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        known = sorted((int(at), fact) for at, fact in self.open.keys())
        came = {(r["at_us"], r["fact_id"]) for r in rows} - set(known)
        for fact in came:
            self.open.updateValue(fact, (1,))
        whole = sorted([*known, *came])
        before, after = told(key[0], known), told(key[0], whole)
        changed = [f for f in whole if before.get(f) != after[f]]
        self.release(whole, timerValues.getCurrentWatermarkInMs(), bool(known))
        yield from (CHANGE(*before[f], -1) for f in changed if f in before)
        yield from (CHANGE(*after[f], 1) for f in changed)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.release(sorted((int(at), fact) for at, fact in self.open.keys()), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


@contextmanager
def store_in_use(spark: SparkSession) -> Iterator[None]:
    """State processors work on this store only; a query that is started inside keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def changes(stream: DataFrame, late: str) -> DataFrame:
    """stream: key string, fact_id string, at timestamp. Rows of CHANGES; moments are microseconds.

    late is how far behind the newest fact of the stream one may come; Spark leaves later ones out and counts them in the query's progress
    (numRowsDroppedByWatermark). A key holds as many facts as fall into that time, whatever the length of the stream. A fact that comes
    again changes nothing; one before 1970, where every watermark begins, counts as too late. Facts of one moment are ordered by id. Null keys are one key; a fact without id or moment is left out. The query
    is started inside store_in_use()."""
    facts = stream.where("fact_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = facts.select("key", "fact_id", "at", F.unix_micros("at").alias("at_us"))
    return rows.groupBy("key").transformWithState(Versions(), CHANGES, "Append", "EventTime")


def settled(told_changes: DataFrame) -> DataFrame:
    """What holds after all changes, whatever their order: key, fact_id, from_us, to_us (null: still), superseded_by. The sums are merged
    before the shuffle, and rows of a key lie apart, so no key is hot."""
    columns = [c for c in COLUMNS if c != "change"]
    return told_changes.groupBy(*columns).agg(F.sum("change").alias("_n")).where("_n > 0").drop("_n")
