"""Steps whose work must grow no faster than their tables: findings of round 4."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row

from chronolore.catalog import linked
from chronolore.operators import search, supersede
from chronolore.plans import ask, sql_tools
from chronolore.sources import files, pages
from chronolore.streaming import restated, versions

START = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("least", [0.95, 0.2, -0.5])
def test_copies_meet_once(spark, monkeypatch, least):
    """Facts of equal vectors, some of one moment: all like pairs, but Python sees each different vector only."""
    seen, compared = [], supersede.compared
    monkeypatch.setattr(supersede, "compared", lambda met, *rest: (seen.append(met.count()), compared(met, *rest))[1])
    monkeypatch.setattr(supersede, "PART", 5)
    vectors = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.0, 0.0], [2.0, 0.2], [float("nan"), 1.0], [1.0], []]
    rows = [(f"f{i:03}", [None, "a", "b", "b"][i % 4], START + dt.timedelta(minutes=i // 3), vectors[i * 7 // 4 % 8], i) for i in range(240)]
    facts = spark.createDataFrame(rows, "fact_id string, type string, occurred_at timestamp, embedding array<double>, seq long")
    got = sorted(map(tuple, supersede.like_pairs(facts, least, tile=4096).collect()))
    assert max(seen) <= 14
    wanted = sorted(map(tuple, compared(*supersede.dealt_cells(facts, least, None, 4096), facts, least).collect()))
    assert [g[:6] for g in got] == [w[:6] for w in wanted] and len(got) > 1000
    assert [g[6] for g in got] == pytest.approx([w[6] for w in wanted], abs=1e-12)


def test_words_of_all_facts_are_not_counted(spark):
    """What search_knowledge reads is every word as a row, to be met by those asked for; counts come after."""
    words = sql_tools.views(linked.document_tables(spark, "/root/testdata/sf0.001"), ask.Reader())["words"]
    assert "Aggregate" not in words._jdf.queryExecution().optimizedPlan().toString()
    twice = words.groupBy("fact_id", "term", "length").count().where("count > 1").first()
    assert twice and twice["length"] >= twice["count"]


class Kept:
    """The state of a bucket between batches."""

    exists = False

    def update(self, value):
        self.exists, self.get = True, value


def test_a_call_takes_many_keys():
    """A bucket's keys are closed in one call, each by itself, and go on where the batch before left them."""
    state, table = Kept(), lambda *rows: pd.DataFrame(rows, columns=["at", "fact_id", "key"])
    first = list(versions.close((0,), iter([table((3, "c", "k"), (1, "x", None)), table((1, "a", "k"), (2, "y", None), (5, "q", "quiet"))]), state))
    assert sorted(first[0].itertuples(index=False, name=None), key=str) == [("k", "a", 1, 3, "c", False), (None, "x", 1, 2, "y", False)]
    then = list(versions.close((0,), iter([table((2, "b", "k"), (9, "d", "k"), (9, None, "quiet"))]), state))
    assert sorted(then[0].itertuples(index=False, name=None)) == [("k", "b", 2, 3, "c", True), ("k", "c", 3, 9, "d", False), ("quiet", "q", 5, 9, None, False)]
    assert dict(zip(*state.get[:2])) == {"k": "d", None: "y", "quiet": None}
    assert not list(versions.close((0,), iter([table((7, "z", "new"))]), state))


def test_changes_are_rows():
    """A key's few facts are no pandas table, and a new key asks for no timers."""
    processor, known, asked = restated.Versions(), {}, []
    processor.open = SimpleNamespace(keys=lambda: iter(known), updateValue=known.__setitem__, removeKey=known.pop)
    processor.handle = SimpleNamespace(listTimers=lambda: iter(asked.append(1) or []), deleteTimer=None, registerTimer=lambda at: None)
    clock, fact = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0), Row("at_us", "fact_id")
    first = list(processor.handleInputRows(("k",), iter([fact(30, "c"), fact(10, "a")]), clock))
    assert first == [("k", "a", 10, 30, "c", 1), ("k", "c", 30, None, None, 1)] and first[0]["superseded_by"] == "c" and not asked
    then = list(processor.handleInputRows(("k",), iter([fact(20, "b"), fact(10, "a")]), clock))
    assert then == [("k", "a", 10, 30, "c", -1), ("k", "a", 10, 20, "b", 1), ("k", "b", 20, 30, "c", 1)] and asked


def test_few_scores_are_sorted():
    """The bound that most scores fall short of leaves the k best of each row, ties included; odd tables have none."""
    scores = np.round(np.random.default_rng(5).normal(size=(50, 4000)), 2)
    least = search.at_least(scores, 11)
    assert (least <= np.sort(scores, axis=1)[:, -11]).all() and ((scores >= least[:, None]).sum(axis=1) >= 11).all()
    assert (scores >= least[:, None]).mean() < 0.02
    assert search.at_least(scores[:, :60], 11) is None and search.at_least(np.where(scores > 3, np.nan, scores), 11) is None


def test_answers_are_dealt_to_all_cores(spark):
    """A small file of events is parsed as answers by many tasks, not by as many as its bytes ask for."""
    found = linked.payload_facts(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == linked.ANSWERED * spark.sparkContext.defaultParallelism


def test_many_files_are_read_by_few_tasks(spark, tmp_path):
    """Tasks that read small files don't grow in number with the files, and each file is read."""
    (tmp_path / "notion").mkdir()
    for n in range(1100):
        (tmp_path / "notion" / f"p{n}.md").write_text(f"page {n}")
    found = pages.files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= files.READERS * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, found.collect())) == sorted((f"p{n}.md", f"page {n}") for n in range(1100))
