"""A refreshed load equals one of everything, on all columns, and rewrites little; readers see whole versions."""

import json
import shutil
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from fixtures import write_corpus
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chronolore.operators import models, supersede
from chronolore.plans import load

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def two_words(texts):
    """Vectors by the first two words, so facts of one beginning are like each other."""
    out = np.zeros((len(texts), 64), np.float32)
    for row, t in zip(out, texts, strict=True):
        for w in (t or "").lower().split()[:2]:
            row[sum(map(ord, w)) % 64] += 1
    return out


def judge(older, newer, similarity):
    return ("DUPLICATE", "") if (len(older) + len(newer)) % 3 == 0 else ("SUPERSEDES", "x")


SLOTS = load.Slots(embedder=two_words, judge=judge, least_similarity=0.6)


def loaded(spark, root):
    found, people = load.read_corpus(spark, str(root))
    facts = load.accept(models.marker_extractor(found.utterances), found.utterances)[0]
    # Statuses of their own, which a replaced fact must get back.
    return found, people, facts.withColumn("owner_mention", F.lit("Nina Nine")).withColumn("status", F.when(F.length("statement") % 2 == 0, "DONE").otherwise(F.col("status")))


def rows(df):
    return sorted(str(sorted((k, v) for k, v in r.asDict(True).items() if k not in ("ingested_at", "is_public", "seq"))) for r in df.collect())


def same(a, b):
    assert set(a) == set(b)
    for name in a:
        assert rows(a[name]) == rows(b[name]), name


def say(root, name, turns):
    (root / f"slack/threads/{name}.json").write_text(json.dumps({"channel": {"id": "C9", "name": "x"}, "thread_ts": f"{ord(name)}.0", "messages": [{"ts": f"{at}.0", "user": "U9", "text": text} for at, text in turns]}))


@pytest.fixture(scope="module")
def loaded_once(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("base")
    root = Path(write_corpus(base / "corpus"))
    say(root, "a", [(1770000000, "Decision: the venue is the old hall."), (1770000100, "Decision: the venue is the new hall."), (1770000200, "Risk: the caterer may leave us.")])
    say(root, "b", [(1771000000, "Decision: the venue is the town park."), (1771000100, "Decision: the budget is forty thousand.")])
    say(root, "c", [(1772000000, "Decision: the venue is the river side."), (1772000100, "Risk: the caterer is late again.")])
    found, people, facts = loaded(spark, root)
    load.write(load.build(found, people, facts, SLOTS), f"{base}/graph")
    return base


@pytest.fixture
def corpus(loaded_once, tmp_path):
    """The corpus and its graph, to be changed; manifests name folders within the graph, so a copy is as good."""
    shutil.copytree(loaded_once, tmp_path / "copy")
    return tmp_path / "copy/corpus", f"{tmp_path}/copy/graph"


CHANGES = {
    "nothing": lambda root: None,
    "a fact in the middle goes": lambda root: say(root, "b", [(1771000100, "Decision: the budget is forty thousand.")]),
    "a thread before all, and a fact in the middle is another": lambda root: [say(root, "d", [(1760000000, "Decision: the venue is the harbour."), (1760000100, "Open question: who brings the chairs then?")]), say(root, "b", [(1771000000, "Decision: the venue is elsewhere now.")])],
}


@pytest.mark.parametrize("change", CHANGES)
def test_refresh_is_a_full_build(spark, corpus, change):
    root, graph = corpus
    CHANGES[change](root)
    found, people, facts = loaded(spark, root)
    whole = load.build(found, people, facts, SLOTS)
    told = {r["table_name"]: (r["rewritten"], r["stored"]) for r in load.sync(spark, graph, found, people, facts, SLOTS).collect()}
    same(load.read(spark, graph), whole)
    assert set(told) == set(load.KEPT_BY) and load.manifest(spark, graph)["version"] == 2
    assert told["people"][0] == 0 and told["utterances"][0] < told["utterances"][1] and told["facts"][0] < told["facts"][1]
    if change == "nothing":
        assert not any(rewritten for rewritten, _ in told.values())
    load.vacuum(spark, graph)
    same(load.read(spark, graph), whole)
    assert len(list(Path(graph, "manifests").glob("*.json"))) == 1


def test_new_people_resolve_old_names(spark, corpus):
    root, graph = corpus
    users = json.loads((root / "slack/users.json").read_text())
    (root / "slack/users.json").write_text(json.dumps([*users, {"id": "U9", "name": "nine", "real_name": "Nina Nine"}]))
    found, people, facts = loaded(spark, root)
    refreshed = load.refresh(spark, graph, found, people, facts, SLOTS)
    same(refreshed, load.build(found, people, facts, SLOTS))
    assert rows(refreshed["ownership"]) != rows(load.read(spark, graph)["ownership"])


def test_half_a_load_is_not_seen(spark, corpus, monkeypatch):
    """A load that fails before its manifest leaves the version before it."""
    root, graph = corpus
    before = {n: rows(df) for n, df in load.read(spark, graph).items()}
    CHANGES["a fact in the middle goes"](root)
    found, people, facts = loaded(spark, root)
    monkeypatch.setattr(load, "json", SimpleNamespace(loads=json.loads, dumps=lambda *_: 1 / 0))
    with pytest.raises(ZeroDivisionError):
        load.sync(spark, graph, found, people, facts, SLOTS)
    assert {n: rows(df) for n, df in load.read(spark, graph).items()} == before


def test_pairs_between_are_those_of_all(spark):
    from test_like_pairs import SCHEMA, clustered, plain, rows_of

    given = rows_of([*clustered(60, 4, 5), None, [0.0] * 5, [1.0, 2.0], [2.0, 4.0]], types=2, minutes=2)
    new, old = ([r for r in given if (r[5] % 3 == 0) is side] for side in (True, False))
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    ids = {r[0] for r in new}
    for tile in (5, 4096):
        got = [tuple(r) for r in supersede.like_pairs_between(frame(new), frame(old), 0.8, None, tile).select("newer", "older").collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p in plain(given, 0.8) if (p[0] in ids) != (p[1] in ids)}


def test_a_new_fact_is_like_one_that_nothing_was_like(spark, corpus):
    """The stored fact was in no component, and is replaced all the same. No fact has more than one stored pair, however many are like it."""
    root, graph = corpus
    say(root, "e", [(1773000000 + 100 * i, f"Risk: the caterer is late, {'again and ' * i}again.") for i in range(9)])
    say(root, "f", [(1774000000, "Open question: who pays the band?")])
    found, people, facts = loaded(spark, root)
    load.sync(spark, graph, found, people, facts, SLOTS)
    stored = load.read(spark, graph)
    ends = stored["components"].join(stored["facts"].where("statement LIKE '%who pays the band%'"), "fact_id")
    assert ends.isEmpty() and stored["facts"].where("statement LIKE '%who pays the band%'").count() == 1
    say(root, "g", [(1774000000 + 1000 * i, f"Open question: who pays the {w}?") for i, w in enumerate(["hall", "cook", "rent"], 1)])
    found, people, facts = loaded(spark, root)
    load.sync(spark, graph, found, people, facts, SLOTS)
    stored, whole = load.read(spark, graph), load.build(found, people, facts, SLOTS)
    same(stored, whole)
    assert stored["judgements"].join(stored["facts"].where("statement LIKE '%who pays the band%'").select(F.col("fact_id").alias("older")), "older").count() == 1
    assert stored["pairs"].groupBy("newer").count().where("count > 1").isEmpty() and stored["pairs"].count() > 5
