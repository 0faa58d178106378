import datetime as dt
import json
import random
import threading
import urllib.error
import urllib.request
from pathlib import Path

import pytest
from fixtures import write_corpus
from pyspark.sql import functions as F

from chronolore import schemas, serve
from chronolore.functions.dates import as_of
from chronolore.operators import export, graph, models, render, scoring, search, stats, supersede, temporal, validate
from chronolore.operators.acl import readable
from chronolore.__main__ import main
from chronolore.plans import ask, evaluate, extract, load
from chronolore.sources import runs
from chronolore.streaming import versions


def day(text):
    return dt.datetime.fromisoformat(text)


# Validation

FACT = {"episode_id": "e", "type": "DECISION", "statement": "The launch is on May 4.", "owner_mention": None, "participant_mentions": [], "occurred_at": day("2026-02-11"), "due_date": None, "status": "AGREED", "topics": [], "evidence": [("e", 0, "launch IS on   May 4")], "confidence": 0.9}


def facts(spark, *changes):
    rows = [tuple((FACT | c)[k] for k in FACT) + (i,) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, f"{schemas.EXTRACTED_FACTS}, fact_no long")


def said(spark):
    return spark.createDataFrame([("e", 0, "So the launch is on May 4, right?"), ("e", 1, "Right, and the studio is booked.")], "episode_id string, ordinal int, text string")


@pytest.mark.parametrize(
    ("change", "issues"),
    [
        ({}, []),
        ({"type": "ACTION_ITEM"}, [("REJECT", "owner")]),
        ({"statement": " ", "evidence": []}, [("REJECT", "statement"), ("REJECT", "evidence")]),
        ({"statement": "Too short"}, [("REJECT", "statement")]),
        ({"statement": "x" * 501}, [("WARN", "statement")]),
        ({"confidence": 1.2}, [("REJECT", "confidence")]),
        ({"confidence": 0.5}, [("WARN", "confidence")]),
        ({"status": "SUPERSEDED"}, [("REJECT", "status")]),
        ({"type": "RISK", "status": "DONE"}, [("WARN", "status")]),
        ({"due_date": dt.date(2026, 2, 10)}, [("WARN", "dueDate")]),
        ({"due_date": dt.date(2026, 2, 11)}, []),
        ({"evidence": [("e", 0, "the studio is booked")]}, [("WARN", "evidence.utteranceOrdinal")]),
        ({"evidence": [("e", 0, "nobody said this")]}, [("REJECT", "evidence.verbatimSpan")]),
        ({"evidence": [("e", 0, "May 4")]}, [("REJECT", "evidence.verbatimSpan")]),
        ({"evidence": [("other", 0, "the launch is on May 4")]}, [("REJECT", "evidence.episodeId")]),
    ],
)
def test_validate(spark, change, issues):
    got = validate.validate(facts(spark, change), said(spark)).first()
    assert [(i["severity"], i["field"]) for i in got["issues"]] == issues
    assert got["accepted"] == all(s != "REJECT" for s, _ in issues)


def test_repair(spark):
    df = facts(spark, {"evidence": [("e", 0, "the studio is booked"), ("e", 0, "launch is on May 4"), ("e", 1, "nobody said this")]}, {})
    got = [[e["ordinal"] for e in r["evidence"]] for r in validate.repair_citations(df, said(spark)).orderBy("fact_no").collect()]
    assert got == [[1, 0, 1], [0]]


def test_payloads(spark):
    answer = '```json\n{"facts": [{"type": "decision", "statement": " s ", "owner": "Mira.", "occurredAt": "2026-04-08", "status": "odd", "evidence": [{"utterance": 0, "quote": "q"}, {"utterance": -1, "quote": "q"}, {"quote": "q"}, {"utterance": 1, "quote": " "}]}, {"type": "RUMOUR"}]}\n```'
    df = spark.createDataFrame([("e", day("2026-01-01"), answer), ("x", day("2026-01-01"), "not json"), ("y", day("2026-01-01"), None)], "episode_id string, occurred_at timestamp, answer string")
    got = models.payload_facts(df).collect()
    assert [(r["episode_id"], r["type"], r["statement"], r["owner_mention"], str(r["occurred_at"]), r["status"], len(r["evidence"]), r["confidence"]) for r in got] == [("e", "DECISION", "s", "Mira", "2026-04-08 00:00:00", "PROPOSED", 1, 0.0)]
    assert set(schemas.payload_json_schema()["properties"]["facts"]["items"]["properties"]) >= {"type", "evidence"}


# Supersession


def timeline(spark, rows):
    return spark.createDataFrame(rows, "fact_id string, type string, statement string, occurred_at timestamp, embedding array<float>, seq long")


def plain_fold(rows, least, judge):
    """One pass over each type, as told."""
    out = []
    for kind in {r[1] for r in rows}:
        still = []
        for r in sorted((r for r in rows if r[1] == kind), key=lambda r: (r[3], r[5])):
            best = None
            for o in still:
                norm = lambda v: sum(x * x for x in v) ** 0.5
                like = sum(a * b for a, b in zip(r[4], o[4], strict=True)) / ((norm(r[4]) * norm(o[4])) or 1)
                if o[3] < r[3] and like >= least and (best is None or o[3] > best[3]):
                    best = o
            if best is not None:
                verdict, _ = supersede.verdict_of(judge, best[2], r[2], 1.0)
                out.append((r[0], best[0], verdict))
                if verdict == "SUPERSEDES":
                    still.remove(best)
            still.append(r)
    return sorted(out)


def test_the_most_recent_not_the_most_similar(spark):
    rows = [("a", "D", "one", day("2026-02-11"), [1.0, 0.0, 0.0], 0), ("b", "D", "two", day("2026-04-08"), [0.97, 0.24, 0.0], 1), ("c", "D", "three", day("2026-05-06"), [1.0, 0.0, 0.0], 2), ("d", "D", "three", day("2026-05-06"), [1.0, 0.0, 0.0], 3)]
    df = timeline(spark, rows)
    got = {r["newer"]: r["older"] for r in supersede.proposals(supersede.like_pairs(df)).collect()}
    assert got == {"b": "a", "c": "b", "d": "b"}  # those of one moment never revise each other


def test_fold_equals_one_pass(spark):
    rng = random.Random(4)
    judge = lambda old, new, _: (["SUPERSEDES", "DUPLICATE", "UNRELATED", "odd"][(len(old) * 7 + len(new)) % 4], "x")
    rows = [(f"f{i}", rng.choice("AB"), "w" * rng.randint(1, 9), day("2026-01-01") + dt.timedelta(days=rng.randint(0, 40)), [rng.random(), rng.random(), rng.random() * 0.5], i) for i in range(90)]
    df = timeline(spark, rows)
    got = sorted((r["newer"], r["older"], r["verdict"]) for r in supersede.fold(df, supersede.like_pairs(df, 0.97), judge).collect())
    assert got == plain_fold(rows, 0.97, judge) and {v for *_, v in got} == {"SUPERSEDES", "DUPLICATE", "UNRELATED"}


def test_verdicts_are_made_safe():
    def broken(*_):
        raise RuntimeError("down")

    assert supersede.verdict_of(broken, "a", "b", 1)[0] == supersede.verdict_of(lambda *_: ("?", ""), "a", "b", 1)[0] == "UNRELATED"
    assert supersede.verdict_of(lambda *_: ("SUPERSEDES", " "), "a", "b", 1)[0] == "DUPLICATE"


def test_duplicates_share_the_earliest_closure(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("n", "a")], "u string, v string")
    closed = spark.createDataFrame([("a", day("2026-05-01"), "z"), ("c", day("2026-04-01"), "n"), ("q", day("2026-01-01"), "r")], "fact_id string, closed_at timestamp, superseded_by string")
    got = {r["fact_id"]: (r["closed_at"], r["superseded_by"], r["propagated"]) for r in supersede.propagate(pairs, closed).collect()}
    april, may = day("2026-04-01"), day("2026-05-01")
    assert got == {"a": (april, "n", True), "b": (april, "n", True), "c": (april, "n", False), "n": (may, "z", True), "q": (day("2026-01-01"), "r", False)}


def test_intervals_are_half_open_and_clamped(spark):
    rows = spark.createDataFrame([("a", day("2026-02-01"), "AGREED"), ("b", day("2026-03-01"), "AGREED"), ("c", day("2026-05-01"), "AGREED")], "fact_id string, valid_from timestamp, status string").withColumn("valid_to", F.lit(None).cast("timestamp")).withColumn("superseded_by", F.lit(None).cast("string"))
    ends = spark.createDataFrame([("a", day("2026-03-01"), "b"), ("b", day("2026-02-01"), "x")], "fact_id string, closed_at timestamp, superseded_by string")
    out = temporal.close(rows, ends)
    assert {r["fact_id"]: (r["valid_to"], r["status"]) for r in out.collect()} == {"a": (day("2026-03-01"), "SUPERSEDED"), "b": (day("2026-03-01"), "SUPERSEDED"), "c": (None, "AGREED")}
    held = lambda d: sorted(r["fact_id"] for r in out.where(temporal.held_at(as_of(d))).collect())
    assert held("2026-02-15") == ["a"] and held("2026-03-01") == [] and held("2026-06-01") == ["c"] and held(None) == ["a", "b", "c"]
    assert [r["fact_id"] for r in temporal.zero_width(out).collect()] == ["b"]


# Search


def test_fusion_prefers_what_both_find(spark):
    df = spark.createDataFrame([(0, "v", 1), (0, "agreed", 2), (0, "k", 1), (0, "agreed", 2)], "query_id int, fact_id string, rank int")
    got = search.fuse(df, ["query_id"], "fact_id").orderBy(F.desc("score")).first()
    assert got["fact_id"] == "agreed" and got["score"] == pytest.approx(2 / 62, abs=1e-9)


def test_diversity_and_order(spark):
    rows = [(0, f"t{i}", 1.0 - i / 10, None, day("2026-01-01"), "talk") for i in range(4)] + [(0, "o", 0.1, None, day("2026-01-01"), "other")]
    rows += [(1, "stale", 0.9, day("2026-02-01"), day("2026-01-01"), "x"), (1, "current", 0.4, None, day("2026-01-01"), "y"), (1, "tied", 0.9, None, day("2025-01-01"), None)]
    df = spark.createDataFrame(rows, "query_id int, fact_id string, score double, valid_to timestamp, occurred_at timestamp, title string")
    got = search.rerank(df, ["query_id"]).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["fact_id"]) for r in got] == [(0, "t0"), (0, "t1"), (0, "t2"), (0, "o"), (1, "tied"), (1, "stale"), (1, "current")]


# Graph


def random_graph(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(24)]
    acl = {n: rng.choice([None, [], [], ["g"], ["h"]]) for n in names}
    edges = {(rng.choice(names), rng.choice(names), rng.choice(["SUPERSEDES", "ABOUT", "OTHER"])) for _ in range(45)}
    nodes = spark.createDataFrame([(n, "Fact", n, acl[n]) for n in names], "node string, kind string, label string, acl_grants array<string>")
    return graph.Graph(nodes, spark.createDataFrame(sorted(edges), "src string, dst string, type string")), names, acl, edges


def plain_paths(acl, edges, start, end, grants):
    ok = lambda n: acl[n] is None or set(acl[n]) <= set(grants)
    if not ok(start) or not ok(end):
        return []
    level = [([start], [])]
    for _ in range(6):
        level = [(p + [b], s + [(t, f)]) for p, s in level for a, b, t, f in [*((x, y, t, True) for x, y, t in edges), *((y, x, t, False) for x, y, t in edges)] if t != "OTHER" and a == p[-1] and b not in p and ok(b)]
        if found := [x for x in level if x[0][-1] == end]:
            return found
    return []


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_readable_paths(spark, seed):
    g, names, acl, edges = random_graph(spark, seed)
    hit = 0
    for start, end in [(names[0], names[7]), (names[3], names[20]), (names[5], names[11])]:
        want = plain_paths(acl, edges, start, end, ["g"])
        got = graph.shortest_paths(g, start, end, ["g"], limit=1000).collect()
        assert sorted((r["nodes"], [tuple(s) for s in r["steps"]]) for r in got) == sorted(want)
        hit += bool(want)
    assert hit


@pytest.mark.parametrize("hops", [1, 3, 5, 10])
def test_closure_finds_what_walks_find(spark, hops):
    rng = random.Random(hops)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(55)], "src long, dst long")
    allowed = spark.createDataFrame([(i,) for i in range(40) if i % 7], "node long")
    seeds = allowed.select(F.col("node").alias("seed"), "node")
    walked = {(r["seed"], r["node"]): r["depth"] for r in graph.walk(edges, seeds, hops, allowed).where("depth > 0").collect()}
    found = {(r["src"], r["dst"]): r["depth"] for r in graph.closure(edges, hops, allowed).where("src <> dst").collect()}
    assert found == walked


def test_like_pairs_over_tiles(spark, monkeypatch):
    """Pairs are the same in one tile and in many; equal times, other types and vectors of other lengths make none."""
    rng = random.Random(4)
    rows = [(f"f{i}", rng.choice("ab"), day("2026-01-01") + dt.timedelta(days=rng.randrange(30)), i, [rng.gauss(0, 1) for _ in range(3 if i % 9 else 2)]) for i in range(120)]
    facts = spark.createDataFrame([*rows, ("n", "a", None, 200, [1.0, 0.0, 0.0])], "fact_id string, type string, occurred_at timestamp, seq long, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(n[0], o[0]) for n in rows for o in rows if n[1] == o[1] and o[2] < n[2] and len(n[4]) == len(o[4]) and round(cos(n[4], o[4]), 9) >= 0.7}
    for tile in (4096, 7):
        monkeypatch.setattr(supersede, "TILE", tile)
        got = [(r["newer"], r["older"]) for r in supersede.like_pairs(facts, 0.7).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_walks_never_pass_through_hidden_facts(spark):
    old = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "c")], "src string, dst string")
    everyone = spark.createDataFrame([("a", [], day("2026-02-01")), ("b", ["x"], day("2026-03-01")), ("c", [], day("2026-04-01")), ("d", [], None)], "fact_id string, acl_grants array<string>, valid_to timestamp")
    seen = lambda grants: everyone.where(readable(F.col("acl_grants"), grants)).select(F.col("fact_id").alias("node"))
    seeds = spark.createDataFrame([("a",), ("d",), ("b",)], "seed string")
    chain = lambda grants: sorted((r["seed"], r["node"]) for r in graph.chains(old, seeds, seen(grants)).select("seed", "node").distinct().collect())
    assert chain([]) == [("a", "a"), ("d", "c"), ("d", "d")]
    assert chain(["x"]) == [(s, n) for s in "abd" for n in "abcd"]
    current = lambda **k: sorted(r["fact_id"] for r in graph.currency(old, spark.createDataFrame([("a",)], "seed string"), everyone, [], **k).collect())
    assert current() == ["a"] and current(compat=True) == ["a", "d"]
    best = graph.longest_chains(old).collect()
    assert [(r["head"], r["length"], r["chain"]) for r in best] == [("d", 3, ["d", "c", "b", "a"])]


# Scoring


def test_verdicts(spark):
    base = ("Q", "?", [], "The launch is June 1.", ["F1"], ["May 4"], ["unknown"], "trap")
    cases = [
        ("It is June 1 [1].", False, 2, 0.1, base, "PASS"),
        ("It is June 1.", False, 2, 0.1, base, "UNSUPPORTED"),
        ("It is June 1 [9].", False, 2, 0.1, base, "UNSUPPORTED"),
        ("It is June 15 [2].", False, 2, 0.1, base, "MISSED"),
        ("It is June 15 [2].", False, 2, 0.7, base, "PASS"),
        ("Not may 4 but June 1 [1].", False, 2, 0.9, base, "FORBIDDEN"),
        ("Unknown. June 1 [1].", False, 2, 0.9, base, "FORBIDDEN"),
        ("June 1 [1]. Unknown.", False, 2, 0.9, base, "PASS"),
        (None, True, 0, 0.0, base, "MISSED"),
        (None, True, 0, 0.0, base[:4] + ([],) + base[5:], "PASS"),
        ("June 1 [1].", False, 2, 0.9, base[:4] + ([],) + base[5:], "FORBIDDEN"),
    ]
    questions = spark.createDataFrame([(f"{i:02d}", *c[4][1:]) for i, c in enumerate(cases)], "id string, question string, principal array<string>, expected string, expected_facts array<string>, must_not_say array<string>, must_not_lead_with array<string>, trap string")
    answers = spark.createDataFrame([(f"{i:02d}", c[0], c[1], c[2], c[3]) for i, c in enumerate(cases)], "id string, answer string, refused boolean, n_cards int, similarity double")
    graded = scoring.grade(questions, answers).orderBy("id")
    assert [r["verdict"] for r in graded.collect()] == [c[5] for c in cases]
    assert scoring.pass_rate(graded).first()["passed"] == 4
    assert scoring.pass_rate(graded.limit(0)).first()["rate"] == 1.0
    assert {r["verdict"]: r["n"] for r in scoring.verdict_histogram(graded).collect()}["FORBIDDEN"] == 3


def test_recall(spark):
    gold = spark.createDataFrame([("g1", "D", ["e1", "e2"], [1.0, 0.0]), ("g2", "D", ["e1"], [0.0, 1.0]), ("g3", "R", ["e3"], [1.0, 0.0])], "id string, type string, sources array<string>, embedding array<float>")
    found = spark.createDataFrame([("e1", "R", 0, [1.0, 0.0], "x"), ("e2", "D", 0, [1.0, 0.0], "y"), ("e1", "D", 1, [0.5, 1.0], "z")], "episode_id string, type string, seq int, embedding array<float>, statement string")
    matches = scoring.best_matches(gold, found)
    assert {r["gold_id"]: r["statement"] for r in matches.collect()} == {"g1": "x", "g2": "z"}
    by_type = scoring.recall_by_type(gold, matches)
    assert {r["type"]: (r["gold"], r["matched"], r["mistyped"]) for r in by_type.collect()} == {"D": (2, 1, 1), "R": (1, 0, 0)}
    total = scoring.extraction_score(by_type, 10, 2).first()
    assert (total["strict_recall"], total["content_recall"], total["grounding_reject_rate"]) == (1 / 3, 2 / 3, 0.2)


def test_percentiles_and_distribution(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 7.0)], "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in stats.percentiles(df, ["k"], "v", [0.5, 0.99]).collect()}
    assert got == {"a": (100, 50.0, 99.0), "b": (1, 7.0, 7.0)}
    assert {r["k"]: r["n"] for r in stats.distribution(df, "k").collect()} == {"a": 100, "b": 1}


# The whole


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    found, people = load.read_corpus(spark, write_corpus(root / "corpus"))
    extracted = models.marker_extractor(found.utterances)
    accepted, checked = load.accept(extracted, found.utterances)
    assert checked.count() == accepted.count() == 4
    load.write(load.build(found, people, accepted, load.Slots(least_similarity=0.6)), str(root / "graph"))
    return load.read(spark, str(root / "graph"))


def test_load(spark, tables):
    report = stats.load_report(tables).first().asDict()
    assert report["facts"] == 4 and report["superseding"] == 2 and report["unresolved_owners"] == 1 and report["evidence"] == 4
    got = {r["statement"]: (r["valid_from"], r["valid_to"], r["status"]) for r in tables["facts"].where("type = 'DECISION' AND statement LIKE 'the podcast%'").collect()}
    first, second, third = (got[f"the podcast launches on {d}."] for d in ("May 4", "May 18", "June 1"))
    assert first[1] == second[0] and second[1] == third[0] and third[1] is None and first[2] == second[2] == "SUPERSEDED"
    assert load.doctor(tables).where("NOT healthy").count() == 0
    assert {r["component"]: r["healthy"] for r in load.doctor({"people": tables["people"].union(tables["people"])}).collect()} == {"people": False, "episodes": False, "utterances": False, "facts": False, "embedder": True, "chat": True}

    def broken(texts):
        raise OSError("out of reach")

    told = {r["component"]: (r["healthy"], r["detail"]) for r in load.doctor(tables, broken).collect()}
    assert told["embedder"] == (False, "OSError: out of reach") and told["chat"][0] and told["facts"][0]


def test_refresh(spark, tables, tmp_path):
    """What did not change stays, a changed episode takes the place of the stored one, and replacements are judged over both."""
    load.write(tables, f"{tmp_path}/graph")
    root = Path(write_corpus(tmp_path / "corpus"))
    slots = load.Slots(least_similarity=0.6)

    def again():
        found, people = load.read_corpus(spark, str(root))
        return load.refresh(spark, f"{tmp_path}/graph", found, people, load.accept(models.marker_extractor(found.utterances), found.utterances)[0], slots)

    facts = lambda t: sorted((r["fact_id"], str(r["valid_to"])) for r in t["facts"].collect())
    assert facts(again()) == facts(tables)
    thread = root / "slack/threads/again.json"
    thread.write_text(thread.read_text().replace("June 1", "July 9"))
    changed = again()
    said = {r["statement"]: r["valid_to"] for r in changed["facts"].collect() if r["statement"].startswith("the podcast")}
    assert set(said) == {f"the podcast launches on {d}." for d in ("May 4", "May 18", "July 9")} and [s for s, end in said.items() if end is None] == ["the podcast launches on July 9."]
    assert changed["utterances"].count() == tables["utterances"].count() and changed["episodes"].count() == tables["episodes"].count()


def test_extraction_plan(spark, tmp_path):
    """A model's answers become a stored run: repaired, checked, with what failed and why."""
    found, _ = load.read_corpus(spark, write_corpus(tmp_path / "corpus"))
    own = found.episodes.where("kind = 'MEETING_TRANSCRIPT' AND title = 'Budget sync'")
    fact = {"type": "decision", "statement": "the budget stays at forty thousand", "status": "agreed", "confidence": 0.9}
    answer = json.dumps({"facts": [fact | {"evidence": [{"utterance": 5, "quote": "Decision: the budget stays at forty thousand."}]}, fact | {"evidence": [{"utterance": 0, "quote": "nobody said this at all"}]}, fact | {"type": "RISK", "statement": "no"}]})
    results = extract.stored(extract.run(own, found.utterances, lambda prompts: [answer for p in prompts if "Budget sync" in p and '"DECISION"' in p]), f"{tmp_path}/runs")
    row = results.first()
    assert [(f["statement"], f["evidence"][0]["utteranceOrdinal"]) for f in row["accepted"]] == [("the budget stays at forty thousand", 0)]
    assert sorted(len(r["issues"]) for r in row["rejected"]) == [1, 3] and row["inputTokens"] > row["outputTokens"] > 0
    assert runs.newest_run(spark, f"{tmp_path}/runs").endswith("extraction.json")
    assert stats.run_totals(results).first()["acceptance_rate"] == pytest.approx(1 / 3)


def test_the_same_question_differs_by_reader_and_time(tables):
    question = "When does the podcast launch?"
    top = lambda **k: ask.retrieve(tables, question, **k).orderBy("rank").collect()
    insider = ask.Reader("insider", ["slack:C2", "zoom:ops"])
    def leads(**k):
        return next(r["statement"] for r in top(**k) if r["statement"].startswith("the podcast") and r["valid_to"] is None)
    assert leads(reader=insider) == "the podcast launches on June 1."
    public = [r for r in top() if r["statement"].startswith("the podcast")]
    assert {r["statement"] for r in public} == {"the podcast launches on May 4.", "the podcast launches on May 18."}
    assert not any(n["statement"].endswith("June 1.") for r in public for n in r["newer"])  # what replaced it is hidden too
    march = [r["statement"] for r in top(reader=insider, as_of="2026-03-15") if r["statement"].startswith("the podcast")]
    assert march == ["the podcast launches on May 4."] and all(r["held_at_as_of"] for r in top(reader=insider, as_of="2026-03-15"))


def test_answers(tables):
    got = ask.ask(tables, "When does the podcast launch?", ask.Reader("i", ["slack:C2"])).first()
    assert got["grounded"] and got["citations"] == [1] and "[1] DECISION" in got["pack"]
    none = ask.ask({**tables, "facts": tables["facts"].limit(0)}, "anything?").first()
    assert none["refused"] and none["n_cards"] == 0 and none["pack"] == render.NOTHING
    refused = ask.ask(tables, "podcast", chat=lambda packs: [f"{models.NOT_FOUND} [1]" for _ in packs]).first()
    assert refused["refused"] and refused["citations"] == [] and not refused["grounded"]


def test_tools(tables):
    nobody, insider = ask.Reader(), ask.Reader("insider", ["slack:C2", "zoom:ops"])
    out = ask.search_knowledge(tables, nobody, {"query": "podcast launches", "limit": 99})
    assert "for anonymous" in out and "1 more matching fact is hidden from this reader" in out and "June 1" not in out
    assert "hidden" not in ask.search_knowledge(tables, insider, {"query": "podcast launches"})
    trace = ask.trace_decision(tables, insider, {"query": "podcast launches"})
    assert trace.startswith("3 versions from first to last") and trace.index("May 4") < trace.index("May 18") < trace.index("June 1") and "CURRENT" in trace
    assert ask.trace_decision(tables, nobody, {"fact_id": "fact:none"}).startswith("No fact that you may read")
    owners = ask.find_owner(tables, insider, {"query": "podcast launches"})
    assert "Mira Solano" in owners and "known by" in owners
    path = ask.path_between(tables, insider, {"from": "Mira Solano", "to": "#c1 — Decision: the podcast launches on May 18."})
    assert path.startswith("1 path between Mira Solano (Person) and #c1") and "2 hops." in path and "<-OWNED_BY-" in path and "-DERIVED_FROM->" in path
    assert "No readable node" in ask.path_between(tables, nobody, {"from": "Mira Solano", "to": "Budget sync"})
    assert "Give one of them in full" in ask.path_between(tables, nobody, {"from": "Alex", "to": "Mira Solano"})
    with pytest.raises(ask.ToolError):
        ask.search_knowledge(tables, nobody, {"query": " "})


def test_http(tables):
    running = serve.server(tables, port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()

    def call(path, body=None, **headers):
        request = urllib.request.Request(f"http://127.0.0.1:{running.server_port}{path}", None if body is None else json.dumps(body).encode(), {k.replace("_", "-"): v for k, v in headers.items()})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    status, got = call("/api/ask", {"question": "When does the podcast launch?"}, X_Grants="slack:C2")
    assert status == 200 and got["grounded"] and got["citations"] == [1]
    status, got = call("/api/retrieve", {"question": "podcast launches", "limit": 2, "grants": ["slack:C2"]})
    assert status == 200 and len(got["facts"]) == 2 and not any("June 1" in f["statement"] for f in got["facts"])
    assert call("/api/retrieve", {"question": " "})[0] == 400 and call("/api/none", {})[0] == 404
    assert call("/api/health") == (200, {"healthy": True, "components": [r.asDict() for r in load.doctor(tables).collect()]})
    running.shutdown()


def test_notes(spark, tables, tmp_path):
    rows = export.notes(tables)
    export.write_notes(rows, str(tmp_path))
    kinds = {f: len(list((tmp_path / f).iterdir())) for f in export.FOLDERS}
    assert kinds["Facts"] == 4 and kinds["People"] >= 5 and kinds["Episodes"] == 8
    note = (tmp_path / "Facts/the podcast launches on May 4.md").read_text()
    assert "current: false" in note and "> [!note] Replaced on 2026-03-31" in note and "## Replaced by\n\n- [[the podcast launches on May 18]]" in note
    assert "## Facts owned" in (tmp_path / "People/Mira Solano.md").read_text()
    assert "- [[c]], 2 before it\n  - [[b]]\n  - [[a]]\n" in export.index_note("All", {"Facts": 5}, [("c", ["b", "a"])])
    index = export.index(tables, rows, "Index").first()["note"]
    assert "- Facts: 4\n" in index and "- [[the podcast launches on June 1]], 2 before it\n  - [[the podcast launches on May 18]]\n" in index
    export.write_notes(export.index(tables, rows, "Index"), f"file://{tmp_path}")
    assert (tmp_path / "Index.md").read_text() == index


def test_evaluation_and_command_line(spark, tables, tmp_path, capsys):
    questions = spark.createDataFrame(
        [("Q1", "When does the podcast launch?", ["slack:C2"], "the podcast launches on June 1.", ["F1"], [], [], ""), ("Q2", "podcast launch", [], "x", [], [], [], "")],
        "id string, question string, principal array<string>, expected string, expected_facts array<string>, must_not_say array<string>, must_not_lead_with array<string>, trap string",
    )
    graded = evaluate.grade_questions(tables, questions)
    assert {r["id"]: r["verdict"] for r in graded.collect()}["Q2"] == "FORBIDDEN" and evaluate.exit_code(graded) == 1
    run_fact = ("DECISION", "the podcast launches on May 4.", None, [], "2026-02-11", None, "AGREED", [], [("e", 0, "q")], 0.9)
    run = spark.createDataFrame([("e", [run_fact], [(run_fact, [("REJECT", "evidence.verbatimSpan", "ungrounded")])], [], "p", "PT1S", 1, 1)], schemas.RUN)
    gold = spark.createDataFrame([("F1", "DECISION", "the podcast launches on May 4", ["e"]), ("F2", "RISK", "nothing like it", ["e"])], "id string, type string, statement string, sources array<string>")
    total = evaluate.score_run(run, gold)["total"].first()
    assert (total["gold"], total["strict_recall"], total["grounding_reject_rate"]) == (2, 0.5, 0.5)
    root = write_corpus(tmp_path / "corpus")
    assert main(["load", "--graph", f"{tmp_path}/graph", "--corpus", root]) == 0
    assert main(["ask", "--graph", f"{tmp_path}/graph", "When", "does", "the", "podcast", "launch?"]) == 0
    assert main(["doctor", "--graph", f"{tmp_path}/graph"]) == 0
    assert "[1]" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    rows = [("k", "a", day("2026-01-01")), ("k", "b", day("2026-02-01")), ("q", "c", day("2026-01-01"))]
    late = [("k", "d", day("2026-01-15")), ("k", "e", day("2026-03-01"))]
    schema = "key string, fact_id string, at timestamp"
    for i, part in enumerate((rows, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    out = []
    for i in range(2):
        spark.read.parquet(f"{tmp_path}/in{i}").write.mode("append").parquet(f"{tmp_path}/src")
        query = versions.closures(spark.readStream.schema(schema).parquet(f"{tmp_path}/src")).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted((r["fact_id"], str(r["valid_to"])[:10], r["superseded_by"], r["late"]) for r in out) == [("a", "2026-02-01", "b", False), ("b", "2026-03-01", "e", False), ("d", "2026-02-01", "b", True)]
