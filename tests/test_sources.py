import datetime as dt

import pytest
from fixtures import write_corpus
from pyspark.sql import functions as F

from chronolore import schemas
from chronolore.operators import acl, resolve
from chronolore.plans import load
from chronolore.sources import chat, directory, episodes, meetings, pages, plugin, runs


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return write_corpus(tmp_path_factory.mktemp("corpus"))


@pytest.fixture(scope="module")
def corpus(spark, root):
    return load.read_corpus(spark, root)


def rows(df, *columns, order=None):
    return [tuple(r) for r in df.orderBy(*(order or columns)).select(*columns).collect()]


def test_threads(spark, root):
    found = chat.read(spark, root)
    assert rows(found.episodes, "episode_id", "title", "visibility", "acl_grants") == [
        ("slack:C1/1770800000.000100", "#c1 — Decision: the podcast launches on May 4.", "PUBLIC", []),
        ("slack:C1/1775000000.000000", "#c1 — Decision: the podcast launches on May 18.", "PUBLIC", []),
        ("slack:C2/1778000000.000000", "#c2 — Decision: the podcast launches on June 1.", "RESTRICTED", ["slack:C2"]),
        ("slack:C3/1.0", "#quiet", "PUBLIC", []),
    ]
    said = found.utterances.where("episode_id = 'slack:C1/1770800000.000100'")
    assert rows(said, "ordinal", "raw_id", "speaker") == [(0, "U1", "mira"), (1, "U2", ""), (2, "U9", "U9")]
    assert found.episodes.where("external_id = 'C3/1.0'").first()["occurred_at"] == dt.datetime(1970, 1, 1)
    long = spark.createDataFrame([("x " * 60,)], "t string").select(chat.thread_title(F.lit("c"), F.col("t")).alias("v")).first()["v"]
    assert len(long) == len("#c — ") + 70 and long.endswith("...")


def test_transcripts(spark, root):
    found = meetings.read(spark, root)
    said = rows(found.utterances.where("episode_id = 'zoom:m-77'"), "ordinal", "speaker", "at", "text")
    at = lambda s: dt.datetime(2026, 3, 2, 10) + dt.timedelta(seconds=s)
    assert said == [
        (0, "Mira Solano", at(1), "We start with the budget. Decision: the budget stays at forty thousand."),
        (1, "Speaker 2", at(62.25), "Fine by me, as long as this holds: no travel."),
        (2, "Unknown", at(70), "a remark without any name that is long enough to put this colon: far away"),
    ]
    assert rows(found.episodes, "episode_id", "title", "acl_grants") == [("zoom:m-77", "Budget sync", ["zoom:ops"]), ("zoom:orphan", "orphan", [])]
    assert {r["raw_id"] for r in found.utterances.collect()} >= {"budget:Speaker 2", "orphan:Ann"}


def test_pages(spark, root):
    found = pages.read(spark, root)
    assert rows(found.utterances.where("episode_id = 'notion:page-9'"), "ordinal", "raw_id", "text") == [
        (0, "Jun Park", "# Studio plan\n## Decision\nCommitment: Jun delivers the acoustic panels\nby April 20."),
        (1, "Jun Park", "Plain words."),
        (2, "Jun Park", "## Left over"),
    ]
    assert rows(found.episodes, "episode_id", "title", "occurred_at", "permalink", order=["episode_id"]) == [
        ("notion:bare.md", "bare.md", dt.datetime(1970, 1, 1), None),
        ("notion:page-9", "Studio plan: draft", dt.datetime(2026, 4, 1, 8), "https://wiki.test/page-9"),
    ]


def test_missing_folders_are_empty(spark, tmp_path):
    found, people = load.read_corpus(spark, str(tmp_path))
    assert found.episodes.count() == found.utterances.count() == people.people.count() == 0


def test_all_readers_in_time_order(spark, corpus):
    found, _ = corpus
    times = [r["occurred_at"] for r in found.by_time().collect()]
    assert times == sorted(times) and len(times) == 8
    assert rows(episodes.counts_by_system(found.episodes), "system", "episodes") == [("NOTION", 2), ("SLACK", 4), ("ZOOM", 2)]
    assert episodes.changed(found.episodes, found.episodes).count() == 0
    text = episodes.render(found.episodes, found.utterances).where("episode_id = 'zoom:m-77'").first()["rendered"]
    assert text.startswith("# Budget sync\nSource: zoom:m-77\nOccurred: 2026-03-02 10:00\n\n[0] Mira Solano (2026-03-02 10:00): We start")


def test_directory(spark, corpus):
    _, people = corpus
    got = {r["person_id"]: (r["name"], r["aliases"]) for r in people.people.collect()}
    assert set(got) == {"person:email:mira@orchard.test", "person:email:alex.brandt@orchard.test", "person:email:alex.rowe@orchard.test", "person:name:tom", "person:email:noor@partner.test", "person:name:alex rowe", "person:name:jun park"}
    assert got["person:email:mira@orchard.test"] == ("Mira Solano", ["NOTION:Mira Solano", "SLACK:Mira Solano", "SLACK:U1", "SLACK:mira", "ZOOM:Mira Solano"])
    assert rows(people.participants_of("zoom:m-77"), "name") == [("Alex Rowe",), ("Mira Solano",), ("Noor Haddad",)]
    assert [r["name"] for r in people.by_name_prefix("alex").orderBy("person_id").collect()] == ["Alex Brandt", "Alex Rowe", "Alex Rowe"]
    assert people.by_email("MIRA@orchard.test").count() == people.by_alias("SLACK", "U2").count() == 1
    assert people.by_name("alex rowe").count() == 2 and people.unattached.count() == 0


def test_author_whose_name_several_have_stays_unattached(spark):
    users = spark.createDataFrame([("U1", "a", "Sam Fox", "1@x.test", None, None), ("U2", "b", "Sam Fox", "2@x.test", None, None)], "id string, name string, real_name string, email string, display_name string, title string")
    met = spark.createDataFrame([], "episode_id string, name string, email string")
    found = directory.merge(users, met, spark.createDataFrame([("sam fox",)], "author string"))
    assert found.people.count() == 2 and found.aliases.where("system = 'NOTION'").count() == 0
    assert [tuple(r) for r in found.unattached.collect()] == [("sam fox", 2)]


def test_speakers_and_mentions(spark, corpus):
    found, people = corpus
    who = resolve.speakers(found.utterances, people)
    got = {(r["episode_id"], r["label"]): (r["person_id"], r["method"]) for r in who.collect()}
    assert got["zoom:m-77", "Mira Solano"] == ("person:email:mira@orchard.test", "HANDLE")
    assert got["zoom:m-77", "Speaker 2"] == (None, "UNRESOLVED")
    chosen = resolve.speakers(found.utterances, people, lambda asked: asked.withColumn("answer", F.when(F.col("label") == "Speaker 2", "Noor Haddad — she chairs").otherwise("Nobody Here")))
    by_label = {(r["episode_id"], r["label"]): (r["person_id"], r["method"]) for r in chosen.collect()}
    assert by_label["zoom:m-77", "Speaker 2"] == ("person:email:noor@partner.test", "LLM_ADJUDICATED")
    assert by_label["zoom:m-77", "Unknown"] == (None, "UNRESOLVED")
    said = ["alex.rowe@orchard.test", "mira solano", "Noor Haddad", "Alex Rowe", "Alex", "Mira", "Speaker 2", "Nobody", " ", "Jun", None]
    asked = spark.createDataFrame([(i, "zoom:m-77", m) for i, m in enumerate(said)], "mention_no int, episode_id string, mention string")
    out = {r["mention"]: (r["person_id"], r["method"], r["confidence"]) for r in resolve.mentions(asked, people, chosen).collect()}
    assert out["alex.rowe@orchard.test"] == ("person:email:alex.rowe@orchard.test", "EMAIL", 1.0)
    assert out["mira solano"] == ("person:email:mira@orchard.test", "HANDLE", 0.98)
    assert out["Noor Haddad"] == ("person:email:noor@partner.test", "EXACT_NAME", 0.95)
    assert out["Alex Rowe"] == (None, "UNRESOLVED", 0.0)
    assert out["Alex"] == (None, "UNRESOLVED", 0.0)
    assert out["Mira"] == ("person:email:mira@orchard.test", "EXACT_NAME", 0.95)
    assert out["Speaker 2"] == ("person:email:noor@partner.test", "LLM_ADJUDICATED", 0.7)
    assert out["Jun"] == ("person:name:jun park", "EXACT_NAME", 0.95)
    assert out["Nobody"][1] == out[" "][1] == out[None][1] == "UNRESOLVED"
    share = resolve.deterministic_share(who).first()
    assert share["certain"] == sum(1 for r in who.collect() if r["person_id"]) and share["share"] == share["certain"] / share["n"]


def test_access_is_inherited_and_needs_a_source(spark):
    rows_in = [("f", ["slack:A"], "RESTRICTED"), ("f", [], "PUBLIC"), ("f", ["zoom:B"], "PRIVATE"), ("g", [], "PUBLIC")]
    df = spark.createDataFrame(rows_in, "id string, acl_grants array<string>, visibility string")
    assert {r["id"]: (r["acl_grants"], r["visibility"]) for r in acl.inherit(df, ["id"]).collect()} == {"f": (["slack:A", "zoom:B"], "PRIVATE"), "g": ([], "PUBLIC")}
    with pytest.raises(Exception, match="nothing derives from no source"):
        acl.inherit(spark.createDataFrame([("h", None, None)], df.schema), ["id"]).collect()


def test_runs_and_keys(spark, tmp_path):
    fact = {"type": "DECISION", "statement": "s", "ownerMention": "Mira", "participantMentions": [], "occurredAt": "2026-04-08T00:00:00Z", "dueDate": "2026-05-01", "status": "AGREED", "topics": ["a"], "evidence": [{"episodeId": "e", "utteranceOrdinal": 0, "verbatimSpan": "q"}], "confidence": 0.9}
    for stamp in ("20260101-000000", "20260201-000000"):
        df = spark.createDataFrame([("e", [fact] if stamp > "202602" else [], [], [], "p", "PT1S", 10, 5)], schemas.RUN)
        df.coalesce(1).write.json(f"{tmp_path}/{stamp}/extraction.json")
    newest = runs.newest_run(spark, str(tmp_path))
    assert "20260201" in newest
    got = runs.accepted(runs.read_run(spark, newest)).collect()
    assert [(r["owner_mention"], str(r["due_date"]), r["evidence"][0]["span"]) for r in got] == [("Mira", "2026-05-01", "q")]
    (tmp_path / "q.json").write_text('{"questions": [{"id": "Q1", "question": "?", "principal": [], "expected": "x", "expected_facts": ["F1", "F9"]}]}')
    (tmp_path / "f.json").write_text('{"facts": [{"id": "F1", "type": "DECISION", "statement": "s", "owner": "Mira", "sources": ["e", "gone"]}]}')
    (tmp_path / "e.json").write_text('{"entities": [{"canonical": "Tom", "aliases": []}], "non_matches": [{"pair": ["A", "B"], "why": "two"}]}')
    facts, questions = runs.gold_facts(spark, f"{tmp_path}/f.json"), runs.gold_questions(spark, f"{tmp_path}/q.json")
    entities, non_matches = runs.gold_entities(spark, f"{tmp_path}/e.json")
    known = spark.createDataFrame([("e",)], "episode_id string")
    assert rows(runs.key_faults(facts, questions, entities, known), "kind", "holder", "missing") == [("entity", "F1", "Mira"), ("fact", "Q1", "F9"), ("source", "F1", "gone")]
    assert questions.first()["must_not_say"] == []
    names = spark.createDataFrame([("A", "p1"), ("B", "p1")], "name string, person_id string")
    assert resolve.fused_people(names, non_matches).count() == 1


def test_reader_plugin(spark):
    plugin.register_reader(spark, "toy", lambda options: ["a", "b"], lambda part, options: iter([(f"toy:{part}", 0, "FILESYSTEM", part, part, dt.datetime(2026, 1, 1), options["word"], None)]))
    got = spark.read.format("toy").option("word", "hi").load()
    assert rows(got, "episode_id", "text") == [("toy:a", "hi"), ("toy:b", "hi")]
