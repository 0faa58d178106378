"""Tools as SQL: the table functions give what the plans give, through one reader's eyes."""

from __future__ import annotations

import pytest
from fixtures import write_corpus
from pyspark.sql import functions as F

from chronolore.operators import models
from chronolore.plans import ask, load, sql_tools


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sql")
    found, people = load.read_corpus(spark, write_corpus(root / "corpus"))
    accepted, _ = load.accept(models.marker_extractor(found.utterances), found.utterances)
    load.write(load.build(found, people, accepted, load.Slots(least_similarity=0.6)), str(root / "graph"))
    t = load.read(spark, str(root / "graph"))
    # One fact that only holders of a grant may read.
    hidden = F.when(F.col("statement").contains("May 4"), F.array(F.lit("team:x"))).otherwise(F.array().cast("array<string>"))
    t = t | {"facts": t["facts"].withColumn("acl_grants", hidden)}
    sql_tools.publish(t, ask.Reader("x", ["team:x"]), "all_")
    sql_tools.publish(t, None, "open_")
    return t


READERS = {"all_": ask.Reader("x", ["team:x"]), "open_": ask.Reader()}


@pytest.mark.parametrize("p", READERS)
@pytest.mark.parametrize("as_of", [None, "2026-03-20"])
def test_search_is_retrieval(spark, tables, p, as_of):
    question = "when does the podcast launch?"
    want = ask.retrieve(tables, question, READERS[p], as_of).select("rank", "fact_id", F.round("score", 9)).collect()
    vector = F.lit([float(x) for x in models.hashing_embedder([question])[0]])
    got = spark.sql(f"SELECT rank, fact_id, round(score, 9) FROM {p}search_knowledge(:q, :v, CAST(:at AS TIMESTAMP), 8)", args={"q": question, "v": vector, "at": as_of}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_embed_in_sql(spark, tables):
    row = spark.sql("SELECT all_embed('podcast launch') AS v").first()
    assert row["v"] == pytest.approx([float(x) for x in models.hashing_embedder(["podcast launch"])[0]])


def test_words_alone_and_nothing_asked(spark, tables):
    found = lambda q: {r["statement"] for r in spark.sql("SELECT statement FROM all_search_knowledge(:q, NULL, NULL, 8)", args={"q": q}).collect()}
    assert "the podcast launches on June 1." in found("podcast")
    assert found("") == found("the and for") == set()


def test_what_a_reader_may_not_see_is_nowhere(spark, tables):
    at = lambda p: {r["statement"] for r in spark.sql(f"SELECT statement FROM {p}facts_at(NULL)").collect()}
    assert {s for s in at("all_") - at("open_")} == {"the podcast launches on May 4."}
    newest = tables["facts"].where("statement LIKE '%June 1.'").first()["fact_id"]
    depths = lambda p: sorted(r["depth"] for r in spark.sql(f"SELECT depth FROM {p}trace_decision(:f)", args={"f": newest}).collect())
    assert depths("all_") == [-2, -1, 0] and depths("open_") == [-1, 0]
    gone = tables["facts"].where("statement LIKE '%May 4.'").first()["fact_id"]
    assert spark.sql("SELECT * FROM open_trace_decision(:f)", args={"f": gone}).count() == 0


def test_facts_at_each_moment_by_lateral(spark, tables):
    facts = tables["facts"].where("valid_to > valid_from").select("fact_id", "valid_from").collect()
    got = spark.sql("SELECT f.fact_id, h.fact_id AS other FROM all_facts f, LATERAL all_facts_at(f.valid_from) h").collect()
    assert {(r["fact_id"], r["fact_id"]) for r in facts} <= {tuple(r) for r in got}


def test_owner(spark, tables):
    owned = tables["ownership"].where("person_id IS NOT NULL").join(tables["facts"], "fact_id").first()
    got = spark.sql("SELECT person_id, n_facts FROM all_find_owner(:q, NULL, 8)", args={"q": owned["statement"]}).collect()
    assert owned["person_id"] in {r["person_id"] for r in got}


def test_empty_tables(spark, tables):
    sql_tools.publish({n: df.limit(0) for n, df in tables.items()}, None, "none_")
    for call in ("facts_at(NULL)", "search_knowledge('podcast', NULL, NULL, 8)", "trace_decision('x')", "find_owner('podcast', NULL, 8)"):
        assert spark.sql(f"SELECT * FROM none_{call}").count() == 0
