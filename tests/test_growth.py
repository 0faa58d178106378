"""Steps that must not grow faster than their tables."""

import datetime as dt

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolore.functions.vectors import cosine
from chronolore.operators import scoring, supersede, temporal, vector_index
from chronolore.plans import load
from chronolore.sources import meetings, pages

START = dt.datetime(2026, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_moments_are_not_broadcast(spark):
    """Both sides shuffle to a few bytes a row, which Spark would take for small."""
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    facts = spark.range(200).select(F.col("id").alias("fact_id"), (F.col("id") % 7).alias("k"), at(F.col("id")).alias("valid_from"), at(F.col("id") + 3).alias("valid_to"))
    asked = spark.range(50).select((F.col("id") % 7).alias("k"), at(F.col("id")).alias("moment"))
    found = temporal.held_at_each(facts, asked, ["k"])
    assert found.count() > 0 and "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)


def test_best_matches_meet_in_tiles(spark, monkeypatch):
    """The same rows as all pairs, also of odd vectors, repeated vectors and ties; pairs are no rows of a join."""
    monkeypatch.setattr(scoring, "TILE", 3)
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [0.0, 1.0], [2.0, 0.0], [1.0, 1e-6], [0.0, 0.0], [], None, [1.0, None], [1.0], [1.0, 0.0, 5.0], [nan, 1.0], [inf, 1.0], [-1.0, 0.5], [1.0, 0.0]]
    gold = spark.createDataFrame([(f"g{i}", "RISK", ["a", "b"] if i % 2 else ["b", "a", "c"], v) for i, v in enumerate(vectors)] + [("none", "RISK", None, [1.0])], "id string, type string, sources array<string>, embedding array<float>")
    found = spark.createDataFrame([("ab"[n % 2], "RISK", (5 * n) % 28 if n else None, v, f"f{n}") for n, v in enumerate(vectors * 2)], "episode_id string, type string, seq int, embedding array<float>, statement string")
    for least in (0.72, -2.0):
        got = scoring.best_matches(gold, found, least)
        wanted = gold.select(F.col("id").alias("gold_id"), F.col("embedding").alias("_g"), F.posexplode("sources").alias("_source", "episode_id"))
        pairs = wanted.join(found, "episode_id").withColumn("similarity", F.round(cosine(F.col("_g"), F.col("embedding")), 9)).where(F.col("similarity") >= least)
        best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("gold_id").orderBy(F.desc("similarity"), "_source", "seq"))).where("_n = 1")
        rows = lambda df: sorted(map(str, df.select("gold_id", "episode_id", "statement", "similarity").collect()))
        assert rows(got) == rows(best) and rows(got)
        assert "FlatMapCoGroupsInArrow" in plan(got)


def test_files_of_a_corpus_are_read_once(spark, tmp_path):
    """A folder is one path to list, however many files it has, and nothing after read_corpus() opens them again; files of other names stay out."""
    for name, text in {"zoom/a.vtt": "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nAnn: hello there", "zoom/a.meta.json": '{"uuid": "u1"}', "zoom/a.txt": "no", "notion/p.md": "# Start\n\nwords", "notion/p.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found, people = load.read_corpus(spark, f"file:{tmp_path}")
    assert sorted(r["episode_id"] for r in found.episodes.collect()) == ["notion:p.md", "zoom:u1"] and found.utterances.count() == 2
    assert all("FileScan" not in plan(df) for df in (found.episodes, found.utterances, people.people, people.aliases, people.participants))
    listed = pages.files(spark, f"file:{tmp_path}")._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation().location()
    assert listed.rootPaths().size() == 1 and listed.rootPaths().head().getName() == "notion"
    (tmp_path / "zoom/a.vtt").unlink()
    assert meetings.read(spark, f"file:{tmp_path}").episodes.isEmpty()


def test_frontmatter_reads_a_page_once(spark):
    """A page is split into lines once, not once for each line of its frontmatter; of one key the later line wins."""
    assert str(pages.frontmatter(F.col("c"))).count("split(") == 1
    texts = ["---\na: 1\nb: 2\na: 3\nno pair\n---\nc: 4", "---\na: 1\nb: x:y", "---\n---\na: 1", "a: 1", "---", ""]
    got = [dict(r["m"]) for r in spark.createDataFrame([(t,) for t in texts], "c string").select(pages.frontmatter(F.col("c")).alias("m")).collect()]
    assert got == [{"b": "2", "a": "3"}, {"a": "1", "b": "x:y"}, {}, {}, {}, {}]


def test_nothing_is_liker_than_equal(spark):
    """Above 1 no pair is like, and none meets."""
    facts = spark.createDataFrame([(f"f{i}", "RISK", START + dt.timedelta(i), [1.0, 0.0], i) for i in range(9)], "fact_id string, type string, occurred_at timestamp, embedding array<double>, seq int")
    assert supersede.dealt_cells(facts, 2.0, None, 2)[0].count() == 0 and supersede.like_pairs(facts, 2.0).isEmpty()
    assert supersede.like_pairs(facts, 1.0).count() == 36


def test_cells_of_questions_leave_in_pieces(spark, monkeypatch):
    """A question may read nearly all cells, so a batch of questions with their vectors is that many times as large when it leaves."""
    cells = spark.createDataFrame([(i, [float(i), 1.0], 3.2, 5) for i in range(20)], "cell int, centre array<double>, reach double, n long")
    asked = spark.createDataFrame([], "id long, vector array<float>, bound double")
    monkeypatch.setattr(vector_index, "PIECE", 100)
    monkeypatch.setattr(type(asked), "mapInArrow", lambda self, run, _: run)
    run = vector_index.wanted_cells(vector_index.Index(None, cells, "fact_id"), asked, 8, "bound")
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([[1.0, float(i)] for i in range(300)], pa.list_(pa.float32())), pa.array([None] * 300, pa.float64())], names=["id", "vector", "bound"])
    got = list(run(iter([batch])))
    # Each reads all cells but the two or three nearest.
    assert max(len(b) for b in got) <= 100 and sum(len(b) for b in got) > 300 * 15
    assert {n for b in got for n in b.column(0).to_pylist()} == set(range(300))


def test_a_fold_streams_its_components(spark):
    """A component that Arrow hands over in many batches, and many small ones in one task, are judged as by one pass; no component is held whole."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        at = lambda i: START + dt.timedelta(minutes=i)
        facts = [(f"{c}{i:03}", f"{c}{i:03}") for c, n in [("a", 40), *[(f"s{k}-", 3) for k in range(30)]] for i in range(n)]
        pairs = [(f"{c}{i:03}", f"{c}{j:03}", at(i), at(j), i, j, 0.9) for c, n in [("a", 40), *[(f"s{k}-", 3) for k in range(30)]] for i in range(n) for j in range(i)]
        judge = lambda old, new, _: (("SUPERSEDES", "DUPLICATE", "UNRELATED")[(int(old[-3:]) + int(new[-3:])) % 3], "x")
        df = spark.createDataFrame(pairs, "newer string, older string, newer_at timestamp, older_at timestamp, newer_seq long, older_seq long, similarity double").orderBy(F.rand(3))
        told = supersede.fold(spark.createDataFrame(facts, "fact_id string, statement string"), df, judge)
        assert "MapInArrow" in plan(told) and "FlatMapGroups" not in plan(told)
        got = {(r["newer"], r["older"], r["newer_at"], r["older_at"], r["verdict"]) for r in told.collect()}
        gone, wanted = set(), set()
        for newer, older, newer_at, older_at, *_ in sorted(pairs, key=lambda p: (p[4], -p[5])):
            if older in gone or any(w[0] == newer for w in wanted):
                continue
            verdict, _ = judge(older, newer, 0.9)
            gone |= {older} if verdict == "SUPERSEDES" else set()
            wanted.add((newer, older, newer_at, older_at, verdict))
        assert got == wanted and len(got) == 39 + 60 and told.count() == 99
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_only_the_most_recent_leaves_a_meeting(spark):
    """Proposals from what leaves the meetings are those from all like pairs, ties and null seq included; rows are as many as facts and tiles, not as pairs."""
    rows = [(f"f{i}", "RISK", START + dt.timedelta(minutes=i // 2), [1.0, i % 5 / 9], f"s{i * 7 % 60}" if i % 6 else None) for i in range(60)]
    facts = spark.createDataFrame(rows, "fact_id string, type string, occurred_at timestamp, embedding array<double>, seq string")
    told = lambda df: sorted(map(tuple, supersede.proposals(df).select("newer", "older", "older_seq", F.round("similarity", 9)).collect()), key=str)
    for tile in (4096, 16):
        few, every = supersede.like_pairs(facts, 0.8, tile=tile, latest=True), supersede.like_pairs(facts, 0.8, tile=tile)
        assert told(few) == told(every) and len(told(few)) == 58
        assert few.count() < every.count() / (20 if tile > 60 else 3)
    assert few.where("newer IS NULL").isEmpty() and supersede.like_pairs(facts, 1.0, tile=4096, latest=True).count() > 0
