"""BM25 from blocks, stored or made, against a plain pass over all documents; few (question, block) pairs are evaluated."""

import math
import random
import re
from collections import Counter

import pytest

from chronolore.operators import text_index

WORDS = [f"word{i}" for i in range(40)]


def table(n=150, seed=1):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(40)], k=rng.choice([1, 3, 8, 30])))) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (n + 2, "-- ?!"), (n + 3, "word7"), (n + 4, "word7"), (n + 5, "Word7 wörd " * 300)]


QUESTIONS = [("q1", "word1 word2"), ("q2", "word39 and word7, WORD7"), ("q3", "nothing here"), ("q4", None), ("q5", "wörd"), ("q6", "of it"), ("q7", " ".join(WORDS))]


def plain(docs, questions, k):
    tok = {i: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for i, t in docs}
    n, average = len(docs), sum(map(len, tok.values())) / max(len(docs), 1) or 1.0
    out = []
    for q, text in questions:
        scores = Counter()
        for term in {w for w in re.split(r"[\W_]+", (text or "").lower()) if len(w) > 2} - {"and"}:
            df = sum(term in w for w in tok.values())
            for i, w in tok.items():
                if tf := w.count(term):
                    scores[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        found = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


def same(a, b):
    return [x[:3] for x in a] == [x[:3] for x in b] and all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("words", "docs_of_block", "scores"), [(1 << 17, 4096, 1 << 22), (40, 5, 1 << 22), (100, 3, 7)])
def test_against_plain(spark, tmp_path, monkeypatch, words, docs_of_block, scores):
    monkeypatch.setattr(text_index, "BLOCK_WORDS", words)
    monkeypatch.setattr(text_index, "BLOCK_DOCS", docs_of_block)
    monkeypatch.setattr(text_index, "SCORES", scores)
    docs = table()
    df, asked = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(QUESTIONS, "query_id string, question string")
    index = text_index.build(df, str(tmp_path), "id", "text")
    for k in (1, 4, 500):
        want = plain(docs, QUESTIONS, k)
        assert same(got(text_index.bm25_top(None, asked, k, "id", "text", index)), want)
        assert same(got(text_index.bm25_top(df, asked, k, "id", "text")), want)
    some = [d for d in docs if d[0] % 3]
    allowed, want = df.where("id % 3 > 0").select("id"), plain([d for d in docs if d[0] % 3], QUESTIONS, 5)
    assert some and same(got(text_index.bm25_top(None, asked, 5, "id", "text", text_index.read(spark, str(tmp_path), "id"), allowed)), want)
    assert same(got(text_index.bm25_top(df, asked, 5, "id", "text", allowed=allowed)), want)


def test_parts_of_questions(spark, monkeypatch):
    monkeypatch.setattr(text_index, "MOST_PAIRS", 10)
    docs = table(60)
    df, asked = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(QUESTIONS, "query_id string, question string")
    assert same(got(text_index.bm25_top(df, asked, 3, "id", "text")), plain(docs, QUESTIONS, 3))


def test_string_ids_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([("b", "word1"), ("a", "word1"), (None, "word1")], "id string, text string")
    asked = spark.createDataFrame([(1, "word1")], "query_id int, question string")
    index = text_index.build(df, str(tmp_path / "x"), "id", "text")
    assert [r["id"] for r in text_index.bm25_top(None, asked, 5, "id", "text", index).orderBy("rank").collect()] == ["a", "b"]
    empty = text_index.build(df.limit(0), str(tmp_path / "y"), "id", "text")
    assert text_index.bm25_top(None, asked, 5, "id", "text", empty).count() == 0
    assert text_index.bm25_top(df, asked.limit(0), 5, "id", "text").count() == 0
    assert text_index.bm25_top(None, asked, 5, "id", "text", index, df.limit(0).select("id")).count() == 0
