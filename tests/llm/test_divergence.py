"""Operator 12 against a plain version that evaluates every term, with blocks and chunks of any size."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF

from chronolore.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most_terms=50):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(SMALL))
        groups.add((lang or "", source or ""))
        count[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in {a for a, _ in groups}:
        terms = [t for t, n in df[lang].items() if n >= least]
        own = {s: {t: count[lang, s][t] for t in terms} for a, s in groups if a == lang}
        own_p = {s: {t: 1 + 1_000_000_000 * (c + 5) // (sum(n.values()) + 5 * len(terms)) for t, c in n.items()} for s, n in own.items()}
        whole = {t: sum(n[t] for n in own.values()) for t in terms}
        q = {t: 1 + 1_000_000_000 * (c + 5) // (sum(whole.values()) + 5 * len(terms)) for t, c in whole.items()}
        for s in own:
            pairs = [(sum(abs(own_p[s][t] - own_p[o][t]) for t in terms), o) for o in own if o != s]
            above = [(own_p[s][t] - q[t], t) for t in terms if own[s][t] and own_p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", above, most_terms)):
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1) if i <= most]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def given(df):
    return [(r["lang"], r["source"], r["text"]) for r in df.select("lang", "source", "text").collect()]


@pytest.mark.parametrize("least", [30, 4])
def test_against_plain(spark, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(divergence.audit(docs, least)) == plain(given(docs), least)


@pytest.mark.parametrize(("sources", "vectors", "counted"), [(3, 10, 50), (1, 4096, 1), (256, 1, 200_000)])
def test_blocks_and_chunks_change_nothing(spark, monkeypatch, sources, vectors, counted):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "VECTORS", vectors)
    monkeypatch.setattr(divergence, "COUNTED", counted)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(60)
    assert got(divergence.audit(docs, 3, 7)) == plain(given(docs), 3, 7)


def test_traps(spark, traps):
    for least in (1, 2, 99):
        assert got(divergence.audit(traps, least)) == plain(given(traps), least)
    assert divergence.audit(traps.limit(0)).count() == 0


def test_ties_and_nulls(spark):
    """Sources alike in all terms tie by name; more tied terms than are reported come in the order of their bytes; null and '' are one source."""
    words = " ".join(f"w{c}{d}" for c in "abcdefgh" for d in "klmnopqr") + " Éa éa ÉA"
    rows = [("en", s, words) for s in ("b", "a", "é", "c")] + [("en", None, words + " own" * 9), ("en", "", "own"), (None, "x", None), ("", "y", ""), ("fr", "only", words)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(divergence.audit(docs, 1)) == plain(rows, 1)
    assert got(divergence.audit(docs, 1, 5)) == plain(rows, 1, 5)


def test_equal_columns_are_evaluated_once(spark):
    docs = spark.createDataFrame([("en", s, " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20))) for s in "ab"], "lang string, source string, text string")
    kept = divergence.kept_terms(docs, 1)
    assert kept.count() == 400 and kept.select("vector").distinct().count() == 1


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 9 * 10**15 - 10**9, 500)
    count = (rng.random(500) * n).astype(np.int64)
    v = rng.integers(1, 10**6, 500)
    want = [1 + 10**9 * (int(c) + 5) // (int(a) + 5 * int(b)) for c, a, b in zip(count, n, v, strict=True)]
    assert divergence.shares(count, n, v).tolist() == want
