"""Facts held at many moments, sessions, differences of runs, and what calls of a model cost."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronolore.operators import models, temporal
from chronolore.sources import episodes, runs

START = dt.datetime(2026, 1, 1)


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("span", [3, 1000, 10_000_000])
def test_held_at_each_moment(spark, span):
    rng = random.Random(span)
    facts = [(f"f{i}", i % 3, at(a := rng.uniform(0, span)), at(None if i % 5 == 0 else a + rng.choice([0, 0.4, 1, span / 7, span]))) for i in range(120)] + [("none", 1, None, None)]
    moments = [(i, i % 4, at(rng.choice([rng.uniform(-span, 3 * span), (facts[i][2] - START).total_seconds()]))) for i in range(80)] + [(99, 1, None)]
    f, m = spark.createDataFrame(facts, "fact_id string, k int, valid_from timestamp, valid_to timestamp"), spark.createDataFrame(moments, "no int, k int, moment timestamp")
    got = sorted((r["no"], r["fact_id"]) for r in temporal.held_at_each(f, m, ["k"]).collect())
    assert got == sorted((n, i) for n, k, t in moments for i, own, a, b in facts if t and a and k == own and a <= t and (b is None or t < b)) and got
    assert "NestedLoop" not in temporal.held_at_each(f, m, ["k"])._jdf.queryExecution().toString()
    assert temporal.held_at_each(f.limit(0), m, ["k"]).count() == temporal.held_at_each(f, m.limit(0), ["k"]).count() == 0


def test_sessions(spark):
    rows = [("a", at(s)) for s in (0, 50, 110, 170, 231, 1000)] + [("b", at(5)), ("b", at(5)), ("c", None)]
    got = {(r["k"], r["started"], r["ended"], r["n"]) for r in episodes.sessions(spark.createDataFrame(rows, "k string, at timestamp"), ["k"], "at", "60 seconds").collect()}
    assert got == {("a", at(0), at(170), 4), ("a", at(231), at(231), 1), ("a", at(1000), at(1000), 1), ("b", at(5), at(5), 2)}


def test_difference_counts_repeats(spark):
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "x string")
    got = {(r["x"], r["side"], r["n"]) for r in runs.difference(frame(["a", "a", "a", "b", None]), frame(["a", "c", "c", None])).collect()}
    assert got == {("a", "gone", 2), ("b", "gone", 1), ("c", "new", 2)}


def test_calls_are_counted(spark):
    """Tokens as the model tells them or by its characters; failures are tried again, and told."""

    def chat(prompts):
        state.setdefault("n", 0)
        state["n"] += 1
        if prompts[0] == "never" or (prompts[0] == "second" and state["n"] % 2):
            raise ValueError("busy")
        return [{"answer": "x" * 9, "input_tokens": 5, "output_tokens": 2}] if prompts[0] == "tells" else ["x" * 9]

    state: dict = {}
    asked = spark.createDataFrame([(p,) for p in ("tells", "guess", "guess", "never")], "p string").coalesce(1)
    got = {r["p"]: (r["answer"], *r["call"]) for r in models.ask_counted(asked, "p", chat, tries=2).collect()}
    cost = {p: (a, i, o, n, f) for p, (a, _, i, o, _, n, f) in got.items()}
    assert cost == {"tells": ("x" * 9, 5, 2, 1, None), "guess": ("x" * 9, 2, 3, 1, None), "never": (None, 2, 0, 2, "ValueError: busy")}
    assert all(r["call"]["milliseconds"] >= 0 for r in models.ask_counted(asked, "p", chat).select(F.col("call")).collect())
