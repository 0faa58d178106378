"""Quotes in long episodes: by anchors as by testing every utterance, and none has an episode to itself."""

import random

import pytest

from chronolore.functions.text import normalise
from chronolore.operators import validate
from pyspark.sql import functions as F

QUOTE = "quote_id string, episode_id string, ordinal int, span string"
SAID = "episode_id string, ordinal int, text string"


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randint(1, 8)))
    said = [(f"e{i % 3}", i // 3, " ".join(word() for _ in range(rng.choice([0, 2, 5, 40])))) for i in range(200)]
    said += [("e0", 500 + i, "the same words again, for the twelfth time") for i in range(30)] + [("e1", 7, None), ("e2", 900, "x" * 3000 + " needle in a haystack " + "y" * 3000)]
    quotes = []
    for i in range(300):
        e, o, t = rng.choice(said)
        t = t or ""
        start = rng.randint(0, max(0, len(t) - 5))
        quotes.append((f"q{i}", e, rng.choice([o, o + 1]), rng.choice([t, t[start:], t[start : start + rng.randint(1, 70)], "never said by anybody at all"])))
    return said, [*quotes, ("n", "e0", 0, None), ("s", "e0", 501, "SAME  words again"), ("l", "e2", 0, "needle in a hay"), ("u", "e9", 0, "an episode that is unknown")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_anchors_find_what_testing_finds(spark, seed):
    said, quotes = corpus(seed)
    q, u = spark.createDataFrame(quotes, QUOTE), spark.createDataFrame(said, SAID)
    got, want, some = (sorted(map(tuple, validate.locate(q, u, n).select("quote_id", "at_cited", F.coalesce("found", F.lit(-1))).collect())) for n in (0, 10**9, 5000))
    assert got == want == some and sum(r[2] >= 0 for r in got) > 60


def test_every_length_of_quote_has_anchors(spark):
    """All parts of a text of 12 characters or more are found in it."""
    text = "".join(random.Random(4).choices("abcdefgh", k=130))
    quotes = [(f"{i}-{n}", "e", 1, text[i : i + n]) for n in (12, 13, 47, 48, 49, 60, 130) for i in range(130 - n + 1)]
    plain = lambda df, *c: df.select(*c, normalise(F.col("span")).alias("_span"))
    asked = plain(spark.createDataFrame(quotes, QUOTE), "quote_id", "episode_id", "ordinal")
    said = spark.createDataFrame([("e", 1, text), ("e", 2, text + text)], "episode_id string, _said int, _text string")
    found = validate.located_by_anchors(asked, said).collect()
    assert len(found) == len(quotes) and {(r["found"], r["at_cited"]) for r in found} == {(1, True)}


def test_empty(spark):
    said, quotes = corpus()
    q, u = spark.createDataFrame(quotes, QUOTE), spark.createDataFrame(said, SAID)
    assert validate.locate(q.limit(0), u, 0).count() == 0
    assert validate.locate(q, u.limit(0), 0).where("at_cited OR found IS NOT NULL").count() == 0
