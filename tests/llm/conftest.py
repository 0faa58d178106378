import random

import pytest

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, size long, bucket int, fp long"


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents() -> list[tuple]:
    """Small documents with every trap: nulls, empty and very long texts, ties, repeated rows, shared passages, odd blanks."""
    shared, long = passage(1, 70), passage(2, 30_000)
    texts = [
        None, "", "   \t\n", "one", "one two three", shared, f"{passage(3, 20)} {shared} {passage(4, 30)}", f"{shared} {passage(5, 5)}", passage(6, 49), passage(6, 49), passage(6, 50), passage(6, 50),
        long, f"{passage(7, 10)}\n{long}", "Ünï códe\x85x\xa0y\x1cz", "a\x0bb\x0cc\rd", shared.upper(), passage(8, 120), passage(8, 120).replace(" ", "\n"), passage(8, 119), "\x00nul �", "idiot moron scum " + passage(9, 40),
        " ".join([passage(10, 60)] * 3), passage(10, 60),
    ]
    rows = [(i * 3 % 29, t, "en", [None, "b", "a", "é"][i % 4], len(t or ""), "x", i, i, i) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, shared, "en", None, 1, None, None, None, None), (None, shared, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def traps(spark):
    return spark.createDataFrame(documents(), DOC_SCHEMA)
