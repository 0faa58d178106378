"""The stored vector index against a search over all rows, with few cells read where vectors lie in clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolore.operators import search, vector_index
from test_like_pairs import clustered

SCHEMA = "vec_id long, embedding array<double>, grade int, at timestamp"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], i % 4, None) for i, v in enumerate(vectors)], SCHEMA)


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("cells", [1, 7, None])
def test_same_as_all_rows(spark, tmp_path, cells):
    rng = np.random.default_rng(3)
    vectors = [*clustered(150, 6, 5), *rng.normal(size=(60, 5)), *([[1.0, 2, 3, 4, 5]] * 12), None, [0.0] * 5, [0.0] * 5, [1.0, 2.0]]
    rows = table(spark, vectors)
    index = vector_index.build(rows, str(tmp_path), "vec_id", cells)
    assert index.rows.count() == len(vectors) - 1
    for k, own, allowed in ((3, False, F.lit(True)), (10, True, F.col("grade") == 1), (4, False, F.col("vec_id") > 215), (500, True, F.lit(True))):
        assert got(vector_index.search(index, rows, k, allowed=allowed, own=own)) == got(search.vector_top_all(rows.where(allowed), rows, k, "vec_id", own))
    again = vector_index.read(spark, str(tmp_path), "vec_id")
    assert got(vector_index.search(again, rows, 3)) == got(search.vector_top_all(rows, rows, 3, "vec_id"))


def test_few_cells_are_read(spark, tmp_path):
    vectors = clustered(2000, 20, 16)
    rows = table(spark, vectors)
    index = vector_index.build(rows, str(tmp_path), "vec_id")
    found, read = vector_index.search_and_cells(index, rows.where("vec_id % 10 = 0"), 5)
    assert got(found) == got(search.vector_top_all(rows, rows.where("vec_id % 10 = 0"), 5, "vec_id"))
    r = read.agg(F.avg("rows").alias("rows"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] == 200 and r["rows"] < 0.2 * len(vectors), r


def test_empty(spark, tmp_path):
    rows = table(spark, [])
    index = vector_index.build(rows, str(tmp_path), "vec_id")
    assert vector_index.search(index, table(spark, [[1.0, 0.0]]), 3).count() == 0
    index = vector_index.build(table(spark, [[1.0, 0.0]]), str(tmp_path / "one"), "vec_id")
    assert vector_index.search(index, rows, 3).count() == 0


def test_questions_go_to_blocks_of_cells(spark, tmp_path, monkeypatch):
    """Where vectors lie evenly a question wants nearly all cells, and goes with its vector to a few blocks of them, not to each; what is worse than its k-th best of the
    nearest cells doesn't leave a block."""
    monkeypatch.setattr(vector_index, "WIDE", 150)
    monkeypatch.setattr(vector_index, "FEWEST", 20)
    vectors = [*np.random.default_rng(6).normal(size=(500, 8)), *([[1.0] * 8] * 170), [0.0] * 8, [2.0], None]
    rows, sent, told = table(spark, vectors), [], []
    index = vector_index.build(rows, str(tmp_path), "vec_id", 25)
    plain = search.best_of_blocks

    def best_of_blocks(left, right, *more):
        sent.append(right.count())
        told.append(plain(left, right, *more))
        return told[-1]

    monkeypatch.setattr(vector_index, "best_of_blocks", best_of_blocks)
    for allowed in (F.lit(True), F.col("grade") == 1, F.col("vec_id") > 668):
        sent.clear(), told.clear()
        assert got(vector_index.search(index, rows, 5, allowed=allowed)) == got(search.vector_top_all(rows.where(allowed), rows, 5, "vec_id"))
        cells, rows_there, blocks = index.cells.count(), 672, vector_index.blocks_of([c.asDict() for c in index.cells.collect()])[2]
        assert cells >= 20 and blocks <= 9 and sum(sent) < rows_there * (blocks + 4)
    assert vector_index.blocks_of([{"cell": i, "n": n} for i, n in enumerate([100, 50, 1, 400, 20, 130])])[0].tolist() == [0, 0, 1, 2, 5, 5]
