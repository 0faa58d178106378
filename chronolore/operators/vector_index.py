"""A stored index of vectors: cells around trained centres, written as a table partitioned by cell, searched exactly.

Every vector is in the cell of its nearest centre, and a cell reaches as far as its furthest vector. No vector of a cell is nearer to a question than the angle
to its centre less its reach. A question first reads its nearest cells, as many as hold k rows; the angle of its k-th best there is a bound, and only
cells that may hold something as near are read after that, in blocks of cells. Filters (access, a moment) are applied to what is read, before any limit; where they leave
fewer than k, all cells are read. The answer is that of a search over all rows.

Zero vectors and vectors of another length than the centres' are in a cell of their own that every question reads. Rows without a vector or an id are not in the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolore.lineage import cut
from chronolore.operators.ranks import top
from chronolore.operators.search import BLOCK, FEWEST, WIDE, best_of_blocks

#: Centres at most, vectors that they are trained on, rounds of training; the cell of what has no centre; how much angles may be off.
MOST_CELLS, SAMPLED, TRAINED, ODD, ROUNDING = 2048, 20_000, 4, -1, 1e-6
#: Pairs of a question and a cell that a task holds at once.
PIECE = 1 << 14


@dataclass
class Index:
    """rows: cell and the columns that were indexed. cells: cell, centre, reach, n; the odd cell has no centre."""

    rows: DataFrame
    cells: DataFrame
    id_col: str


def trained(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit vectors, by a few rounds of moving each to the mean of those nearest to it."""
    centres = sample[:cells].copy()
    for _ in range(TRAINED):
        at = np.concatenate([(sample[i : i + 1024] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 1024)])
        for c in range(len(centres)):
            mean = sample[at == c].sum(axis=0)
            if np.linalg.norm(mean) > 1e-9:
                centres[c] = mean / np.linalg.norm(mean)
    return centres


def unit_rows(column: pa.Array | pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of that width at length 1, and which rows have one; zero vectors and others are zeros."""
    given = [np.asarray(v, np.float64) if v is not None and len(v) == width else np.zeros(width) for v in (column.to_pylist() if isinstance(column, pa.Array | pa.ChunkedArray) else column)]
    x = np.stack(given) if given else np.zeros((0, width))
    length = np.linalg.norm(x, axis=1)
    return x / np.maximum(length, 1e-300)[:, None], length > 0


def build(rows: DataFrame, path: str, id_col: str = "fact_id", cells: int | None = None) -> Index:
    """Writes the index of rows (id_col, embedding and what filters need) and reads it. Centres are trained on SAMPLED vectors at most; their number is about
    the square root of the rows, MOST_CELLS at most, so they fit in any task."""
    there = rows.where(F.col("embedding").isNotNull() & F.col(id_col).isNotNull())
    n = there.count()
    width = (there.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first() or [1])[0]
    number = min(cells or math.isqrt(n) + 1, MOST_CELLS, SAMPLED)
    share = there.where((F.size("embedding") == width) & F.exists("embedding", lambda x: x != 0)).where(F.pmod(F.xxhash64(F.lit("centre"), id_col), F.lit(1 << 30)) < F.lit(min(1.0, 1.2 * SAMPLED / max(n, 1)) * (1 << 30)))
    sample, _ = unit_rows(share.select("embedding").limit(SAMPLED).toArrow().column("embedding"), width)
    sample = np.unique(sample, axis=0)
    np.random.default_rng(1).shuffle(sample)
    centres = trained(sample, number) if len(sample) else np.zeros((0, width))

    @F.pandas_udf("cell int, far double")
    def settle(vectors: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for given in vectors:
            x, fine = unit_rows(given, width)
            cell, far = np.full(len(x), ODD, np.int32), np.full(len(x), np.pi)
            if len(centres):
                for i in range(0, len(x), 1024):
                    cosine, ok = x[i : i + 1024] @ centres.T, fine[i : i + 1024]
                    best = cosine.argmax(axis=1)
                    cell[i : i + 1024] = np.where(ok, best, ODD)
                    far[i : i + 1024] = np.where(ok, np.arccos(np.clip(cosine[np.arange(len(best)), best], -1, 1)), np.pi)
            yield pd.DataFrame({"cell": cell, "far": far})

    placed = there.withColumn("_at", settle("embedding")).select(*rows.columns, "_at.cell", "_at.far")
    placed.repartition("cell").sortWithinPartitions("cell", "far").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark = rows.sparkSession
    schema = placed.select(*rows.columns, "far", "cell").schema
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    told = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    stored.groupBy("cell").agg(F.max("far").alias("reach"), F.count(F.lit(1)).alias("n")).join(F.broadcast(told), "cell", "left").write.mode("overwrite").parquet(f"{path}/cells")
    return Index(stored, spark.read.parquet(f"{path}/cells"), id_col)


def read(spark: SparkSession, path: str, id_col: str = "fact_id") -> Index:
    return Index(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), id_col)


def wanted_cells(index: Index, asked: DataFrame, k: int, bound: str | None) -> DataFrame:
    """id, vector, cell: the cells that each question reads. Without bound its nearest ones, as many as hold k rows besides one of its own; with it (a column
    of asked, an angle; null: no bound) all that may hold a row within it and were not among the nearest."""
    told = index.cells.toArrow().to_pylist()  # MOST_CELLS rows
    cells = np.array([c["cell"] for c in told], np.int32)
    odd = np.array([c["centre"] is None for c in told], bool)
    reach, n = np.array([c["reach"] for c in told], np.float64), np.array([c["n"] for c in told], np.int64)
    width = max((len(c["centre"]) for c in told if c["centre"]), default=1)
    centres = np.array([c["centre"] or [0.0] * width for c in told], np.float64).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE // max(1, len(cells)))
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, len(whole), step)):
            x, fine = unit_rows(batch.column(1), width)
            at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            limits = batch.column(2).to_pylist() if bound else None
            for i in range(len(x)):
                angle = np.arccos(np.clip(centres @ x[i], -1, 1))
                low = np.where(odd, 0.0, np.maximum(angle - reach, 0.0)) if fine[i] else np.zeros(len(cells))
                order = np.lexsort((cells, angle, ~odd))
                first = np.zeros(len(cells), bool)
                first[order[: int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1]] = True
                first |= odd
                if bound:
                    first = ~first & (low <= (np.inf if limits[i] is None or not fine[i] else limits[i] + ROUNDING))
                at.append(np.full(int(first.sum()), i))
                to.append(cells[first])
            at, to = np.concatenate(at), np.concatenate(to)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(to, pa.int32())], names=["id", "vector", "cell"])

    kinds = [asked.schema[c].dataType.simpleString() for c in ("id", "vector")]
    return asked.select("id", "vector", *([bound] if bound else [])).mapInArrow(run, f"id {kinds[0]}, vector {kinds[1]}, cell int")


def best_in_cells(index: Index, wanted: DataFrame, allowed: Column, k: int, own: bool) -> DataFrame:
    """The k best rows of each question in each block of its cells. Large cells are read in blocks, and questions meet them in blocks."""
    numbers = [r["cell"] for r in wanted.select("cell").distinct().collect()]  # MOST_CELLS at most: the scan reads only their folders
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sizes = index.cells.where(F.col("cell").isin(numbers)).select("cell", blocks.alias("blocks")).join(wanted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "cell")
    sizes = F.broadcast(cut(sizes))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    rows = index.rows.where(F.col("cell").isin(numbers) & allowed).join(sizes, "cell").withColumn("r", deal(index.id_col, "blocks")).withColumn("q", each("parts"))
    asked = wanted.join(sizes, "cell").withColumn("q", deal("id", "parts")).withColumn("r", each("blocks"))
    left = rows.select("cell", "r", "q", F.col(index.id_col).alias("id"), F.col("embedding").alias("vector"))
    return best_of_blocks(left, asked.select("cell", "r", "q", "id", "vector"), ["cell", "r", "q"], k, index.id_col, own)


def blocks_of(cells: list[dict]) -> tuple[np.ndarray, np.ndarray, int]:
    """For each cell (in the order of its number) its first block and how many blocks it has, and how many there are: a block has WIDE rows or fewer, of one cell or of some."""
    first, parts, block, room = [], [], -1, 0
    for c in sorted(cells, key=lambda c: c["cell"]):
        if c["n"] > room:
            block, room = block + 1, WIDE
        first.append(block)
        parts.append(max(1, math.ceil(c["n"] / WIDE)))
        block, room = block + parts[-1] - 1, room - c["n"] if parts[-1] == 1 else 0
    return np.array(first, np.int64), np.array(parts, np.int64), block + 1


def best_within(index: Index, asked: DataFrame, allowed: Column, k: int, own: bool) -> DataFrame:
    """The k best rows of each question in each block that has a cell which may hold a row within its bound (asked: id, vector, bound: an angle, floor: the score of its k-th
    best so far; null: none), and no worse than that. A question with its vector goes to blocks, not to cells: on vectors that lie evenly it wants nearly all cells, and rows
    for each would be many times the table."""
    told = sorted((c.asDict() for c in index.cells.collect()), key=lambda c: c["cell"])  # MOST_CELLS rows
    first, parts, count = blocks_of(told)
    odd, reach = np.array([c["centre"] is None for c in told], bool), np.array([c["reach"] for c in told], np.float64)
    width = max((len(c["centre"]) for c in told if c["centre"]), default=1)
    centres = np.array([c["centre"] or [0.0] * width for c in told], np.float64).reshape(-1, width)
    in_block = np.zeros((len(told), count), bool)
    for i, (a, n) in enumerate(zip(first, parts, strict=True)):
        in_block[i, a : a + n] = True

    def wanted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, fine = unit_rows(batch.column(1), width)
        limits = np.array([np.inf if v is None else v for v in batch.column(2).to_pylist()], np.float64)
        low = np.where(odd | ~fine[:, None], 0.0, np.arccos(np.clip(x @ centres.T, -1, 1)) - reach)
        # What isn't further than the bound, so that a bound that is no number leaves nothing out.
        return np.nonzero(~(low > limits[:, None] + ROUNDING) @ in_block)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE // max(1, len(told)))
        yield from (whole.slice(i, step) for whole in batches for i in range(0, len(whole), step))

    def count_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(count, np.int64)
        for batch in pieces(batches):
            n += np.bincount(wanted(batch)[1], minlength=count)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count), pa.int32()), pa.array(n)], names=["r", "n"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at, block = wanted(batch)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(block, pa.int32())], names=["id", "vector", "floor", "r"])

    kinds = [asked.schema[c].dataType.simpleString() for c in ("id", "vector")]
    spark, asked = asked.sparkSession, asked.select("id", "vector", "bound", "floor")
    counts = {r["r"]: r["n"] for r in asked.mapInArrow(count_wanted, "r int, n long").groupBy("r").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    # Questions meet a block in parts: few enough that rows don't travel often, and enough that all cores have some.
    least_parts = math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, len(counts)))
    halves = {r: max(math.ceil(n / WIDE), min(math.ceil(n / FEWEST), least_parts)) for r, n in counts.items()}
    sizes = F.broadcast(spark.createDataFrame(sorted(halves.items()), "r int, _parts int"))
    homes = F.broadcast(spark.createDataFrame([(c["cell"], int(a), int(n)) for c, a, n in zip(told, first, parts, strict=True)], "cell int, _first int, _blocks int"))
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    rows = index.rows.where(allowed).join(homes, "cell").withColumn("r", F.col("_first") + deal(index.id_col, "_blocks")).join(sizes, "r").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    sent = asked.mapInArrow(send, f"id {kinds[0]}, vector {kinds[1]}, floor double, r int").join(sizes, "r").withColumn("q", deal("id", "_parts"))
    # A stated number of tasks: pairs of blocks take long, and Spark would make few tasks of few bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(halves.values()))
    left = rows.select("r", "q", F.col(index.id_col).alias("id"), F.col("embedding").alias("vector")).repartition(tasks, "r", "q")
    return best_of_blocks(left, sent.select("r", "q", "id", "vector", "floor").repartition(tasks, "r", "q"), ["r", "q"], k, index.id_col, own)


def search(index: Index, queries: DataFrame, k: int, id_col: str | None = None, allowed: Column | None = None, own: bool = False) -> DataFrame:
    """query_id, id, score, rank: what search.vector_top_all() finds among the indexed rows for which allowed holds, for any number of queries (id_col,
    embedding). Without own, a row is no answer to the query of its own id."""
    found, _ = search_and_cells(index, queries, k, id_col, allowed, own)
    return found


def search_and_cells(index: Index, queries: DataFrame, k: int, id_col: str | None = None, allowed: Column | None = None, own: bool = False) -> tuple[DataFrame, DataFrame]:
    """search(), and rows query_id, cells, rows: how many cells each query read, and how many rows these have."""
    allowed = F.lit(True) if allowed is None else allowed
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col(id_col or index.id_col).alias("id"), F.col("embedding").alias("vector"))
    asked = cut(asked.groupBy("id").agg(F.min("vector").alias("vector")))
    first = cut(wanted_cells(index, asked, k, None))
    near = best_in_cells(index, first, allowed, k, own)
    order = [F.desc("score"), F.col(index.id_col)]
    worst = top(near, ["query_id"], order, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
    # Scores are rounded to six places before they are compared, so the bound has room for that.
    angle = F.acos(F.greatest(F.least(F.col("score") - 2e-6, F.lit(1.0)), F.lit(-1.0)))
    bounded = cut(asked.join(worst.select(F.col("query_id").alias("id"), angle.alias("bound"), F.col("score").alias("floor")), "id", "left"))
    found = top(best_within(index, bounded, allowed, k, own), ["query_id"], order, k)
    read_cells = first.select("id", "cell").unionByName(wanted_cells(index, bounded, k, "bound").select("id", "cell")).join(F.broadcast(index.cells.select("cell", "n")), "cell")
    return found, read_cells.groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"))
