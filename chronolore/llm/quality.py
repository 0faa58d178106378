"""Quality by a kernel classifier (operator 11): random Fourier features of document statistics, ridge scores from partition-summed normal
equations, isotonic calibration.

Each whole text becomes STATISTICS (lengths, shares of kinds of characters, repetition of words and lines, the worst line of each kind). Standardised,
they go through WIDTH random cosines, whose inner products approximate a Gaussian kernel, rounded to 1 / UNIT. Every labelled row of the
folds that are learned from is used (crc32(doc_id as text) mod FOLDS is not HELD_OUT; no sample is taken): each task adds up its own normal equations, integers and
so the same in any order, and Spark sums the tasks' rows. What reaches the driver is of one size, whatever the table's: for each of LENGTHS and PARTS
a matrix of WIDTH + 1 squared.

Kernel length and ridge penalty are those of the least squared error where each part of the rows is predicted from the others, calculated from the sums alone.
The rows' raw scores, each from the model of the other parts, are counted in BINS and made monotone by pooling adjacent violators: the calibrated
score is the share of label 1 there, straight lines between pools. TILT of the raw score is mixed in, so that no two raw scores within its range become one.

Labels, lang, source and doc_id are never inputs of a score. Nulls and edges: a null text counts as an empty one, whose statistics are all zero, and has its
score. A null doc_id has no fold: it is neither learned from nor held out. Of several labels of one id the least counts; null labels are none. With no
labelled row every score is 0.5, with labels of one kind that label. Rows stay rows; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolore.llm.common import cut, given_back, words_in_blocks

FOLDS, HELD_OUT = 3, 1
WIDTH, SEED, UNIT = 256, 11, 1 << 12
#: Kernel lengths, as multiples of the square root of the number of statistics, and ridge penalties a row, to choose from; parts for that choice.
LENGTHS, PENALTIES, PARTS = (0.35, 0.7, 1.4), (1e-6, 1e-5, 1e-4, 1e-3, 1e-2), 4
#: Raw scores are binned from LOW to HIGH; rows of a task that adds up normal equations.
LOW, HIGH, BINS, TILT = -0.5, 1.5, 4096, 1e-4
ROWS_A_TASK = 50_000
#: Standardised statistics are kept within so many deviations; a line of fewer words is no worst line.
FURTHEST, LEAST_WORDS = 6.0, 3

UPPER, LOWER, DIGITS, SYMBOLS, MARKS, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~|<>{}[]\\/=+_`", b"!?", b".,;:"
STATISTICS = [
    "bytes", "words", "lines", "word_bytes", "line_words", "upper", "digits", "symbols", "marks", "stops", "beyond_ascii", "again", "distinct_words", "commonest_word", "repeated_lines", "one_byte_words",
    "worst_again", "worst_upper", "worst_symbols", "worst_marks",
]


def remainder(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def but(kept: bytes) -> bytes:
    """The bytes that translate() must delete so that these are left."""
    return bytes(b for b in range(256) if b not in kept)


NO_UPPER, NO_SYMBOLS, NO_MARKS = but(UPPER), but(SYMBOLS), but(MARKS)


def lines_of(text: bytes) -> Iterator[bytes]:
    start = 0
    while start <= len(text):
        end = text.find(b"\n", start)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end + 1


def byte_counts(text: bytes, size: int = 1 << 20) -> np.ndarray:
    total = np.zeros(256, np.int64)
    for start in range(0, len(text), size):
        total += np.bincount(np.frombuffer(text, np.uint8, min(size, len(text) - start), start), minlength=256)
    return total


def statistics(text: bytes | None) -> list[float]:
    """STATISTICS of a whole text. A huge text's words are listed a megabyte at a time."""
    text, seen, kinds = text or b"", Counter(), set()
    words = lines = doubled = single = 0
    worst = [0.0] * 4
    for line in lines_of(text):
        n = again = 0
        last = None
        for part in words_in_blocks(line):
            if part:
                seen.update(part)
                n += len(part)
                again += sum(map(eq, part, part[1:])) + (last == part[0])
                last = part[-1]
        if not n:
            continue
        lines, words, doubled = lines + 1, words + n, doubled + again
        kinds.add(hash(line))
        if n >= LEAST_WORDS:
            own = (again / n, *(len(line.translate(None, gone)) / len(line) for gone in (NO_UPPER, NO_SYMBOLS, NO_MARKS)))
            worst = list(map(max, worst, own))
    if not words:
        return [0.0] * len(STATISTICS)
    count = byte_counts(text)
    share = lambda kept: float(count[np.frombuffer(kept, np.uint8)].sum()) / len(text)
    upper, lower = share(UPPER), share(LOWER)
    single = sum(n for w, n in seen.items() if len(w) == 1)
    filled = len(text) - int(count[[9, 10, 11, 12, 13, 32]].sum())
    return [
        log1p(len(text)), log1p(words), log1p(lines), log1p(filled / words), log1p(words / lines), upper / (upper + lower) if upper + lower else 0.0, share(DIGITS), share(SYMBOLS), share(MARKS), share(STOPS), float(count[128:].sum()) / len(text),
        doubled / words, log1p(len(seen)) / log1p(words), max(seen.values()) / words, 1 - len(kinds) / lines, single / words, *worst,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """Rows doc_id, x (the statistics of the whole text)."""

    @F.pandas_udf("array<double>")
    @given_back
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series([statistics(t) for t in text], dtype=object)

    return docs.select("doc_id", run(F.col("text").cast("binary")).alias("x"))


def directions(length: float) -> tuple[np.ndarray, np.ndarray]:
    """The random frequencies and phases of a kernel length."""
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(len(STATISTICS), WIDTH)) / (length * len(STATISTICS) ** 0.5), rng.uniform(0, 2 * np.pi, WIDTH)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, length: float) -> np.ndarray:
    """Random Fourier features of rows of statistics as whole numbers (as doubles), a constant last."""
    w, phase = directions(length)
    return np.column_stack([np.rint(np.cos(np.clip((x - mean) / scale, -FURTHEST, FURTHEST) @ w + phase) * UNIT), np.full(len(x), UNIT)])


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Model:
    """Raw score: features(x, mean, scale, length) @ weights. Calibrated: straight lines through (at, value). A constant, if weights is None."""

    mean: np.ndarray
    scale: np.ndarray
    length: float
    weights: np.ndarray | None
    at: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(features(x[i : i + 4096], self.mean, self.scale, self.length) @ self.weights for i in range(0, len(x), 4096))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.value[0])
        raw = self.raw(x)
        tilt = (np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW)
        return np.clip((1 - TILT) * np.interp(raw, self.at, self.value) + TILT * tilt, 0, 1)


def constant(value: float) -> Model:
    none = np.zeros(len(STATISTICS))
    return Model(none, none + 1, 1.0, None, np.zeros(1), np.array([value]))


def pooled(x: np.ndarray, ones: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators, x ascending: the mean place and the share of ones of each pool."""
    pools: list[list[float]] = []
    for a, o, c in zip(x, ones, count, strict=True):
        pools.append([a * c, o, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    place, o, c = np.array(pools, np.float64).T
    return place / c, o / c


def equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """(number of the length, part) -> normal equations of features and label: sums of products, the label's row and column last. rows: x, y, part."""

    @given_back
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LENGTHS), PARTS, WIDTH + 2, WIDTH + 2), np.int64)
        for batch in batches:
            x, y, part = rows_of(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for start in range(0, len(x), 4096):
                own = slice(start, start + 4096)
                for k, length in enumerate(LENGTHS):
                    z = np.column_stack([features(x[own], mean, scale, length), y[own] * float(UNIT)])
                    for p in range(PARTS):
                        mine = z[part[own] == p]
                        total[k, p] += (mine.T @ mine).astype(np.int64)  # below 2^53, so exact
        for k in range(len(LENGTHS)):
            for p in range(PARTS):
                n = len(total[k, p])
                offsets = pa.array(np.arange(0, n * n + 1, n), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array([p] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(total[k, p].ravel()))], names=["k", "p", "i", "row"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(rows_of(c).sum(axis=0) for c in part.column("row").chunks if len(c))
        return pa.table({"k": part.column("k")[:1], "p": part.column("p")[:1], "i": part.column("i")[:1], "row": pa.array([total], pa.list_(pa.int64()))})

    told = "k int, p int, i int, row array<long>"
    found = rows.select("x", "y", "part").mapInArrow(sums, told).groupBy("k", "p", "i").applyInArrow(add, told).toArrow().sort_by([("k", "ascending"), ("p", "ascending"), ("i", "ascending")])
    all_rows = rows_of(found.column("row").combine_chunks()) if len(found) else np.zeros((0, WIDTH + 2), np.int64)
    n = WIDTH + 2
    return {(k, p): all_rows[(k * PARTS + p) * n : (k * PARTS + p + 1) * n].astype(np.float64) / UNIT**2 for k in range(len(LENGTHS)) for p in range(PARTS)} if len(found) else {}


def solved(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights from normal equations; the constant is not held small."""
    a, b = sums[:-1, :-1], sums[:-1, -1]
    hold = np.full(len(b), penalty * max(a[-1, -1], 1.0))
    hold[-1] = 1e-9
    return np.linalg.solve(a + np.diag(hold), b)


def missed(sums: np.ndarray, w: np.ndarray) -> float:
    """The squared error of weights over the rows of normal equations."""
    v = np.append(w, -1.0)
    return float(v @ sums @ v)


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model of the labels' column for stats (measured(), computed once: it is read several times)."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("double")).alias("y")).where(remainder(F.col("doc_id")) != HELD_OUT)
    rows = cut(stats.join(marks, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part")))
    at = range(len(STATISTICS))
    n, ones, *moments = rows.agg(F.count(F.lit(1)), F.sum("y"), *[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in at]).first()
    if not n or ones in (0, n):
        return constant(0.5 if not n else ones / n)
    # Six digits: sums of doubles differ in their last ones from run to run.
    mean, scale = (np.array([float(f"{m:.6g}") for m in moments[i : i + len(at)]]) for i in (0, len(at)))
    scale[scale < 1e-9] = 1.0
    few = rows.repartition(-(-n // ROWS_A_TASK))
    sums = equations(few, mean, scale)

    def rest(k: int, p: int) -> np.ndarray:
        return sum(sums[k, q] for q in range(PARTS) if q != p)

    _, k, penalty = min((sum(missed(sums[k, p], solved(rest(k, p), penalty)) for p in range(PARTS)), k, penalty) for k in range(len(LENGTHS)) for penalty in PENALTIES)
    others = [solved(rest(k, p), penalty) / UNIT for p in range(PARTS)]
    length = LENGTHS[k]

    @given_back
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, part = rows_of(batch.column(0)), batch.column(2).to_numpy()
            raw = np.zeros(len(x))
            for start in range(0, len(x), 4096):
                own = slice(start, start + 4096)
                z = features(x[own], mean, scale, length)
                raw[own] = np.select([part[own] == p for p in range(PARTS)], [z @ w for w in others])
            bins = np.clip(np.rint((raw - LOW) / (HIGH - LOW) * BINS), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "y"])

    counted = few.select("x", "y", "part").mapInArrow(place, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()
    at, value = pooled(LOW + counted["bin"].to_numpy() * (HIGH - LOW) / BINS, counted["ones"].to_numpy(float), counted["n"].to_numpy(float))
    return Model(mean, scale, length, solved(sum(sums[k, p] for p in range(PARTS)), penalty) / UNIT, at, value)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """Rows doc_id, held_out, score, predicted of measured() documents."""

    @F.pandas_udf("double")
    @given_back
    def scores(given: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in given:
            yield pd.Series(model.score(np.array(x.tolist(), np.float64).reshape(len(x), -1)) if len(x) else [], dtype="float64")

    held_out = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))
    rows = stats.select("doc_id", held_out.alias("held_out"), scores("x").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def rate(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Learned from docs and labels, and every row of docs scored; each text is read once."""
    stats = cut(measured(docs))
    return score(stats, learn(stats, labels, label))
