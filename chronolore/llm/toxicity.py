"""Toxicity by non-negative positive-unlabelled learning (operator 8).

Features of a text: its words (lower case, cut at everything that is no letter in ASCII terms) and their beginnings of 4 and 5
characters, each present or not, and present in so many words, or in such a share of them, or not. Learned from two bounded samples, both of rows whose crc32(doc_id as text) mod FOLDS is not 0:
positives, at most MOST_POSITIVE documents labelled toxic, and unlabelled, at most MOST_UNLABELLED documents whatever their label (those
with the least hash of doc_id). The class prior is the share of toxic among all labelled rows of these folds.

A linear model is fitted in numpy to the non-negative risk: prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior *
loss(positives as 0)), with the sigmoid loss; while the second term is below zero its gradient is turned round, so the model doesn't
fit unlabelled positives away. Only features that are clearly more frequent among positives enter (select()), MOST_FEATURES at most. They are looked up
as they are, so no two share a weight.

Scoring is one pass over whole texts with the weights (bounded by MOST_FEATURES) sent to each task. Labels, lang, source and doc_id are
never inputs of a score.

Nulls and edges: null and empty texts get the score of a text without features. A null doc_id has no fold: it is neither learned from nor
held out. Labels null or of several kinds for one id count as toxic if any says so. Without positives or without unlabelled rows all scores
are 0. Rows stay rows; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolore.llm.common import cut, given_back, words_in_blocks

MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 4000, 12_000, 8192
FOLDS = 5
LEAST_POSITIVE, SIGMAS = 3, 4
#: A stem's numbers of words, and its shares of a text, from which on there is another feature.
COUNTS, RATES = (2, 3, 5), (200, 60)
REMEMBERED = 100_000
#: Bytes below 128 that are no letter become blanks; A-Z small.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def words_of(text: bytes | None) -> Counter[bytes]:
    out: Counter[bytes] = Counter()
    for words in words_in_blocks((text or b"").translate(LETTERS)):
        out.update(words)
    return out


def stems(word: bytes) -> tuple[str, ...]:
    w = word.decode("utf-8", "replace").lower()
    return (w, f"{w[:4]}*", f"{w[:5]}*")


def levels(stem: str, n: int, words: int) -> list[str]:
    """The features of a stem that n of so many words have."""
    return [stem, *(f"{stem}{k}" for k in COUNTS if n >= k), *(f"{stem}1/{k}" for k in RATES if n * k >= words)]


def present(text: bytes | None) -> set[str]:
    found: Counter[str] = Counter()
    for w, n in (words := words_of(text)).items():
        for f in stems(w):
            found[f] += n
    total = words.total()
    return {level for f, n in found.items() for level in levels(f, n, total)}


class Model:
    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias, self.known = weights, bias, {}
        self.watched = {re.match(r"[^0-9]*", f)[0] for f in weights}

    def score(self, text: bytes | None) -> float:
        found: Counter[str] = Counter()
        for w, n in (words := words_of(text)).items():
            own = self.known.get(w)
            if own is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                own = self.known[w] = tuple(f for f in stems(w) if f in self.watched)
            for f in own:
                found[f] += n
        total = words.total() if found else 0
        # Summed in one order, so a text has one score everywhere.
        z = self.bias + sum(self.weights.get(level, 0.0) for f in sorted(found) for level in levels(f, found[f], total))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def sample(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows positive, text: at most MOST_POSITIVE documents that marks (doc_id, toxic) calls toxic and MOST_UNLABELLED of any kind. Ids are
    picked first; texts are then found by a join with those few."""
    least = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    there = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).distinct()
    toxic = marks.where("toxic = 1").select("doc_id").join(there, "doc_id", "left_semi").orderBy(*least).limit(MOST_POSITIVE)
    any_kind = there.orderBy(*least).limit(MOST_UNLABELLED)
    picked = F.broadcast(toxic.withColumn("positive", F.lit(True)).unionByName(any_kind.withColumn("positive", F.lit(False))))
    return rows.join(picked, "doc_id").groupBy("positive", "doc_id").agg(F.min("text").alias("text")).select("positive", "text")


def select(rows: DataFrame, positives: int, unlabelled: int) -> list[str]:
    """Features of rows (positive, text) in LEAST_POSITIVE positives or more whose share there is SIGMAS standard errors above that in the
    unlabelled sample or more; if they are over MOST_FEATURES, those furthest above. Counted on the executors."""

    @given_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, u = Counter(), Counter()
            for positive, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (p if positive else u).update(present(text.as_py()))
            names = list(p.keys() | u.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[f] for f in names], pa.int64()), pa.array([u[f] for f in names], pa.int64())], names=["feature", "p", "u"])

    totals = rows.mapInArrow(count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate = (F.col("u") + 0.5) / (unlabelled + 1)
    above = (F.col("p") - positives * rate) / F.sqrt(positives * rate * (1 - rate))
    best = totals.where(F.col("p") >= LEAST_POSITIVE).withColumn("above", above).where(F.col("above") >= SIGMAS)
    return [r["feature"] for r in best.orderBy(F.desc("above"), "feature").limit(MOST_FEATURES).collect()]


def numbered(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows positive, features (numbers of those of names that the text has, in order)."""
    number = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    @given_back
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            found = [sorted(known[f] for f in present(t.as_py()) if f in known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["positive", "features"])

    return rows.mapInArrow(find, "positive boolean, features array<int>")


def fit(names: list[str], positive: list[list[int]], unlabelled: list[list[int]], prior: float, **settings) -> Model:
    """The model from samples of texts, each as numbers of names."""
    rows = [np.asarray(t, np.int64) for t in [*positive, *unlabelled]]
    return fitted(names, np.concatenate([np.zeros(0, np.int64), *rows]), np.array([len(r) for r in rows], np.int64), len(positive), prior, **settings)


def fitted(names: list[str], columns: np.ndarray, counts: np.ndarray, n: int, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 3e-5, gap: tuple[float, float] = (-2.0, 1.0)) -> Model:
    """The model from samples of texts: the numbers of names of one after another, how many each has, the n positives first."""
    if not names or not n or n == len(counts):
        return Model({}, -1e6)
    row, size = np.repeat(np.arange(len(counts)), counts), len(names)
    w = np.full(size + 1, 0.25)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.bincount(row, w[columns], len(counts)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        slope = s * (1 - s)
        negative = s[n:].mean() - prior * s[:n].mean()
        g = np.zeros(len(counts))
        if negative >= 0:
            g[:n] = -2 * prior * slope[:n] / n
            g[n:] = slope[n:] / (len(counts) - n)
        else:
            g[:n] = prior * slope[:n] / n
            g[n:] = -slope[n:] / (len(counts) - n)
        grad = np.append(np.bincount(columns, g[row], size) + decay * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)  # the features are those that speak for a positive
    # The sigmoid loss leaves some sample positives just below the threshold: it moves into the widest gap of the sample's scores near it.
    z = np.sort(np.bincount(row, w[columns], len(counts)) + w[-1])
    low, high = np.searchsorted(z, gap)
    if high - low > 1:
        at = low + int(np.argmax(np.diff(z[low:high])))
        w[-1] -= (z[at] + z[at + 1]) / 2
    return Model({f: float(x) for f, x in zip(names, w, strict=False) if x}, float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labels' toxic column for docs, from the folds that are learned from."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(fold(F.col("doc_id")) != 0)
    n, toxic = marks.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    rows = cut(sample(docs, marks))
    positives, unlabelled = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not positives or not unlabelled:
        return Model({}, -1e6)
    names = select(rows, positives, unlabelled)
    found = numbered(rows, names).toArrow().sort_by([("positive", "descending")])
    prior = min(max(toxic / max(n, 1), 0.001), 0.9)
    features = found.column("features").combine_chunks()
    return fitted(names, features.flatten().to_numpy(), np.diff(features.offsets.to_numpy()), int(pc.sum(found.column("positive")).as_py() or 0), prior)


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function of a text column: its score."""
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    @given_back
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for text in texts:
            yield pd.Series([own.score(t) for t in text], dtype="float64")

    return lambda text: scores(text.cast("binary"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows doc_id, held_out, score, predicted."""
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), scorer(docs.sparkSession, model)(F.col("text")).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score 0.5 or more."""
    # Whole rows travel as a struct, so no column of docs meets the score's name.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), scorer(docs.sparkSession, model)(F.col("text")).alias("score"))
    return rows.where("score < 0.5").select(*[F.col("row")[c].alias(c) for c in docs.columns])
