"""BM25 by an inverted index in blocks of documents, stored or made for one batch of questions.

A block is a row: the ids and lengths of its documents, its terms, and for each term the documents that have it, how often, and what bounds its weight there (the greatest
frequency, the least length). Blocks hold documents of like length, as short ones score high, and about as many words each. No term, however frequent, is a key of
anything.

Questions go to the blocks in parts of about MOST_PAIRS (question, term) pairs. A task keeps the k best of each question over all its blocks; a block is
evaluated for those questions only whose bound there (the sum of its terms' greatest weights) reaches their k-th best so far. Only these k leave the
task. Statistics are those of the documents that are searched: where only some are allowed, the others count neither in frequencies nor in lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolore.functions.text import keywords
from chronolore.lineage import cut
from chronolore.operators.ranks import top

# Fixed values.
K1, B = 1.2, 0.75
#: Pairs of a question and a term that one pass carries along; scores held at once; words of a stored block, and its documents at most.
MOST_PAIRS, SCORES, BLOCK_WORDS, BLOCK_DOCS = 1_000_000, 1 << 22, 1 << 17, 4096
SEEDS = 40
BLOCK = "ids array<{kind}>, lengths array<int>, terms array<string>, ends array<int>, docs array<int>, tfs array<int>, most array<int>, least array<int>"


def tokens(c: Column) -> Column:
    """All words of a text, lower case, repeats included."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def block_of(ids: pa.Array, words: pa.Array, known: pa.Array | None) -> pa.RecordBatch:
    """One row: the documents and the postings of their words (of those in known, if given)."""
    length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    if known is None:
        coded = flat.dictionary_encode()
        names, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        names, number = known, pc.fill_null(pc.index_in(flat, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = max(1, len(length))
    key, tf = np.unique((number * n + np.repeat(np.arange(len(length)), length))[number >= 0], return_counts=True)
    term, doc = key // n, key % n
    used, first = np.unique(term, return_index=True)
    ends = np.append(first[1:], len(term))
    most = np.maximum.reduceat(tf, first) if len(first) else tf
    least = np.minimum.reduceat(length[doc], first) if len(first) else tf
    ints = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, names.take(pa.array(used)).cast(pa.string()))]
    return pa.RecordBatch.from_arrays([lists[0], ints(length), lists[1], ints(ends), ints(doc), ints(tf), ints(most), ints(least)], names=["ids", "lengths", "terms", "ends", "docs", "tfs", "most", "least"])


@dataclass
class Index:
    """blocks: block (a number) and the columns of BLOCK. docs: the id column and block."""

    blocks: DataFrame
    docs: DataFrame | None
    id_col: str


def build(docs: DataFrame, path: str, id_col: str = "fact_id", text: str = "statement") -> Index:
    """Writes the index of docs and reads it. Documents of like length (within a factor of the square root of 2) share blocks."""
    kind = docs.schema[id_col].dataType.simpleString()
    split = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("words")).withColumn("like", F.floor(F.log2(F.size("words") + 1.0) * 2).cast("int"))
    blocks = F.greatest(F.ceil(F.sum(F.size("words")) / BLOCK_WORDS), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.lit(1)).cast("int")
    sizes = {r["like"]: r["blocks"] for r in split.groupBy("like").agg(blocks.alias("blocks")).collect()}  # a row for each length class, some 60 at most
    first, total = {}, 0
    for like in sorted(sizes):
        first[like], total = total, total + sizes[like]
    look = lambda numbers: F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[F.col("like")] if numbers else F.lit(1)
    dealt = split.withColumn("block", (look(first) + F.pmod(F.xxhash64("id"), look(sizes))).cast("int")).drop("like")

    def make(key: tuple, part: pa.Table) -> pa.Table:
        one = part.combine_chunks()
        made = block_of(one.column("id").chunk(0), one.column("words").chunk(0), None)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), **{n: made.column(n) for n in made.schema.names}})

    made = dealt.groupBy("block").applyInArrow(make, f"block int, {BLOCK.format(kind=kind)}")
    made.write.mode("overwrite").parquet(f"{path}/blocks")
    dealt.select(F.col("id").alias(id_col), "block").write.mode("overwrite").parquet(f"{path}/docs")
    return read(docs.sparkSession, path, id_col)


def read(spark: SparkSession, path: str, id_col: str = "fact_id") -> Index:
    return Index(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/docs"), id_col)


def made_for(docs: DataFrame, known: pa.Array, id_col: str, text: str) -> Index:
    """An index of the known terms only, for one batch of questions: a block for each Arrow batch, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield block_of(batch.column(0), batch.column(1), known)

    rows = docs.select(id_col, tokens(F.coalesce(F.col(text), F.lit(""))).alias("words")).mapInArrow(run, BLOCK.format(kind=kind))
    return Index(cut(rows), None, id_col)


def with_mask(index: Index, allowed: DataFrame | None) -> DataFrame:
    """Blocks with the ids that may be found (null: all); those without any are left out."""
    if allowed is None:
        return index.blocks.withColumn("open", F.lit(None).cast(index.blocks.schema["ids"].dataType))
    ids = allowed.select(index.id_col).distinct().join(index.docs, index.id_col).groupBy("block").agg(F.collect_list(index.id_col).alias("open"))
    return index.blocks.join(ids, "block")


def postings_of(batch: pa.RecordBatch, row: int, known: pa.Array) -> tuple:
    """Of a block: ids, lengths, which documents are open, numbers of its asked terms, where their postings begin and end, documents, frequencies, bounds."""
    cell = lambda name: batch.column(batch.schema.get_field_index(name))[row].values
    array = lambda name: cell(name).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, mask = cell("ids"), batch.column(batch.schema.get_field_index("open"))[row]
    free = np.ones(len(ids), bool) if not mask.is_valid else pc.is_in(ids, value_set=mask.values).to_numpy(zero_copy_only=False)
    ends = array("ends")
    number = pc.fill_null(pc.index_in(cell("terms"), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    here = np.flatnonzero(number >= 0)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    return ids, array("lengths"), free, number[here], starts[here], ends[here], array("docs"), array("tfs"), array("most")[here], array("least")[here]


def ranges(starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., times[0] of them, then from starts[1], and so on."""
    stops = np.cumsum(times)
    return np.repeat(starts - stops + times, times) + np.arange(stops[-1] if len(stops) else 0)


def frequencies(blocks: DataFrame, known: pa.Array) -> tuple[int, float, np.ndarray]:
    """How many documents are searched, their mean length, and how many have each of the known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for row in range(len(batch)):
                _, lengths, free, number, starts, ends, docs, *_ = postings_of(batch, row, known)
                n, words = n + int(free.sum()), words + int(lengths[free].sum())
                times = ends - starts
                df[number] += np.bincount(np.repeat(np.arange(len(number)), times), free[docs[ranges(starts, times)]], len(number)).astype(np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n)), pa.array(np.append(np.zeros(len(at), np.int64), words))], names=["term", "df", "words"])

    df = np.zeros(len(known))
    n, words = 0, 0
    for r in blocks.mapInArrow(run, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).collect():  # a row for each asked term
        if r["term"] < 0:
            n, words = r["df"], r["words"]
        else:
            df[r["term"]] = r["df"]
    return n, words / n if n and words else 1.0, df


def best(blocks: DataFrame, known: pa.Array, asked: np.ndarray, first: np.ndarray, idf: np.ndarray, average: float, questions: pa.Array, kinds: tuple[str, str], k: int, id_col: str) -> DataFrame:
    """query_id, id, score: the k best documents of each question in each task. The questions (numbers) of term t are asked[first[t] : first[t + 1]]."""
    shared, many = blocks.sparkSession.sparkContext.broadcast((known, asked, first, idf)), len(questions)
    weight = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked, first, idf = shared.value
        least = np.full(many, -np.inf)  # the k-th best score of each question so far
        kept, waiting, seen = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)), [], 0

        def merge() -> None:
            nonlocal kept, waiting
            q, s, i = (np.concatenate(x) for x in zip(kept, *waiting, strict=True))
            order = np.lexsort((i, -s, q))
            q, s, i = q[order], s[order], i[order]
            begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
            place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
            least[q[place == k - 1]] = s[place == k - 1]
            kept, waiting = (q[place < k], s[place < k], i[place < k]), []

        for batch in batches:
            for row in range(len(batch)):
                ids, lengths, free, number, starts, ends, docs, tfs, most, shortest = postings_of(batch, row, known)
                times = first[number + 1] - first[number]
                bound = np.bincount(asked[ranges(first[number], times)], np.repeat(idf[number] * weight(most, shortest), times), many)
                live = np.flatnonzero((bound > 0) & (bound + 1e-6 >= least))
                names = np.array(ids.to_pylist(), object)
                for some in range(0, len(live), max(1, SCORES // max(1, len(ids)))):
                    own = live[some : some + max(1, SCORES // max(1, len(ids)))]
                    local = np.full(many, -1)
                    local[own] = np.arange(len(own))
                    # Each asked term's postings, once for each of its questions that are still live.
                    question = local[asked[ranges(first[number], times)]]
                    term = np.repeat(np.arange(len(number)), times)[question >= 0]
                    question = question[question >= 0]
                    counts = (ends - starts)[term]
                    at = ranges(starts[term], counts)
                    doc = docs[at]
                    open_ = free[doc]
                    doc, tf, q, t = doc[open_], tfs[at][open_], np.repeat(question, counts)[open_], np.repeat(number[term], counts)[open_]
                    key, score = q * len(ids) + doc, idf[t] * weight(tf, lengths[doc])
                    if len(own) * len(ids) > 4 * len(key):
                        key, inverse = np.unique(key, return_inverse=True)
                        score = np.bincount(inverse, score, len(key))
                    else:
                        score = np.bincount(key, score, len(own) * len(ids))
                        key = np.flatnonzero(score)
                        score = score[key]
                    q, doc, score = own[key // len(ids)], key % len(ids), np.round(score, 6)
                    good = score >= least[q]
                    waiting.append((q[good], score[good], names[doc[good]]))
                    if sum(len(w[0]) for w in waiting) > max(100_000, 2 * len(kept[0])):
                        merge()
                seen += 1
                if waiting and seen & (seen - 1) == 0:  # early, so that there is a k-th best to reach, and ever more seldom
                    merge()
        merge()
        found = pa.array(kept[2].tolist(), blocks_id)
        yield pa.RecordBatch.from_arrays([questions.take(pa.array(kept[0], pa.int64())), found, pa.array(kept[1])], names=["query_id", id_col, "score"])

    blocks_id = pa.string() if kinds[1] == "string" else pa.int64() if kinds[1] == "bigint" else pa.int32()
    return blocks.mapInArrow(run, f"query_id {kinds[0]}, {id_col} {kinds[1]}, score double")


def bm25_top(docs: DataFrame | None, questions: DataFrame, k: int = SEEDS, id_col: str = "fact_id", text: str = "statement", index: Index | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank: the k best of docs for each question (query_id, question), ties by id. With a stored index docs are not read; allowed (rows of the id column)
    are the documents that may be found, all if not given."""
    kind = questions.schema["query_id"].dataType.simpleString()
    of = (index.docs if index else docs).schema[id_col].dataType.simpleString()
    pairs = cut(questions.select("query_id", F.explode(keywords(F.col("question"))).alias("term")).distinct())
    parts, found = math.ceil(pairs.count() / MOST_PAIRS), []
    for part in range(parts):
        own = pairs.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
        if not len(own):
            continue
        question, term = own.column("query_id").combine_chunks().dictionary_encode(), own.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(term.indices.to_numpy(), kind="stable")
        asked = question.indices.to_numpy()[order].astype(np.int64)
        first = np.searchsorted(term.indices.to_numpy()[order], np.arange(len(term.dictionary) + 1)).astype(np.int64)
        known = term.dictionary.cast(pa.string())
        blocks = with_mask(index or made_for(docs if allowed is None else docs.join(allowed.select(id_col).distinct(), id_col, "left_semi"), known, id_col, text), allowed if index else None)
        n, average, df = frequencies(blocks, known)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        found.append(best(blocks, known, asked, first, idf, average, question.dictionary, (kind, of), k, id_col))
    none = questions.sparkSession.createDataFrame([], f"query_id {kind}, {id_col} {of}, score double")
    return top(reduce(DataFrame.unionByName, found, none), ["query_id"], [F.desc("score"), F.col(id_col)], k)
