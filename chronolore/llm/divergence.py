"""How far the sources of a language lie apart in their words (operator 12), by distinct columns of counts.

Terms are runs of letters: everything beyond ASCII and A-Z, of which only A-Z are made small. A language keeps the terms that LEAST_DOCUMENTS of its rows have
or more, V of them. A group of N such words, with a term in it count times, gives it p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)).

Terms with the same counts in the same sources have the same p everywhere, whatever the terms are. So each kept term's counts become a sparse vector
(source, count), equal vectors of a language are one, with the number of their terms, and every pair of sources is evaluated once for each different vector
and multiplied; only the report of terms goes back to the terms.

Words are counted by Arrow batch and summed by Spark by (lang, source, term) first and by (lang, term) after, where a term has at most a row for each
source. Pairs of sources are evaluated in tiles: a chunk of vectors by two blocks of at most SOURCES sources; what a chunk's vectors don't have at all
is added by count. All is in whole numbers, exact up to 9 * 10**15 words of a language.

Nulls and edges: null text, lang and source count as ''. Every row is a document, repeated ids and texts too. A language without a kept term has value 0 for every
pair and no term rows; one source alone has no pair. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolore.llm.common import cut, given_back, words_in_blocks

LEAST_DOCUMENTS, SMOOTH, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Sources of a block, vectors of a chunk, and words that a task counts before it hands them on.
SOURCES, VECTORS, COUNTED = 256, 4096, 200_000
#: Parts that the rows of one language or source are dealt to when they meet its numbers.
SALTS = 64
#: Bytes below 128 that are no letter become blanks; A-Z small.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def counts(docs: DataFrame) -> DataFrame:
    """Rows lang, source, term, count, df: how often a source of a language has a term, and in how many documents. Partly summed."""

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        n = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, df) in found.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(count)), pa.repeat(source, len(count)), pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64()), pa.array([df[w] for w in count], pa.int64())], names=["lang", "source", "term", "count", "df"])
            found.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                count, df = found[lang, source]
                before, seen = len(count), set()
                for words in words_in_blocks((text.as_py() or b"").translate(LETTERS)):
                    count.update(words)
                    seen.update(words)
                df.update(seen)
                n += len(count) - before
                if n >= COUNTED:
                    yield from told()
                    n = 0
        yield from told()

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    return named.mapInArrow(run, "lang string, source string, term string, count long, df long")


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """Rows lang, term, vector: the terms that enough documents of a language have, with their counts by source, in the order of sources."""
    by_source = counts(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))
    entries = F.array_sort(F.collect_list(F.struct("source", "count"))).alias("vector")
    return by_source.groupBy("lang", "term").agg(F.sum("df").alias("df"), entries).where(F.col("df") >= least).drop("df")


def meet(rows: DataFrame, numbers: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """rows joined with the one row that numbers has for their keys: rows of a key are dealt over SALTS tasks, each of which has that row."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(numbers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"]).drop("_salt")


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count in a group of n words of v terms."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * (count + SMOOTH), F.nullif(n + SMOOTH * v, F.lit(0)))).cast("long")


def shares(count: np.ndarray, n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """share() of arrays: SCALE times the fraction digit by digit, so that nothing passes 64 bits."""
    whole = n + SMOOTH * v
    out, left = np.divmod(count + SMOOTH, whole)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def tiles(vectors: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """Rows lang, s, t, value, terms (s before t): for each chunk of vectors the summed differences of every pair of sources of two blocks, and how many terms
    those vectors stand for. vectors: lang, vector, terms, sources, different. groups: lang, source, n, v, different, sources."""
    block = lambda source: F.pmod(F.xxhash64(source), F.lit(blocks)).cast("int")
    chunks = F.greatest(F.ceil(F.col("different") / F.greatest(F.lit(VECTORS), F.col("sources"))), F.lit(1)).cast("long")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    own = F.array_distinct(F.transform("vector", lambda e: block(e["source"])))
    pairs = F.array_distinct(F.flatten(F.transform(own, lambda x: F.transform(every, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))))
    both = vectors.select("lang", F.pmod(F.xxhash64("vector"), chunks).alias("chunk"), F.explode(pairs).alias("p"), "vector", "terms").select("lang", "chunk", "p.a", "p.b", "vector", "terms")
    here = F.filter("vector", lambda e: (block(e["source"]) == F.col("a")) | (block(e["source"]) == F.col("b")))
    part = both.withColumn("vector", here).select("lang", "chunk", "a", "b", F.col("vector.source").alias("source"), F.col("vector.count").alias("count"), "terms")
    there = groups.withColumn("own", block(F.col("source"))).withColumn("b", F.explode(every)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    there = there.select("lang", "chunk", F.least("own", "b").alias("a"), F.greatest("own", "b").alias("b"), "own", "source", "n", "v")

    def run(part: pa.Table, there: pa.Table) -> pa.Table:
        none = pa.table({"lang": pa.array([], pa.string()), "s": pa.array([], pa.string()), "t": pa.array([], pa.string()), "value": pa.array([], pa.int64()), "terms": pa.array([], pa.int64())})
        if not len(part) or not len(there):
            return none
        names = there.column("source").combine_chunks()
        order = np.argsort(np.array(names.to_pylist(), object), kind="stable")
        names = names.take(pa.array(order))
        n, v, own = (there.column(c).to_numpy()[order] for c in ("n", "v", "own"))
        a, b = part.column("a")[0].as_py(), part.column("b")[0].as_py()
        dense = np.zeros((len(part), len(names)), np.int64)
        given, count = (part.column(c).combine_chunks() for c in ("source", "count"))
        row = np.repeat(np.arange(len(part)), np.diff(given.offsets.to_numpy()))
        dense[row, pc.index_in(given.flatten(), value_set=names).to_numpy()] = count.flatten().to_numpy()
        p, times = shares(dense, n, v), part.column("terms").to_numpy()
        s, t, value = [], [], []
        for i in range(len(names)):
            others = np.arange(i + 1, len(names))
            if a != b:
                others = others[own[others] != own[i]]
            s.append(np.full(len(others), i))
            t.append(others)
            value.append(times @ np.abs(p[:, others] - p[:, i : i + 1]))
        s, t, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (s, t, value))
        return pa.table({"lang": pa.repeat(part.column("lang")[0].as_py(), len(s)), "s": names.take(pa.array(s, pa.int64())), "t": names.take(pa.array(t, pa.int64())), "value": pa.array(value, pa.int64()), "terms": pa.repeat(int(times.sum()), len(s))})

    return part.groupBy("lang", "chunk", "a", "b").cogroup(there.groupBy("lang", "chunk", "a", "b")).applyInArrow(run, "lang string, s string, t string, value long, terms long")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """Rows lang, source, part, item, value, rank: of each source of a language the other sources (part pair) by the distance of their words, and the terms that
    it has more often than its language (part term), most_terms at most."""
    kept = cut(kept_terms(docs, least))
    there = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    entries = kept.select("lang", F.explode("vector").alias("e"))
    words = entries.groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.count").alias("n"))
    distinct = cut(kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("terms"), F.min("term").alias("first")))
    langs = there.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    langs = langs.join(distinct.groupBy("lang").agg(F.sum("terms").alias("v"), F.count(F.lit(1)).alias("different")), "lang", "left").join(words.groupBy("lang").agg(F.sum("n").alias("all_n")), "lang", "left")
    langs = langs.select("lang", "sources", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "different", "all_n")])
    groups = cut(there.join(words, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).join(langs, "lang"))
    blocks = max(1, -(-(groups.agg(F.max("sources")).first()[0] or 0) // SOURCES))

    found = tiles(meet(distinct, langs, ["lang"], "first"), groups, blocks).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    # The pairs asked for are those of all sources of a language, dealt by the blocks of one side.
    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("n").alias(f"{name}_n"), "v")
    deal = F.pmod(F.xxhash64("s"), F.lit(blocks))
    pairs = side("s").withColumn("deal", deal).join(side("t").drop("v").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))), ["lang", "deal"]).where("s < t").drop("deal")
    zero = F.when(F.col("v") > 0, F.abs(share(F.lit(0).cast("long"), F.col("s_n"), F.col("v")) - share(F.lit(0).cast("long"), F.col("t_n"), F.col("v"))))
    value = F.coalesce(F.col("value") + (F.col("v") - F.col("terms")) * zero, F.col("v") * zero, F.lit(0)).cast("long")
    valued = pairs.join(found, ["lang", "s", "t"], "left").select("lang", "s", "t", value.alias("value"))
    both = valued.select("lang", F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item")))).alias("p"), "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value").withColumn("rank", F.row_number().over(by_value))

    # A vector's terms tie, so the best terms are among the first ones of the best vectors, in the order of their first terms.
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda s, e: s + e["count"])
    own = distinct.withColumn("total", total).select("lang", "first", "total", F.explode("vector").alias("e")).select("lang", "first", "total", F.col("e.source").alias("source"), F.col("e.count").alias("count"))
    own = meet(own, groups, ["lang", "source"], "first").withColumn("value", share(F.col("count"), F.col("n"), F.col("v")) - share(F.col("total"), F.col("all_n"), F.col("v"))).where("value > 0")
    best = own.withColumn("place", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "first"))).where(F.col("place") <= most_terms).select("lang", "source", "first", "value")
    alike = Window.partitionBy("lang", "vector").orderBy("term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = kept.withColumn("place", F.row_number().over(alike)).withColumn("first", F.first("term").over(alike)).where(F.col("place") <= most_terms).select("lang", "first", F.col("term").alias("item"))
    term = best.join(members, ["lang", "first"]).select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= most_terms)
    return pair.unionByName(term)
