"""Mixing sources to target weights by a low-discrepancy schedule (operator 2), in DataFrame functions only.

A slot is block_tokens words of the mix. Slot i is given the point frac((i + 1/2) * golden ratio), and the source in whose stretch of
the cumulative target shares the point lies. Slots are ranked per source; rank r takes block r of that source's stream: its documents in
the order of md5(seed:doc_id), written `passes` times over. What a source gives is what its slots ask for: number of slots * block_tokens words,
or the whole stream if that is less. Points spread so evenly that this is within a few blocks of the target, and so is every run
of slots within itself.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating. They share share * (all words) by weight; no source
exceeds passes * (its words), the excess being shared again by weight. That end point is min(passes * size, level * weight) with one
level for all, found from running sums over the sources.

Scale: only (doc_id, source, size) is shuffled. Stream positions and slot ranks are running sums over buckets, never over a whole
source; the tables of sources, cells and bucket sums are small and left to Spark to broadcast or not.

Nulls and edges: null text has size 0; a null source is a source; empty documents and empty sources take nothing. Repeated rows and ids
are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolore.llm.common import WORD, balanced_buckets, cut

#: Cells that the unit interval is cut into to find a point's source by an equality join.
CELLS = 4096
#: Slots ranked by one window partition at most.
CHUNK = 1 << 14
#: The golden ratio less one, and the fraction of 2^20 times it.
GOLDEN = (math.sqrt(5) - 1) / 2
GOLDEN_STEP = math.modf((1 << 20) * GOLDEN)[0]


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, order: the shuffled place of a document in its source; copies of an id follow each other."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select("doc_id", "source", size.alias("size"), place.alias("place"))


def targets(sizes: DataFrame, share: float, passes: int, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Per source: source, source_no (from 0), source_size, target, low and high (its stretch of the unit interval)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", (F.row_number().over(by_name) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int"))
    source = source.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(passes)).withColumn("ratio", F.col("most") / F.col("weight"))
    everything, up_to = Window.partitionBy(), Window.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    total, all_weight = F.sum("source_size").over(everything) * share, F.sum("weight").over(everything)
    # With the sources of lesser ratio full, this level would be shared by the rest; the first source that it doesn't fill sets it.
    level = (total - F.coalesce(F.sum("most").over(up_to), F.lit(0.0))) / (all_weight - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
    source = source.withColumn("level", level)
    held = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source_no", "level"))).over(everything)["level"]
    source = source.withColumn("target", F.least("most", F.coalesce(held, F.lit(float("inf"))) * F.col("weight")))
    by_no = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    all_target = F.greatest(F.sum("target").over(everything), F.lit(1e-300))
    source = source.withColumn("low", F.coalesce(F.sum("target").over(by_no), F.lit(0.0)) / all_target)
    return source.select("source", "source_no", "source_size", "target", "low", (F.col("low") + F.col("target") / all_target).alias("high"))


def golden_point(i: Column) -> Column:
    """frac((i + 1/2) * golden ratio), in two parts so that a large i costs no digits."""
    high, low = F.shiftright(i, 20).cast("double"), F.pmod(i, F.lit(1 << 20)).cast("double")
    point = high * GOLDEN_STEP + (low + 0.5) * GOLDEN
    return point - F.floor(point)


def schedule(source: DataFrame, slots: int, block: int, passes: int) -> tuple[DataFrame, DataFrame]:
    """The slots that take words: source_no, block_no (rank in the source), slot; and what they ask for: source_no, words."""
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    stretches = source.where("high > low").select("source_no", "low", "high", (F.col("source_size") * passes).alias("most"))
    by_cell = stretches.select("source_no", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    point = source.sparkSession.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    # The last stretch is open above, as rounding may leave its end a hair under 1.
    until = F.coalesce(F.lead("low").over(Window.orderBy("source_no")), F.lit(2.0))
    by_cell = stretches.withColumn("until", until).join(by_cell, "source_no")
    drawn = point.withColumn("cell", cell(F.col("point"))).join(by_cell, "cell").where("point >= low AND point < until").select("source_no", "most", "slot")
    drawn = drawn.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = drawn.groupBy("source_no", "most", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("source_no", "chunk", "base")
    local = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranks = drawn.withColumn("local", local).join(base, ["source_no", "chunk"]).withColumn("block_no", F.col("base") + F.col("local"))
    asked = counts.groupBy("source_no").agg(F.least(F.sum("n") * block, F.first("most")).cast("long").alias("words"))
    return ranks.where(F.col("block_no") * block < F.col("most")).select("source_no", "block_no", "slot"), asked


def placed(sizes: DataFrame, source: DataFrame, rows: int) -> DataFrame:
    """sizes with source_no, source_size, target and start: the document's place in its source's stream."""
    named = sizes.join(source.drop("low", "high"), sizes["source"].eqNullSafe(source["source"])).drop(source["source"])
    # Buckets by the first digits of the place keep the shuffled order.
    tagged = named.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * balanced_buckets(rows) / float(1 << 32)))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = tagged.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("source_no", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return tagged.withColumn("local", local).join(base.select("source_no", "bucket", "base"), ["source_no", "bucket"]).withColumn("start", F.col("base") + F.col("local")).drop("bucket", "local", "base")


def mix(docs: DataFrame, share: float = 1.5, passes: int = 2, block_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """The mix as pieces: doc_id, size, source, source_size, target, start, pass (from 0), slot, piece_from and piece_to (words of the
    document, from 0). The mix is the pieces in the order of their slots.

    A document that a slot takes no word of has one row with null pass, slot and pieces. block_tokens is by default the words of the mix
    over a million, from 1 to 2048, so small mixes are still finely dealt.
    """
    sizes = cut(sized(docs, seed))
    rows, words = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block_tokens or min(2048, max(1, int(share * words) >> 20))
    slots = max(1, math.ceil(share * words / block))
    source = cut(targets(sizes, share, passes))
    used, asked = schedule(source, slots, block, passes)
    stream = placed(sizes, source, rows).join(asked, "source_no", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    passed = stream.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(passes)]))).withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    passed = passed.withColumn("stop", F.least(F.col("at") + F.col("size"), F.col("words")))
    taken = passed.where("stop > at").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("stop") - 1) / block))))
    taken = taken.withColumn("piece_from", F.greatest(F.col("block_no") * block, F.col("at")) - F.col("at")).withColumn("piece_to", F.least((F.col("block_no") + 1) * block, F.col("stop")) - F.col("at"))
    columns, places = ["doc_id", "size", "source", "source_size", "target", "start"], ["pass", "slot", "piece_from", "piece_to"]
    filled = taken.join(used, ["source_no", "block_no"]).select(*columns, *[F.col(c).cast("long").alias(c) for c in places])
    left = stream.where((F.col("size") == 0) | (F.col("start") >= F.col("words"))).select(*columns, *[F.lit(None).cast("long").alias(c) for c in places])
    return filled.unionByName(left)


def taken_words(pieces: DataFrame) -> DataFrame:
    """One row per document row of mix()'s pieces: its columns, taken (words) and first_slot (null if nothing is taken). Empty documents share
    a start, so their rows are kept apart."""
    key = ["doc_id", "size", "source", "source_size", "target", "start"]
    words = F.coalesce(F.sum(F.col("piece_to") - F.col("piece_from")), F.lit(0)).cast("long").alias("taken")
    full = pieces.where("size > 0").groupBy(*key).agg(words, F.min("slot").alias("first_slot"))
    empty = pieces.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"), F.col("slot").alias("first_slot"))
    return full.unionByName(empty)


def mixed_documents(docs: DataFrame, share: float = 1.5, passes: int = 2, seed: int = 7) -> DataFrame:
    """The documents of the mix, with the columns of docs: a row for each pass over a document, each partition in the order of the slots that
    take them first, so what is written of it follows the schedule from its beginning on. A pass that ends inside a document
    takes its first words only, joined by one space. Documents of which nothing is taken, empty ones among them, are not in the mix.
    Where n_chars is a column, it is told anew for cut texts."""
    # Whole rows travel as a struct, so no column of docs meets a name used here.
    whole_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    size = F.coalesce(F.regexp_count(F.col("row.text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = ["id", "of", "size"]  # a struct equals another with the same null
    passed = mix(docs, share=share, passes=passes, seed=seed).where("slot IS NOT NULL").groupBy("doc_id", "source", "size", "start", "pass").agg(F.sum(F.col("piece_to") - F.col("piece_from")).alias("words"), F.min("slot").alias("slot"))
    copy_no = F.dense_rank().over(Window.partitionBy(*key).orderBy("start"))
    passed = passed.select(F.struct("doc_id").alias("id"), F.struct("source").alias("of"), "size", "start", "words", "slot").withColumn("copy", copy_no).drop("start")
    keyed = whole_rows.select("row", F.struct(F.col("row.doc_id").alias("doc_id")).alias("id"), F.struct(F.col("row.source").alias("source")).alias("of"), size.alias("size")).where("size > 0")
    numbered = keyed.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row.text"))))
    mixed = numbered.join(passed, [*key, "copy"]).sortWithinPartitions("slot")
    whole = F.col("words") == F.col("size")
    text = F.when(whole, F.col("row.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " "))
    told = {"text": text} | ({"n_chars": F.when(whole, F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return mixed.select(*[told.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
