"""Sharding by a hierarchical weighted hash tree (operator 4).

Shards are the leaves of a tree of regions, racks and shards, each node weighing the sum of its leaves. A document descends from the
root: at each level every child draws -weight / ln(u), u a hash in (0, 1) of the doc_id and that child's name, and the greatest draw
wins, which picks children in proportion to weight. A draw depends on nothing but the document, the child and its weight, so a changed
weight moves documents only into (or, lowered, out of) the subtrees whose weights change; all others stay.

Law "key": doc_id and the tree decide, wherever and whenever a row is seen. standard_tree() puts each shard after the first ones
into a region of its own, so one more shard takes rows only into itself.

Everything is one pass of column functions; only (doc_id, size, crc, shard) is shuffled, to number the slots, by buckets in each shard,
so no task holds a shard.

Nulls and edges: a null doc_id hashes as a value of its own; a null text has size 1 and crc 0. Rows of one doc_id share a shard and have
slots of their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolore.llm.common import balanced_buckets, cut, ranked

#: Shard number: (region, rack, weight).
Tree = dict[int, tuple[int, int, float]]


def standard_tree(shards: int, built: int = 8, per_rack: int = 2, racks: int = 2) -> Tree:
    """Equal weights. The first built shards fill racks of per_rack shards and regions of so many racks; each later one is a region."""
    home = lambda i: (i // (per_rack * racks), i // per_rack % racks, 1.0)
    return {i: home(i) if i < built else (built + i, 0, 1.0) for i in range(shards)}


def draw(key: Column, child: str, weight: float) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(child)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.log(u)


def descend(key: Column, tree: Tree) -> Column:
    """The shard of a key."""

    def pick(children: dict[str, tuple[float, Column]]) -> Column:
        alive = {name: x for name, x in children.items() if x[0] > 0}
        if len(alive) == 1:
            return next(iter(alive.values()))[1]
        draws = [F.struct(draw(key, name, weight).alias("draw"), F.lit(name).alias("name")) for name, (weight, _) in alive.items()]
        best = F.greatest(*draws)["name"]
        out = F.lit(None).cast("int")
        for name, (_, below) in alive.items():
            out = F.when(best == name, below).otherwise(out)
        return out

    regions: dict[int, dict[int, dict[int, float]]] = defaultdict(lambda: defaultdict(dict))
    for shard, (region, rack, weight) in sorted(tree.items()):
        regions[region][rack][shard] = weight
    total = lambda racks: sum(sum(x.values()) for x in racks.values())
    return pick({
        f"region{r}": (total(racks), pick({
            f"rack{r}.{k}": (sum(shards.values()), pick({f"shard{s}": (w, F.lit(s)) for s, w in shards.items()}))
            for k, shards in racks.items()
        }))
        for r, racks in regions.items()
    })


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in the shard) and grown_shard, the shard under the tree grown."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id")
    rows = docs.select(
        key,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, tree).cast("int").alias("shard"),
        (descend(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    kept = cut(rows)
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    spread = [F.col("doc_id"), F.col("text_crc32")]
    return ranked(kept, ["shard"], order, spread, balanced_buckets(kept.count()), "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, path: str, file_bytes: int = 256 << 20) -> None:
    """The documents themselves as Parquet, a folder for each shard (shard=N; a column of docs of this name puts underscores before it), in files
    of about so many bytes of text."""
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, math.ceil(size / file_bytes / len(tree)))
    dealt = docs.withColumn(name, descend(F.col("doc_id"), tree).cast("int")).repartition(len(tree) * files, name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(files)))
    dealt.write.partitionBy(name).mode("overwrite").parquet(path)
