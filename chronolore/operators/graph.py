"""Walks over the fact graph. Access is tested at every step, so a walk never passes through what the reader may not see.

Walks have a fixed bound, so they are unrolled joins, one per hop, in one lazy plan; the search for shortest paths looks after each hop
whether it may stop.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolore.functions.text import keywords
from chronolore.functions.vectors import clamp
from chronolore.lineage import cut
from chronolore.operators.acl import readable
from chronolore.operators.temporal import held_at
from chronolore.schemas import PATH_EDGES

# Bounds of walks.
CHAIN_HOPS, CURRENCY_HOPS, PATH_HOPS, PATHS, ENTITIES = 10, 5, 6, 3, 10


def walk(edges: DataFrame, seeds: DataFrame, hops: int, allowed: DataFrame | None = None) -> DataFrame:
    """edges: src, dst. seeds: seed, node. Rows seed, node, depth (the least, from 0) of what is reached within so many hops, over allowed
    nodes (node) only if given; the seeds themselves are tested too."""
    level = seeds.select("seed", "node").distinct()
    steps = edges.select(F.col("src").alias("node"), "dst").distinct()
    if allowed is not None:  # tested once for each seed and each edge, not at every hop
        level = level.join(allowed.select("node"), "node", "left_semi")
        steps = steps.join(allowed.select(F.col("node").alias("dst")), "dst", "left_semi")
    level, found = level.select("seed", "node").withColumn("depth", F.lit(0)), []
    found.append(level)
    for depth in range(1, hops + 1):
        level = level.join(steps, "node").select("seed", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(depth))
        found.append(level)
    return reduce(DataFrame.unionByName, found).groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def chains(supersedes: DataFrame, seeds: DataFrame, allowed: DataFrame, hops: int = CHAIN_HOPS) -> DataFrame:
    """All versions of each seed's decision, older and newer: seed, node, depth (negative for older). supersedes: src (newer), dst (older).
    A seed that isn't allowed has none."""
    start = seeds.select("seed", F.col("seed").alias("node"))
    older = walk(supersedes, start, hops, allowed).withColumn("depth", -F.col("depth"))
    newer = walk(reversed_edges(supersedes), start, hops, allowed)
    return older.unionByName(newer).distinct()


def closure(edges: DataFrame, hops: int, allowed: DataFrame | None = None) -> DataFrame:
    """Rows src, dst, depth (the least) of all that reach each other within so many hops, over allowed nodes (node) only if given: what walk()
    finds for every node as a seed, by doubling. Ways of up to 2n hops are two ways of up to n, so there are as many joins as the bound has
    binary digits, each kept in the checkpoint folder."""
    steps = edges.select("src", "dst").distinct()
    if allowed is not None:
        for end in ("src", "dst"):
            steps = steps.join(allowed.select(F.col("node").alias(end)), end, "left_semi")
    least = lambda df: cut(df.groupBy("src", "dst").agg(F.min("depth").alias("depth")))

    def longer(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.select("src", F.col("dst").alias("mid"), F.col("depth").alias("d")).join(b.select(F.col("src").alias("mid"), "dst", "depth"), "mid")
        return least(a.unionByName(b).unionByName(both.select("src", "dst", (F.col("d") + F.col("depth")).alias("depth"))))

    power, out = least(steps.select("src", "dst", F.lit(1).alias("depth"))), None
    while hops:
        if hops & 1:
            out = power if out is None else longer(out, power)
        hops >>= 1
        if hops:
            power = longer(power, power)
    return out


def all_chains(supersedes: DataFrame, allowed: DataFrame, hops: int = CHAIN_HOPS) -> DataFrame:
    """chains() of every allowed node: seed, node, depth."""
    older = closure(supersedes, hops, allowed)
    own = allowed.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0))
    back = older.select(F.col("src").alias("seed"), F.col("dst").alias("node"), -F.col("depth"))
    return own.union(back).union(older.select("dst", "src", "depth"))


def currency_by_seed(supersedes: DataFrame, seeds: DataFrame, facts: DataFrame, grants: list[str], compat: bool = False) -> DataFrame:
    """Each seed (seed) itself and, of a stale one, the current readable facts that replaced it within five steps: rows seed, fact_id, distinct.
    compat walks through unreadable facts and tests only where the walk ends, as the engine this follows did."""
    open_facts = facts.where(readable(F.col("acl_grants"), grants))
    allowed = (facts if compat else open_facts).select(F.col("fact_id").alias("node"))
    stale = seeds.join(facts.where("valid_to IS NOT NULL").select(F.col("fact_id").alias("seed")), "seed", "left_semi")
    reached = walk(reversed_edges(supersedes), stale.select("seed", F.col("seed").alias("node")), CURRENCY_HOPS, allowed).where("depth > 0")
    now = reached.select("seed", F.col("node").alias("fact_id")).join(open_facts.where("valid_to IS NULL").select("fact_id"), "fact_id", "left_semi")
    return seeds.select("seed", F.col("seed").alias("fact_id")).unionByName(now).distinct()


def currency(supersedes: DataFrame, seeds: DataFrame, facts: DataFrame, grants: list[str], compat: bool = False) -> DataFrame:
    """seeds (seed) and what currency_by_seed finds for them: rows fact_id, distinct."""
    return currency_by_seed(supersedes, seeds, facts, grants, compat).select("fact_id").distinct()


def longest_chains(supersedes: DataFrame, hops: int = CHAIN_HOPS, k: int = 5) -> DataFrame:
    """head, length, chain (ids, newest first): the longest chain below each fact that nothing replaces; ties by the ids. The k longest."""
    heads = supersedes.select("src").distinct().join(supersedes.select(F.col("dst").alias("src")), "src", "left_anti")
    level = heads.select(F.col("src").alias("head"), F.array("src").alias("chain"))
    steps = supersedes.select(F.col("src").alias("tail"), "dst").distinct()
    found = []
    for _ in range(hops):
        level = level.withColumn("tail", F.element_at("chain", -1)).join(steps, "tail").where(~F.array_contains("chain", F.col("dst"))).select("head", F.concat("chain", F.array("dst")).alias("chain"))
        # Of the chains of one length to one place, one is enough.
        level = level.groupBy("head", F.element_at("chain", -1).alias("end")).agg(F.min("chain").alias("chain")).select("head", "chain")
        found.append(level)
    longest = reduce(DataFrame.unionByName, found).withColumn("length", F.size("chain") - 1).groupBy("head").agg(F.min(F.struct((-F.col("length")).alias("n"), "chain")).alias("best"))
    return longest.select("head", (-F.col("best.n")).alias("length"), "best.chain").orderBy(F.desc("length"), "head").limit(k)


@dataclass
class Graph:
    """nodes: node, kind, label, acl_grants (null: public). edges: src, dst, type."""

    nodes: DataFrame
    edges: DataFrame


def shortest_paths(graph: Graph, start: str, end: str, grants: list[str], hops: int = PATH_HOPS, limit: int = PATHS) -> DataFrame:
    """The shortest undirected paths over readable nodes: path_no, hops, nodes (ids), steps (struct type, forward). Paths are in the order of
    their ids and types.

    Breadth first, a join per hop; a node is visited once, at its least distance, with all edges that reach it there. What is kept per hop
    goes to the checkpoint folder. The paths are then put together backwards, over nodes of shortest paths only, the first few of each node.
    """
    hops = clamp(hops, 1, PATH_HOPS)
    spark = graph.nodes.sparkSession
    nodes = graph.nodes.where(readable(F.col("acl_grants"), grants)).select("node")
    kept = graph.edges.where(F.col("type").isin(PATH_EDGES))
    both = kept.select("src", "dst", "type", F.lit(True).alias("forward")).unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", F.lit(False).alias("forward")))
    none = spark.createDataFrame([], "path_no int, hops int, nodes array<string>, steps array<struct<type: string, forward: boolean>>")
    if start == end or nodes.where(F.col("node").isin(start, end)).select("node").distinct().count() < 2:
        return none
    frontier = visited = spark.createDataFrame([(start,)], "node string")
    levels: list[DataFrame] = []
    for _ in range(hops):
        step = both.join(frontier.select(F.col("node").alias("src")), "src").join(visited.select(F.col("node").alias("dst")), "dst", "left_anti").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
        levels.append(cut(step.select("src", "dst", "type", "forward").distinct()))
        n, there = levels[-1].agg(F.count(F.lit(1)), F.max(F.col("dst") == end)).first()
        if not n:
            return none
        if there:
            break
        frontier = levels[-1].select(F.col("dst").alias("node")).distinct()
        visited = visited.unionByName(frontier)
    else:
        return none
    back = spark.createDataFrame([(end, [end], [])], "at string, nodes array<string>, steps array<struct<type: string, forward: boolean>>")
    name = F.concat_ws("|", F.col("nodes"), F.transform("steps", lambda s: F.concat(s["type"], s["forward"].cast("string"))))
    for level in reversed(levels):
        back = level.join(back, level["dst"] == back["at"]).select(F.col("src").alias("at"), F.concat(F.array("src"), "nodes").alias("nodes"), F.concat(F.array(F.struct("type", "forward")), "steps").alias("steps"))
        # What comes before a node is the same for all ways on from it, so its first ways on are all that can be among the first paths.
        back = back.withColumn("_n", F.row_number().over(Window.partitionBy("at").orderBy(name))).where(F.col("_n") <= limit).drop("_n")
    numbered = back.agg(F.array_sort(F.collect_list(F.struct(name.alias("name"), "nodes", "steps"))).alias("p")).select(F.posexplode("p").alias("i", "p"))
    return numbered.select((F.col("i") + 1).alias("path_no"), F.size("p.steps").alias("hops"), "p.nodes", "p.steps")


def resolve_entity(graph: Graph, aliases: DataFrame, term: str, grants: list[str], limit: int = ENTITIES) -> DataFrame:
    """Readable nodes that a term names: the same label, id or alias, and only if there is none, those that contain it. node, kind, label."""
    wanted = term.strip().lower()
    open_nodes = graph.nodes.where(readable(F.col("acl_grants"), grants))
    other = aliases.select(F.col("person_id").alias("node"), F.lower("value").alias("name"))
    names = open_nodes.select("node", "kind", "label", F.explode(F.array(F.lower("label"), F.lower("node"))).alias("name")).unionByName(open_nodes.join(other, "node").select("node", "kind", "label", "name"))
    exact = names.where(F.col("name") == wanted).select("node", "kind", "label").distinct()
    if not wanted:
        return exact.limit(0)
    fuzzy = names.where(F.contains("name", F.lit(wanted))).select("node", "kind", "label").distinct()
    return (fuzzy if exact.isEmpty() else exact).orderBy("kind", "label", "node").limit(limit)


def owners(facts: DataFrame, owned: DataFrame, people: DataFrame, ranked: DataFrame, grants: list[str]) -> DataFrame:
    """Owners of ranked facts (fact_id, rank): person_id, name, best_rank, n_facts, methods, facts (newest first), in order of best rank,
    number of facts and name. owned: fact_id, person_id, method."""
    seen = facts.where(readable(F.col("acl_grants"), grants)).join(ranked, "fact_id").join(owned, "fact_id")
    own = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("occurred_at").cast("timestamp"))).alias("k"), "fact_id", "statement", "occurred_at", F.col("valid_to").isNull().alias("current"))))
    found = seen.groupBy("person_id").agg(F.min("rank").alias("best_rank"), F.count_distinct("fact_id").cast("int").alias("n_facts"), F.array_sort(F.collect_set("method")).alias("methods"), F.transform(own, lambda f: f.dropFields("k")).alias("facts"))
    return found.join(people.select("person_id", "name", "title", "email"), "person_id").orderBy("best_rank", F.desc("n_facts"), "name")


def unowned(ranked: DataFrame, owned: DataFrame) -> DataFrame:
    """Ranked facts without an owner."""
    return ranked.join(owned.select("fact_id"), "fact_id", "left_anti")


def withheld_count(facts: DataFrame, question: str, grants: list[str], moment: Column) -> DataFrame:
    """One row n: different facts that match the question at the moment but are out of the reader's access. 0 for a blank question."""
    spark = facts.sparkSession
    words = spark.createDataFrame([(question,)], "q string").select(F.explode(keywords(F.col("q"))).alias("w"))
    has = facts.where(~readable(F.col("acl_grants"), grants) & held_at(moment)).select("fact_id", F.explode(F.split(F.lower("statement"), r"[^\p{L}\p{N}]+")).alias("w"))
    return has.join(words, "w", "left_semi").agg(F.count_distinct("fact_id").alias("n"))


def hydrate(facts: DataFrame, episodes: DataFrame, people: DataFrame, owned: DataFrame, evidence: DataFrame, utterances: DataFrame, supersedes: DataFrame, ids: DataFrame, grants: list[str], compat: bool = False) -> DataFrame:
    """The facts of ids (fact_id, score) with all that a card shows. Children are gathered before they are joined, so nothing multiplies.
    What is shown of older and newer facts is readable, unless compat. A fact without an episode is left out."""
    picked = facts.join(ids, "fact_id")
    shown = facts if compat else facts.where(readable(F.col("acl_grants"), grants))
    allowed = None if compat else shown.select(F.col("fact_id").alias("node"))
    brief = shown.select("fact_id", "statement", "occurred_at", "status")
    back = walk(supersedes, ids.select(F.col("fact_id").alias("seed"), F.col("fact_id").alias("node")), CURRENCY_HOPS, allowed).where("depth > 0")
    refs = F.transform(F.array_sort(F.collect_set(F.struct((-F.unix_micros(F.col("occurred_at").cast("timestamp"))).alias("k"), "ref_id", "statement", "occurred_at", "status"))), lambda x: x.dropFields("k"))
    history = back.join(brief, back["node"] == brief["fact_id"]).select("seed", F.col("node").alias("ref_id"), "statement", "occurred_at", "status").groupBy(F.col("seed").alias("fact_id")).agg(refs.alias("history"))
    next_one = supersedes.join(ids, supersedes["dst"] == ids["fact_id"], "left_semi").join(brief, F.col("src") == brief["fact_id"])
    newer = next_one.select(F.col("dst").alias("id"), F.col("src").alias("ref_id"), "statement", "occurred_at", "status").groupBy(F.col("id").alias("fact_id")).agg(refs.alias("newer"))
    said = evidence.join(utterances.select("episode_id", "ordinal", "speaker", "at", "permalink"), ["episode_id", "ordinal"])
    quotes = said.groupBy("fact_id").agg(F.array_sort(F.collect_set(F.struct("episode_id", "ordinal", "span", "speaker", "at", "permalink"))).alias("quotes"))
    owner = owned.join(people.select("person_id", F.col("name").alias("owner_name")), "person_id").groupBy("fact_id").agg(F.min("owner_name").alias("owner_name"))
    source = episodes.select("episode_id", F.col("system").alias("episode_system"), "title", F.col("permalink").alias("episode_permalink"))
    out = picked.join(source, "episode_id").join(owner, "fact_id", "left").join(quotes, "fact_id", "left").join(history, "fact_id", "left").join(newer, "fact_id", "left")
    # A fact that no ranking found has the best score of its neighbours.
    near = history.select("fact_id", F.explode("history.ref_id").alias("ref_id")).unionByName(newer.select("fact_id", F.explode("newer.ref_id").alias("ref_id"))).join(ids.select(F.col("fact_id").alias("ref_id"), F.col("score").alias("near")), "ref_id").groupBy("fact_id").agg(F.max("near").alias("near"))
    scored = out.join(near, "fact_id", "left").withColumn("score", F.coalesce("score", "near", F.lit(0.0))).drop("near")
    return scored.withColumn("quotes", F.coalesce("quotes", F.array().cast(scored.schema["quotes"].dataType))).withColumn("history", F.coalesce("history", F.array().cast(scored.schema["history"].dataType))).withColumn("newer", F.coalesce("newer", F.array().cast(scored.schema["newer"].dataType)))

