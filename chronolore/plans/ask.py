"""Questions: retrieve, make cards, answer; and the four tools over the same tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolore.functions.dates import as_of as moment_of
from chronolore.functions.text import citations
from chronolore.functions.vectors import clamp
from chronolore.lineage import cut
from chronolore.operators import graph, models, render, search, vector_index
from chronolore.operators.acl import readable
from chronolore.operators.temporal import held_at
from chronolore.plans import load

# Fixed values.
LIMIT_DEFAULT, LIMIT_MOST = 8, 25


@dataclass
class Reader:
    """Who asks, and the grants they hold; without any they see what is public."""

    name: str = "anonymous"
    grants: list[str] = field(default_factory=list)


def readable_facts(t: dict[str, DataFrame], reader: Reader, as_of: str | None) -> DataFrame:
    return t["facts"].where(readable(F.col("acl_grants"), reader.grants) & held_at(moment_of(as_of)))


def supersedes(t: dict[str, DataFrame]) -> DataFrame:
    return t["edges"].where("type = 'SUPERSEDES'").select(F.col("newer").alias("src"), F.col("older").alias("dst")).distinct()


def seeds(t: dict[str, DataFrame], question: str, reader: Reader, as_of: str | None, embedder: models.Embedder, k: int) -> DataFrame:
    """fact_id, score of both strategies fused."""
    spark, facts = t["facts"].sparkSession, readable_facts(t, reader, as_of)
    by_vector = search.vector_top(facts, [float(x) for x in embedder([question])[0]], k).select("fact_id", "rank")
    asked = spark.createDataFrame([(0, question)], "query_id long, question string")
    by_words = search.bm25_top(facts, asked, k).select("fact_id", "rank")
    return search.fuse(by_vector.unionByName(by_words), [], "fact_id")


def retrieve(t: dict[str, DataFrame], question: str, reader: Reader | None = None, as_of: str | None = None, limit: int = search.FINAL, seed_limit: int = search.SEEDS, embedder: models.Embedder = models.hashing_embedder, compat: bool = False) -> DataFrame:
    """The best facts for a question, hydrated and ranked (rank from 1), with held_at_as_of."""
    reader = reader or Reader()
    found = cut(seeds(t, question, reader, as_of, embedder, seed_limit))
    ids = found
    if as_of is None:
        now = graph.currency(supersedes(t), found.select(F.col("fact_id").alias("seed")), t["facts"], reader.grants, compat)
        ids = cut(now.join(found, "fact_id", "left"))
    full = graph.hydrate(t["facts"], t["episodes"], t["people"], t["ownership"].where("person_id IS NOT NULL"), t["evidence"], t["utterances"], supersedes(t), ids, reader.grants, compat)
    ranked = search.rerank(full.withColumn("query_id", F.lit(0)), ["query_id"], limit).drop("query_id")
    return ranked.withColumn("held_at_as_of", held_at(moment_of(as_of)))


def extractive_chat(cards: list[str]) -> list[str]:
    """The answer without a model: the first card's statement, cited; a refusal without cards."""
    return [models.NOT_FOUND if not c or c == render.NOTHING else f"{c.splitlines()[1].strip()} [1]" for c in cards]


def ask(t: dict[str, DataFrame], question: str, reader: Reader | None = None, as_of: str | None = None, chat: models.Chat = extractive_chat, limit: int = search.FINAL, embedder: models.Embedder = models.hashing_embedder) -> DataFrame:
    """One row: answer, refused, citations (array of card numbers that were given), n_cards, grounded, pack. No cards: a refusal, unasked."""
    cards = retrieve(t, question, reader, as_of, limit, embedder=embedder).withColumn("card", render.card()).withColumn("query_id", F.lit(0))
    packed = render.pack(cards, ["query_id"])
    one = t["facts"].sparkSession.createDataFrame([(0,)], "query_id int").join(packed, "query_id", "left")
    return answered(one, chat).select("answer", "refused", "citations", "n_cards", "grounded", "pack")


def retrieve_many(t: dict[str, DataFrame], questions: DataFrame, reader: Reader | None = None, as_of: str | None = None, limit: int = search.FINAL, seed_limit: int = search.SEEDS, embedder: models.Embedder = models.hashing_embedder, indexes: load.Indexes | None = None) -> DataFrame:
    """retrieve() for any number of one reader's questions (query_id, question and, if they have them, embedding) in one plan: query_id and the
    columns of a hydrated fact. A fact is hydrated once, however many questions find it. With stored indexes of the facts these are searched
    instead, with the same result."""
    reader = reader or Reader()
    facts = readable_facts(t, reader, as_of)
    asked = questions if "embedding" in questions.columns else models.embed(questions, "question", embedder)
    vectors = asked.select(F.col("query_id").alias("fact_id"), "embedding")
    if indexes:
        by_vector = vector_index.search(indexes.vectors, vectors, seed_limit, "fact_id", readable(F.col("acl_grants"), reader.grants) & held_at(moment_of(as_of)), own=True)
        by_words = search.bm25_top(None, questions, seed_limit, index=indexes.facts, allowed=facts.select("fact_id"))
    else:
        by_vector = search.vector_top_all(facts, vectors, seed_limit, "fact_id", own=True)
        by_words = search.bm25_top(facts, questions, seed_limit)
    found = cut(search.fuse(by_vector.select("query_id", "fact_id", "rank").unionByName(by_words.select("query_id", "fact_id", "rank")), ["query_id"], "fact_id"))
    ids = found
    if as_of is None:
        now = graph.currency_by_seed(supersedes(t), found.select(F.col("fact_id").alias("seed")).distinct(), t["facts"], reader.grants)
        both = found.select("query_id", F.col("fact_id").alias("seed")).join(now, "seed").select("query_id", "fact_id").distinct()
        ids = cut(both.join(found, ["query_id", "fact_id"], "left"))
    wanted = ids.select("fact_id").distinct().withColumn("score", F.lit(None).cast("double"))
    full = graph.hydrate(t["facts"].drop("score"), t["episodes"], t["people"], t["ownership"].where("person_id IS NOT NULL"), t["evidence"], t["utterances"], supersedes(t), wanted, reader.grants).drop("score")
    cards = ids.join(full, "fact_id")
    # A fact that no ranking found has the best score of its neighbours.
    next_to = cards.where("score IS NULL").select("query_id", "fact_id", F.explode(F.concat(F.col("history.ref_id"), F.col("newer.ref_id"))).alias("ref_id"))
    near = next_to.join(found.select("query_id", F.col("fact_id").alias("ref_id"), F.col("score").alias("near")), ["query_id", "ref_id"]).groupBy("query_id", "fact_id").agg(F.max("near").alias("near"))
    scored = cards.join(near, ["query_id", "fact_id"], "left").withColumn("score", F.coalesce("score", "near", F.lit(0.0))).drop("near")
    return search.rerank(scored, ["query_id"], limit).withColumn("held_at_as_of", held_at(moment_of(as_of)))


def search_utterances(t: dict[str, DataFrame], questions: DataFrame, reader: Reader | None = None, k: int = search.FINAL, indexes: load.Indexes | None = None) -> DataFrame:
    """query_id, rank, score and the utterance: what was said, in episodes that the reader may see, that best fits each question (query_id, question)."""
    reader = reader or Reader()
    open_episodes = t["episodes"].where(readable(F.col("acl_grants"), reader.grants)).select("episode_id", "title")
    said = load.said_keys(t["utterances"].join(open_episodes, "episode_id"))
    if indexes:
        found = search.bm25_top(None, questions, k, "utterance_key", "text", indexes.utterances, said.select("utterance_key"))
    else:
        found = search.bm25_top(said, questions, k, "utterance_key", "text")
    return found.join(said, "utterance_key").select("query_id", "rank", "score", "utterance_key", "episode_id", "ordinal", "title", "speaker", "at", "text", "permalink")


def answered(packs: DataFrame, chat: models.Chat) -> DataFrame:
    """packs (n_cards and pack, null where no card was found) with answer, refused, citations (card numbers that were given) and grounded. No
    cards: a refusal, unasked."""
    packs = packs.withColumn("n_cards", F.coalesce("n_cards", F.lit(0))).withColumn("pack", F.coalesce("pack", F.lit(render.NOTHING)))
    said = models.ask(packs.where("n_cards > 0"), "pack", chat).unionByName(packs.where("n_cards = 0").withColumn("answer", F.lit(models.NOT_FOUND)))
    refused = (F.col("n_cards") == 0) | F.contains("answer", F.lit(models.NOT_FOUND))
    cited = F.when(refused, F.array().cast("array<int>")).otherwise(F.filter(citations(F.col("answer")), lambda n: (n >= 1) & (n <= F.col("n_cards"))))
    return said.withColumn("refused", refused).withColumn("citations", cited).withColumn("grounded", ~F.col("refused") & (F.size("citations") > 0))


def ask_many(t: dict[str, DataFrame], questions: DataFrame, reader: Reader | None = None, as_of: str | None = None, chat: models.Chat = extractive_chat, limit: int = search.FINAL, embedder: models.Embedder = models.hashing_embedder) -> DataFrame:
    """ask() for any number of one reader's questions (query_id, question): a row for each."""
    cards = retrieve_many(t, questions, reader, as_of, limit, embedder=embedder).withColumn("card", render.card())
    packs = questions.select("query_id").distinct().join(render.pack(cards, ["query_id"]), "query_id", "left")
    return answered(packs, chat).select("query_id", "answer", "refused", "citations", "n_cards", "grounded", "pack")


class ToolError(ValueError):
    """An argument that a tool can't work with."""


def needed(args: dict, name: str) -> str:
    value = str(args.get(name) or "").strip()
    if not value:
        raise ToolError(f"'{name}' is required")
    return value


def limit_of(args: dict) -> int:
    return clamp(int(args.get("limit") or LIMIT_DEFAULT), 1, LIMIT_MOST)


def search_knowledge(t: dict[str, DataFrame], reader: Reader, args: dict) -> str:
    """args: query, as_of, limit. Whose eyes it reads with is never an argument."""
    query, as_of = needed(args, "query"), args.get("as_of")
    cards = retrieve(t, query, reader, as_of, limit_of(args)).withColumn("card", render.card()).orderBy("rank").select("card").collect()
    withheld = graph.withheld_count(t["facts"], query, reader.grants, moment_of(as_of)).first()["n"]
    return render.search_report("".join(r["card"] + "\n" for r in cards), len(cards), reader.name, as_of, withheld)


def trace_decision(t: dict[str, DataFrame], reader: Reader, args: dict) -> str:
    """args: query or fact_id."""
    fact, others, query = args.get("fact_id"), [], args.get("query")
    if not fact:
        found = retrieve(t, needed(args, "query"), reader).orderBy("rank").select("fact_id", "statement").collect()
        fact, others = (found[0]["fact_id"], found[1:]) if found else (None, [])
    if not fact:
        return render.trace_report(query, [], [])
    spark = t["facts"].sparkSession
    open_facts = t["facts"].where(readable(F.col("acl_grants"), reader.grants))
    chain = graph.chains(supersedes(t), spark.createDataFrame([(fact,)], "seed string"), open_facts.select(F.col("fact_id").alias("node"))).select(F.col("node").alias("fact_id")).distinct()
    owner = t["ownership"].join(t["people"].select("person_id", "name"), "person_id").groupBy("fact_id").agg(F.min("name").alias("owner_name"))
    links = open_facts.join(chain, "fact_id").join(owner, "fact_id", "left").join(t["episodes"].select("episode_id", F.col("system").alias("episode_system"), "title", "permalink"), "episode_id", "left")
    return render.trace_report(query or fact, links.orderBy("occurred_at", "fact_id").collect(), others)


def find_owner(t: dict[str, DataFrame], reader: Reader, args: dict) -> str:
    """args: query, limit."""
    query = needed(args, "query")
    ranked = cut(retrieve(t, query, reader, limit=limit_of(args)).select("fact_id", "rank"))
    owned = t["ownership"].where("person_id IS NOT NULL")
    found = graph.owners(t["facts"], owned, t["people"], ranked, reader.grants).collect()
    return render.owners_report(query, found, ranked.count(), graph.unowned(ranked, owned).count())


def path_between(t: dict[str, DataFrame], reader: Reader, args: dict) -> str:
    """args: from, to, max_hops."""
    whole, ends = load.graph(t), []
    for side in ("from", "to"):
        term = needed(args, side)
        found = graph.resolve_entity(whole, t["aliases"], term, reader.grants).collect()
        if not found:
            return render.unresolved_report(side, term)
        if len(found) > 1:
            return render.ambiguous_report(side, term, found)
        ends.append(found[0])
    paths = graph.shortest_paths(whole, ends[0]["node"], ends[1]["node"], reader.grants, int(args.get("max_hops") or graph.PATH_HOPS)).orderBy("path_no").collect()
    shown = {n for p in paths for n in p["nodes"]}
    nodes = {r["node"]: r for r in whole.nodes.where(F.col("node").isin(list(shown))).collect()} if shown else {}
    return render.paths_report(ends[0], ends[1], paths, nodes)


TOOLS = {"search_knowledge": search_knowledge, "trace_decision": trace_decision, "find_owner": find_owner, "path_between": path_between}
