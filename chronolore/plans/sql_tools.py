"""The tools as SQL table functions over views that are bound to one reader's grants.

publish() makes temporary views of what a reader may see, and over these the functions search_knowledge, trace_decision, find_owner and facts_at, for
SQL text of any kind. Whose eyes they read with is never an argument.

    publish(tables, Reader("ops", ["slack:C2"]))
    SELECT * FROM search_knowledge('When is the launch?', NULL, TIMESTAMP '2026-04-15', 8)
    SELECT f.fact_id, t.* FROM facts f, LATERAL trace_decision(f.fact_id) t

The functions are plain SQL that Spark plans with the query around them: words are joined by equality with those asked for before they are counted, chains are a table of pairs made
by publish(). search_knowledge and find_owner take one question, as Spark doesn't take a union below LATERAL; ask.retrieve_many is for tables of questions. Their
only joins without an equality are with the one row of statistics. A question's vector is compared with every readable fact, and each task keeps its forty best.
Paths between entities have no function: a recursive query lists all ways within six hops before it finds the shortest; ask.path_between doesn't.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolore.functions.text import STOPWORDS
from chronolore.operators import graph, models, search
from chronolore.operators.acl import readable
from chronolore.operators.text_index import B, K1
from chronolore.plans.ask import Reader, supersedes

HELD = "(as_of IS NULL OR valid_from <= as_of AND (valid_to IS NULL OR valid_to > as_of))"
ORDER = "score DESC, valid_to IS NULL DESC, occurred_at DESC, fact_id"
FOUND = "rank INT, fact_id STRING, type STRING, statement STRING, title STRING, score DOUBLE, occurred_at TIMESTAMP, valid_from TIMESTAMP, valid_to TIMESTAMP"


def views(t: dict[str, DataFrame], reader: Reader) -> dict[str, DataFrame]:
    """What the functions read, by name; facts that are not readable are in none."""
    titles = t["episodes"].select("episode_id", "title").withColumn("has_episode", F.lit(True))
    words = F.filter(F.split(F.lower("statement"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    number = F.transform("embedding", lambda x: x.cast("double"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = t["facts"].where(readable(F.col("acl_grants"), reader.grants)).withColumn("_words", words).withColumn("vector", number)
    facts = facts.withColumn("length", F.coalesce(F.size("_words"), F.lit(0))).withColumn("norm", F.sqrt(squares)).join(titles, "episode_id", "left")
    allowed = facts.select(F.col("fact_id").alias("node"))
    later = graph.closure(supersedes(t), graph.CHAIN_HOPS, allowed).select(F.col("src").alias("newer"), F.col("dst").alias("older"), "depth")
    near = later.where(F.col("depth") <= graph.CURRENCY_HOPS)
    own = allowed.distinct().select(F.col("node").alias("seed"), F.col("node").alias("fact_id"), F.lit(0).alias("depth"))
    return {
        "facts": facts.select("fact_id", "type", "statement", "status", "title", "has_episode", "occurred_at", "valid_from", "valid_to", "length", "vector", "norm"),
        "words": facts.select("fact_id", "valid_from", "valid_to", "length", F.explode("_words").alias("term")),
        "later": near,
        "around": near.select(F.col("newer").alias("fact_id"), F.col("older").alias("other")).union(later.where("depth = 1").select("older", "newer")).distinct(),
        "chains": own.union(later.select("newer", "older", -F.col("depth"))).union(later.select("older", "newer", "depth")),
        "owners": t["ownership"].where("person_id IS NOT NULL").join(t["people"].select("person_id", "name"), "person_id").select("fact_id", "person_id", "name", "method"),
    }


def functions(p: str) -> dict[str, tuple[str, str, str]]:
    """Arguments, columns and query of each function, over views whose names begin with p."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    seeds, rrf, per_title = search.SEEDS, search.RRF_K, search.PER_EPISODE
    found = f"""
        WITH asked AS (SELECT explode(array_distinct(filter(split(lower(question), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> length(w) > 2 AND NOT array_contains(array({stop}), w)))) AS term),
        held AS (SELECT fact_id, length, vector AS own, norm FROM {p}facts WHERE {HELD}),
        whole AS (SELECT count(*) AS n, avg(length) AS average FROM held),
        had AS (SELECT fact_id, term, count(*) AS tf, length FROM {p}words JOIN asked USING (term) WHERE {HELD} GROUP BY fact_id, term, length),
        often AS (SELECT term, count(*) AS df FROM had GROUP BY term),
        worded AS (
            SELECT fact_id, round(sum(ln(1D + (n - df + 0.5D) / (df + 0.5D)) * (tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * length / average)))), 6) AS score
            FROM had JOIN often USING (term) JOIN whole ON true GROUP BY fact_id),
        near AS (
            SELECT fact_id, round(aggregate(zip_with(own, vector, (x, y) -> x * y), 0D, (s, x) -> s + x) / (norm * sqrt(aggregate(vector, 0D, (s, x) -> s + x * x))), 6) AS score
            FROM held WHERE norm > 0 AND size(own) = size(vector)),
        ranked AS (
            SELECT fact_id, k FROM (SELECT fact_id, row_number() OVER (ORDER BY score DESC, fact_id) AS k FROM worded) WHERE k <= {seeds}
            UNION ALL SELECT fact_id, k FROM (SELECT fact_id, row_number() OVER (ORDER BY score DESC, fact_id) AS k FROM near) WHERE k <= {seeds}),
        fused AS (SELECT fact_id, round(sum(1D / ({rrf} + k)), 9) AS score FROM ranked GROUP BY fact_id),
        led AS (
            SELECT l.newer AS fact_id FROM fused JOIN {p}facts f USING (fact_id) JOIN {p}later l ON l.older = f.fact_id JOIN {p}facts g ON g.fact_id = l.newer
            WHERE as_of IS NULL AND f.valid_to IS NOT NULL AND g.valid_to IS NULL),
        known AS (SELECT fact_id, score, CAST(NULL AS DOUBLE) AS beside FROM fused UNION ALL SELECT l.fact_id, NULL, f.score FROM led l JOIN {p}around a ON a.fact_id = l.fact_id JOIN fused f ON f.fact_id = a.other),
        scored AS (SELECT fact_id, coalesce(max(score), max(beside)) AS score FROM known GROUP BY fact_id),
        cards AS (SELECT f.fact_id, type, statement, title, score, occurred_at, valid_from, valid_to FROM scored JOIN {p}facts f USING (fact_id) WHERE has_episode),
        kept AS (SELECT *, row_number() OVER (PARTITION BY coalesce(title, '?') ORDER BY {ORDER}) AS place FROM cards),
        placed AS (SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INT) AS rank, * FROM kept WHERE place <= {per_title})
        SELECT rank, fact_id, type, statement, title, score, occurred_at, valid_from, valid_to FROM placed WHERE rank <= most"""
    facts = "fact_id, type, statement, status, title, occurred_at, valid_from, valid_to"
    typed = "fact_id STRING, type STRING, statement STRING, status STRING, title STRING, occurred_at TIMESTAMP, valid_from TIMESTAMP, valid_to TIMESTAMP"
    return {
        "facts_at": ("as_of TIMESTAMP", typed, f"SELECT {facts} FROM {p}facts WHERE {HELD}"),
        "search_knowledge": ("question STRING, vector ARRAY<DOUBLE>, as_of TIMESTAMP, most INT", FOUND, found),
        "trace_decision": ("fact STRING", f"depth INT, {typed}", f"SELECT depth, {facts} FROM {p}chains JOIN {p}facts USING (fact_id) WHERE seed = fact"),
        "find_owner": (
            "question STRING, vector ARRAY<DOUBLE>, most INT", "person_id STRING, name STRING, best_rank INT, n_facts INT, methods ARRAY<STRING>",
            f"SELECT person_id, name, min(rank), CAST(count(DISTINCT fact_id) AS INT), array_sort(collect_set(method)) FROM {p}search_knowledge(question, vector, NULL, most) JOIN {p}owners USING (fact_id) GROUP BY person_id, name",
        ),
    }


def publish(t: dict[str, DataFrame], reader: Reader | None = None, prefix: str = "", embedder: models.Embedder = models.hashing_embedder) -> None:
    """Temporary views and functions of the session for one reader, all with the prefix, so that several readers can be there at once; embed(text) is a
    question's vector. What was published under the prefix before is replaced.

    facts_at(as_of): readable facts that hold then, all for null. search_knowledge(question, vector, as_of, most): ask.retrieve's facts, by words
    alone if vector is null; an empty or null question has none by words. trace_decision(fact): its versions with depth (negative: older), none if it can't be
    seen. find_owner(question, vector, most): who owns what was found."""
    spark = t["facts"].sparkSession

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embedder([s or "" for s in texts])])

    spark.udf.register(f"{prefix}embed", embed)
    for name, df in views(t, reader or Reader()).items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    for name, (arguments, columns, query) in functions(prefix).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS TABLE ({columns}) RETURN {query}")
