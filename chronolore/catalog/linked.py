"""Events as a graph of facts, people, episodes and topics: what answers and notes are made of; and single functions over whole tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolore.catalog import EVENT_FACTS_SQL, FACT_TYPES, HELD, VERSIONS_SQL, Catalog, event_facts, table
from chronolore.catalog.asks import BM25_SQL, RUNS_SQL, supersedes
from chronolore.catalog.facts import versions
from chronolore.functions import dates, ids, text
from chronolore.functions.dates import as_of
from chronolore.lineage import shared_folder
from chronolore.operators import export, graph, models, resolve, search, stats, supersede, text_index
from chronolore.operators.acl import readable
from chronolore.plans import ask, extract, load, sql_tools
from chronolore.sources import directory
from chronolore.streaming import versions as stream_versions

query = Catalog()


@cache
def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables of a load (plans.load) made of events: a user's events are an episode, an event is an utterance and a fact that quotes it, owned by one
    of 50 people; consecutive facts of a user and type replace each other."""
    c, as_text = F.col, lambda x: F.col(x).cast("string")
    facts = versions(spark, d).select(
        as_text("fact_id").alias("fact_id"), F.concat(F.lit("user:"), as_text("user_id")).alias("episode_id"), "type", "statement", F.lit("someone").alias("owner_mention"), c("occurred_at").cast("timestamp").alias("occurred_at"), F.lit("AGREED").alias("status"),
        c("valid_from").cast("timestamp").alias("valid_from"), c("valid_to").cast("timestamp").alias("valid_to"), "acl_grants", F.lit("PUBLIC").alias("visibility"), c("fact_id").alias("number"), "user_id", c("value").alias("score"),
    )
    person = F.concat(F.lit("p"), (c("user_id") % 50).cast("string"))
    none = F.lit(None).cast("string")
    users = facts.select("episode_id", "user_id").distinct()
    edges = supersedes(spark, d).select(as_text("src").alias("newer"), as_text("dst").alias("older"), F.lit("SUPERSEDES").alias("type"))
    people = users.select(person.alias("person_id"), F.concat(F.lit("Name "), (c("user_id") % 50).cast("string")).alias("name"), none.alias("email"), none.alias("title"), F.array().cast("array<string>").alias("aliases")).distinct()
    return {
        "facts": facts, "edges": edges, "people": people,
        "episodes": users.select("episode_id", F.lit("SLACK").alias("system"), F.concat(F.lit("User "), as_text("user_id")).alias("title"), none.alias("permalink"), F.lit(HELD).cast("timestamp").alias("occurred_at"), F.lit("PUBLIC").alias("visibility")),
        "utterances": facts.select("episode_id", c("number").cast("int").alias("ordinal"), F.lit("x").alias("speaker"), c("occurred_at").alias("at"), c("statement").alias("text"), none.alias("permalink")),
        "speakers": users.select("episode_id", person.alias("person_id")),
        "evidence": facts.select("fact_id", "episode_id", c("number").cast("int").alias("ordinal"), c("statement").alias("span")),
        "ownership": facts.select("fact_id", F.when(c("number") % 3 > 0, person).alias("person_id"), F.lit("HANDLE").alias("method")),
        "topics": facts.select("fact_id", F.lower("type").alias("topic")),
    }


@query(f"""
    WITH {RUNS_SQL}, older AS (SELECT a.fact_id, count(*) AS n FROM g a JOIN g b ON a.user_id = b.user_id AND a.type = b.type AND a.run = b.run AND NOT a.hidden AND NOT b.hidden AND a.place - b.place BETWEEN 1 AND 5 GROUP BY 1)
    SELECT CAST(g.fact_id AS VARCHAR) AS fact_id, 'User ' || g.user_id AS title, CASE WHEN g.fact_id % 3 > 0 THEN 'Name ' || g.user_id % 50 END AS owner_name, 1 AS n_quotes, CAST(coalesce(older.n, 0) AS INT) AS n_history,
        CASE WHEN g.next_id IS NOT NULL AND g.next_id % 5 > 0 THEN 1 ELSE 0 END AS n_newer, g.value AS score
    FROM g LEFT JOIN older ON older.fact_id = g.fact_id""")
def hydrated_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every fact with all that its card shows: episode, owner, quotes, what it replaced and what replaced it, as far as it is public."""
    t = tables(spark, d)
    full = graph.hydrate(t["facts"].drop("score"), t["episodes"], t["people"], t["ownership"].where("person_id IS NOT NULL"), t["evidence"], t["utterances"], ask.supersedes(t), t["facts"].select("fact_id", "score"), [])
    return full.select("fact_id", "title", "owner_name", F.size("quotes").alias("n_quotes"), F.size("history").alias("n_history"), F.size("newer").alias("n_newer"), "score")


@query(f"""
    WITH {VERSIONS_SQL}, n AS (SELECT *, lag(statement) OVER w AS older, lead(statement) OVER w AS newer FROM v WINDOW w AS (PARTITION BY user_id, type ORDER BY occurred_at, fact_id))
    SELECT CAST(fact_id AS VARCHAR) AS fact_id, 'User ' || user_id AS title, CASE WHEN fact_id % 3 > 0 THEN 'Name ' || user_id % 50 END AS owner, lower(type) AS topics, statement AS quoted, coalesce(older, '') AS replaced, coalesce(newer, '') AS replaced_by FROM n""")
def fact_notes(spark: SparkSession, d: str) -> DataFrame:
    """What the notes of facts list."""
    rows = export.fact_rows(tables(spark, d))
    return rows.select("fact_id", "title", "owner", F.array_join("topic_names", ",").alias("topics"), F.array_join("quotes.span", ",").alias("quoted"), F.array_join("replaced", ",").alias("replaced"), F.array_join("replaced_by", ",").alias("replaced_by"))


@query(f"""
    WITH {VERSIONS_SQL}, o AS (SELECT DISTINCT user_id % 50 AS p, statement, valid_to IS NULL AS current FROM v WHERE fact_id % 3 > 0), p AS (SELECT DISTINCT user_id % 50 AS p FROM v)
    SELECT 'p' || p.p AS person_id, CAST(count(o.statement) AS INT) AS n_owned, md5(coalesce(string_agg(o.statement || CASE WHEN o.current THEN '+' ELSE '-' END, ',' ORDER BY o.current DESC, o.statement), '')) AS owned_md5 FROM p LEFT JOIN o ON o.p = p.p GROUP BY p.p""")
def people_notes(spark: SparkSession, d: str) -> DataFrame:
    """What the notes of people list: the facts that they own, current ones first."""
    rows = export.people_rows(tables(spark, d))
    said = F.transform("owned", lambda o: F.concat(o["statement"], F.when(o["current"], "+").otherwise("-")))
    return rows.select("person_id", F.size("owned").alias("n_owned"), F.md5(F.array_join(said, ",")).alias("owned_md5"))


@query(f"""WITH {EVENT_FACTS_SQL}
    SELECT 'user:' || user_id AS episode_id, count(*) AS n_utterances, 'Name ' || user_id % 50 AS people, md5(string_agg(DISTINCT statement, ',' ORDER BY statement)) AS facts_md5 FROM f GROUP BY user_id""")
def episode_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = export.episode_rows(tables(spark, d))
    return rows.select("episode_id", "n_utterances", F.array_join("people", ",").alias("people"), F.md5(F.array_join("facts", ",")).alias("facts_md5"))


@query(f"""WITH {EVENT_FACTS_SQL} SELECT lower(type) AS topic, CAST(count(DISTINCT statement) AS INT) AS n_facts, md5(string_agg(DISTINCT statement, ',' ORDER BY statement)) AS facts_md5 FROM f GROUP BY type""")
def topic_notes(spark: SparkSession, d: str) -> DataFrame:
    return export.topic_rows(tables(spark, d)).select("topic", F.size("facts").alias("n_facts"), F.md5(F.array_join("facts", ",")).alias("facts_md5"))


@query(f"""
    WITH {VERSIONS_SQL}, t AS (SELECT user_id, type, least(count(*) - 1, 10) AS length, CAST(max_by(fact_id, place) AS VARCHAR) AS head, max(place) AS last FROM v GROUP BY ALL HAVING count(*) > 1),
    top AS (SELECT * FROM t ORDER BY length DESC, head LIMIT 5)
    SELECT head, CAST(length AS INT) AS length, md5(string_agg(statement, ',' ORDER BY place DESC)) AS statements_md5 FROM top JOIN v USING (user_id, type) WHERE place >= last - length GROUP BY head, length""")
def index_chains(spark: SparkSession, d: str) -> DataFrame:
    """The longest chains, as the index of notes lists them."""
    return export.index_rows(tables(spark, d)).select("head", F.col("length").cast("int").alias("length"), F.md5(F.array_join("statements", ",")).alias("statements_md5"))


@query(f"""WITH {VERSIONS_SQL}
    SELECT count(*) AS n FROM v WHERE hidden AND valid_from <= TIMESTAMP '{HELD}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{HELD}') AND regexp_matches(lower(statement), '(^|[^\\p{{L}}\\p{{N}}])(purchase|error)([^\\p{{L}}\\p{{N}}]|$)')""")
def withheld_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many hidden facts of the moment fit a question."""
    return graph.withheld_count(tables(spark, d)["facts"], "What about the purchase and the error?", [], as_of(HELD))


@query(f"""
    WITH {VERSIONS_SQL}, n AS (SELECT *, lag(fact_id) OVER w AS older_id, lag(occurred_at) OVER w AS older_at FROM v WINDOW w AS (PARTITION BY user_id, type ORDER BY occurred_at, fact_id))
    SELECT CAST(fact_id AS VARCHAR) AS newer, CAST(older_id AS VARCHAR) AS older, CASE (fact_id + older_id) % 3 WHEN 0 THEN 'SUPERSEDES' WHEN 1 THEN 'DUPLICATE' ELSE 'UNRELATED' END AS verdict FROM n WHERE older_id IS NOT NULL AND older_at < occurred_at""")
def neighbour_fold(spark: SparkSession, d: str) -> DataFrame:
    """The fold over pairs of neighbouring facts; a judge of their numbers. Each fact has one possible predecessor, still open when it comes."""
    return neighbour_judgements(spark, d).select("newer", "older", "verdict")


def neighbour_judgements(spark: SparkSession, d: str) -> DataFrame:
    facts, order = versions(spark, d), Window.partitionBy("user_id", "type").orderBy("occurred_at", "fact_id")
    text_of = lambda c: F.col(c).cast("string")
    rows = facts.select(text_of("fact_id").alias("newer"), F.lag(text_of("fact_id")).over(order).alias("older"), F.col("occurred_at").cast("timestamp").alias("newer_at"), F.lag(F.col("occurred_at").cast("timestamp")).over(order).alias("older_at"), F.col("fact_id").alias("newer_seq"), F.lag("fact_id").over(order).alias("older_seq"), F.lit(1.0).alias("similarity"))
    pairs = rows.where("older IS NOT NULL AND older_at < newer_at")
    judge = lambda old, new, _: (("SUPERSEDES", "DUPLICATE", "UNRELATED")[(int(old) + int(new)) % 3], "x")
    return supersede.fold(facts.select(text_of("fact_id").alias("fact_id"), text_of("fact_id").alias("statement")), pairs, judge)


@query(f"""
    WITH {VERSIONS_SQL} SELECT CAST(fact_id AS VARCHAR) AS fact_id, epoch_us(valid_to) AS closed_us, CAST(next_id AS VARCHAR) AS superseded_by FROM v WHERE next_id IS NOT NULL AND (fact_id + next_id) % 3 = 0 AND valid_to > valid_from""")
def fold_closures(spark: SparkSession, d: str) -> DataFrame:
    """Which facts the fold closes, when and by what."""
    ends = supersede.closures(neighbour_judgements(spark, d))
    return ends.select("fact_id", F.unix_micros("closed_at").alias("closed_us"), "superseded_by")


@query(f"""
    WITH {VERSIONS_SQL}, j AS (SELECT CAST(fact_id AS VARCHAR) AS older, CAST(next_id AS VARCHAR) AS newer, (fact_id + next_id) % 3 AS k FROM v WHERE next_id IS NOT NULL AND valid_to > valid_from)
    SELECT newer, older, CASE k WHEN 0 THEN 'SUPERSEDES' ELSE 'DUPLICATE_OF' END AS type, false AS via_duplicate FROM j WHERE k < 2""")
def stored_edges(spark: SparkSession, d: str) -> DataFrame:
    """The judgements as stored edges, before closures are passed on."""
    none = spark.createDataFrame([], "fact_id string, closed_at timestamp, superseded_by string, propagated boolean")
    return supersede.edges(neighbour_judgements(spark, d), none).select("newer", "older", "type", "via_duplicate")


def document_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables of a load made of documents: a document is a fact, every fourth in a row is the last version of those before it, those of fives are
    hidden; its source is its episode."""
    c, none = F.col, F.lit(None).cast("string")
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    nxt = docs.select((c("doc_id") - 1).alias("doc_id"), c("doc_id").alias("next_id")).where("doc_id % 4 < 3")
    rows = docs.join(nxt, "doc_id", "left").join(table(spark, d, "embeddings").select(c("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    at = lambda x: F.timestamp_seconds(x * 60)
    facts = rows.select(
        c("doc_id").cast("string").alias("fact_id"), c("source").alias("episode_id"), F.lit("DECISION").alias("type"), c("text").alias("statement"), F.lit("AGREED").alias("status"), at(c("doc_id")).alias("occurred_at"), at(c("doc_id")).alias("valid_from"), at(c("next_id")).alias("valid_to"),
        F.when(c("doc_id") % 5 == 0, F.array(F.lit("team:x"))).otherwise(F.array().cast("array<string>")).alias("acl_grants"), "embedding", c("next_id"),
    )
    events = tables(spark, d)
    return {
        "facts": facts.drop("next_id"), "edges": facts.where("next_id IS NOT NULL").select(c("next_id").cast("string").alias("newer"), c("fact_id").alias("older"), F.lit("SUPERSEDES").alias("type")),
        "episodes": docs.select(c("source").alias("episode_id")).distinct().select("episode_id", F.lit("NOTION").alias("system"), c("episode_id").alias("title"), none.alias("permalink")),
        **{n: events[n].limit(0) for n in ("people", "ownership", "evidence", "utterances")},
    }


SAID = "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE conv_id % 7 > 0)"
RETRIEVAL_SQL = BM25_SQL.replace("FROM documents)", "FROM documents WHERE doc_id % 5 > 0)").replace("(SELECT count(*) FROM documents)", "(SELECT count(*) FROM documents WHERE doc_id % 5 > 0)")


RETRIEVED_SQL = f"""
    WITH {RETRIEVAL_SQL},
    vs AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN benchmark ON q.vec_id = item_id JOIN embeddings v ON v.vec_id % 5 > 0 JOIN documents ON doc_id = v.vec_id),
    vectors AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS INT) AS rank FROM vs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS k FROM bm),
    pair AS (SELECT query_id, doc_id, k AS rank FROM ranked WHERE k <= 40 UNION ALL SELECT query_id, doc_id, rank FROM vectors WHERE rank <= 40),
    fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM pair GROUP BY ALL),
    v AS (SELECT doc_id, source, doc_id % 4 < 3 AND doc_id + 1 IN (SELECT doc_id FROM documents) AS closed FROM documents),
    step AS (SELECT a.doc_id AS a, b.doc_id AS b FROM v a JOIN v b ON a.doc_id // 4 = b.doc_id // 4 AND a.doc_id < b.doc_id WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.doc_id BETWEEN a.doc_id AND b.doc_id AND x.doc_id % 5 = 0)),
    ids AS (SELECT query_id, doc_id FROM fused UNION SELECT query_id, b FROM fused JOIN step ON doc_id = a JOIN v ON v.doc_id = b WHERE NOT v.closed),
    near AS (SELECT i.query_id, i.doc_id, max(f.score) AS near FROM ids i JOIN step ON step.b = i.doc_id JOIN fused f ON f.query_id = i.query_id AND f.doc_id = step.a GROUP BY ALL),
    c AS (SELECT i.query_id, i.doc_id, v.source AS title, v.closed, coalesce(f.score, n.near, 0.0) AS score FROM ids i JOIN v USING (doc_id) LEFT JOIN fused f USING (query_id, doc_id) LEFT JOIN near n USING (query_id, doc_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY score DESC, closed, doc_id DESC) AS k FROM c)
    SELECT query_id, CAST(doc_id AS VARCHAR) AS fact_id, title, score, closed, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, closed, doc_id DESC) AS INT) AS rank FROM k WHERE k <= 3 QUALIFY rank <= 8"""


@query(RETRIEVED_SQL)
def retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The whole of retrieval for every benchmark text as a question: both searches over what is readable, fused, led on to what is current,
    hydrated, ranked and kept diverse."""
    return retrieved(spark, d, document_tables(spark, d), None)


def retrieved(spark: SparkSession, d: str, t: dict[str, DataFrame], indexes: load.Indexes | None) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    asked = asked.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    found = ask.retrieve_many(t, asked, indexes=indexes)
    return found.select("query_id", "fact_id", "title", "score", F.col("valid_to").isNotNull().alias("closed"), "rank")


@query(RETRIEVED_SQL)
def indexed_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """retrieval by stored indexes of words and vectors, access tested inside: the same rows."""
    t = document_tables(spark, d)
    return retrieved(spark, d, t, load.write_indexes(t, shared_folder(spark, "indexes")))


FIRST_ASKED = f"SELECT * FROM ({RETRIEVED_SQL}) WHERE query_id = (SELECT min(item_id) FROM benchmark)"


def first_asked(spark: SparkSession, d: str) -> dict:
    """The first benchmark text as the arguments of a question."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"), "text").join(table(spark, d, "embeddings"), "vec_id", "left")
    one = asked.agg(F.min_by(F.struct("text", F.col("embedding").cast("array<double>").alias("vector")), "vec_id").alias("q")).first()["q"]
    return {"question": one["text"], "vector": F.lit(one["vector"])}


@query(f"SELECT fact_id, title, score, closed, rank FROM ({FIRST_ASKED})")
def sql_search_knowledge(spark: SparkSession, d: str) -> DataFrame:
    """retrieval of the first benchmark text in SQL text, by the table function of a reader without grants."""
    sql_tools.publish(document_tables(spark, d), prefix="docs_")
    return spark.sql("SELECT fact_id, title, score, valid_to IS NOT NULL AS closed, rank FROM docs_search_knowledge(:question, :vector, NULL, 8)", args=first_asked(spark, d))


@query(f"""
    SELECT 'n' || n_nationkey AS person_id, n_name AS name, min(rank) AS best_rank, CAST(count(*) AS INT) AS n_facts FROM ({FIRST_ASKED}) JOIN nation ON n_nationkey = CAST(fact_id AS BIGINT) % 25 WHERE CAST(fact_id AS BIGINT) % 3 > 0 GROUP BY ALL""")
def sql_find_owner(spark: SparkSession, d: str) -> DataFrame:
    """Nations as owners of two thirds of the documents: those of what the first benchmark text finds, by the table function."""
    t, number = document_tables(spark, d), F.col("fact_id").cast("long")
    people = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("person_id"), F.col("n_name").alias("name"))
    owned = t["facts"].select("fact_id", F.when(number % 3 > 0, F.concat(F.lit("n"), (number % 25).cast("string"))).alias("person_id"), F.lit("HANDLE").alias("method"))
    sql_tools.publish(t | {"people": people, "ownership": owned}, prefix="owned_")
    return spark.sql("SELECT person_id, name, best_rank, n_facts FROM owned_find_owner(:question, :vector, 8)", args=first_asked(spark, d))


@query(f"""WITH {RUNS_SQL}
    SELECT CAST(a.fact_id AS VARCHAR) AS seed, CAST(b.fact_id AS VARCHAR) AS fact_id, CAST(b.place - a.place AS INT) AS depth, b.valid_to IS NULL AS current FROM g a JOIN g b ON a.user_id = b.user_id AND a.type = b.type AND a.run = b.run AND NOT a.hidden AND NOT b.hidden AND abs(a.place - b.place) <= 10""")
def sql_trace_decision(spark: SparkSession, d: str) -> DataFrame:
    """All readable versions of every event's decision, by the table function."""
    t = tables(spark, d)
    sql_tools.publish(t | {"facts": t["facts"].withColumn("embedding", F.lit(None).cast("array<float>"))}, prefix="events_")
    return spark.sql("SELECT f.fact_id AS seed, t.fact_id, t.depth, t.valid_to IS NULL AS current FROM events_facts f, LATERAL events_trace_decision(f.fact_id) AS t")


SAID_SQL = BM25_SQL.replace("FROM documents)", f"FROM {SAID})").replace("FROM documents", f"FROM {SAID}")


@query(f"WITH {SAID_SQL} SELECT query_id, doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, score, rank FROM words WHERE rank <= 8")
def utterance_search(spark: SparkSession, d: str) -> DataFrame:
    """The eight turns of readable conversations that best fit each benchmark text, from a stored index of all turns."""
    turns, c = table(spark, d, "conversations"), F.col
    key = lambda n: F.lpad(n.cast("string"), 9, "0")
    grants = F.when(c("conv_id") % 7 == 0, F.array(F.lit("team:x"))).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    # Ids as strings of one length sort as their numbers do.
    said = turns.where("conv_id IS NOT NULL").select(key(c("conv_id")).alias("episode_id"), c("turn").cast("int").alias("ordinal"), F.lit("x").alias("speaker"), F.lit(HELD).cast("timestamp").alias("at"), "text", none.alias("permalink"), "conv_id", "turn")
    words = text_index.build(said.withColumn("utterance_key", F.concat("episode_id", F.lit("#"), key(c("ordinal")))).select("utterance_key", "text"), shared_folder(spark, "utterances"), "utterance_key", "text")
    open_ = said.where(readable(grants, [])).select(F.concat("episode_id", F.lit("#"), key(c("ordinal"))).alias("utterance_key"), "conv_id", "turn").distinct()
    asked = table(spark, d, "benchmark").select(c("item_id").alias("query_id"), c("text").alias("question"))
    found = search.bm25_top(None, asked, 8, "utterance_key", "text", words, open_.select("utterance_key"))
    return found.join(open_, "utterance_key").select("query_id", "conv_id", "turn", "score", "rank")


#: Tasks for each core that answers are dealt to.
ANSWERED = 4


@query("""
    SELECT event_id, CASE event_type WHEN 'purchase' THEN 'DECISION' WHEN 'click' THEN 'ACTION_ITEM' WHEN 'signup' THEN 'COMMITMENT' WHEN 'error' THEN 'RISK' ELSE 'OPEN_QUESTION' END AS type, CASE WHEN event_id % 11 > 0 THEN 'made of ' || event_id END AS statement, 'Owner ' || user_id AS owner,
        CASE event_id % 3 WHEN 0 THEN 'AGREED' WHEN 1 THEN 'PROPOSED' ELSE 'DONE' END AS status, CASE WHEN event_id % 2 = 0 THEN '2024-03-01' ELSE strftime(ts, '%Y-%m-%d') END AS day, CASE WHEN event_id % 5 = 0 THEN DATE '2024-04-05' END AS due, CAST(1 AS INT) AS n_quotes
    FROM events WHERE event_id % 13 > 0""")
def payload_facts(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model, fenced or not, with facts of unknown type, odd states, blank statements and quotes of nothing; every 13th can't be read."""
    c = F.col
    kind = F.create_map(*[F.lit(x) for pair in FACT_TYPES.items() for x in pair])[c("event_type")]
    quote = lambda n, q: F.struct(F.lit(n).alias("utterance"), F.lit(q).alias("quote"))
    fact = F.struct(
        F.lower(kind).alias("type"), F.when(c("event_id") % 11 > 0, F.concat(F.lit(" made of "), c("event_id").cast("string"))).otherwise(" ").alias("statement"), F.concat(F.lit(" Owner "), c("user_id").cast("string"), F.lit(",")).alias("owner"),
        F.element_at(F.array(F.lit("agreed"), F.lit("unheard of"), F.lit(" Done ")), (c("event_id") % 3 + 1).cast("int")).alias("status"), F.when(c("event_id") % 2 == 0, "2024-03-01T12:00:00Z").otherwise("soon").alias("occurredAt"),
        F.when(c("event_id") % 5 == 0, "2024-04-05 or so").otherwise("2024-02-30").alias("dueDate"), F.array(quote(3, "said so"), quote(-1, "nowhere"), quote(4, " ")).alias("evidence"),
    )
    other = fact.withField("type", F.lit("rumour"))
    said = F.to_json(F.struct(F.array(fact, other).alias("facts")))
    answer = F.when(c("event_id") % 13 == 0, "I don't know.").when(c("event_id") % 2 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said)
    # Events are small in bytes and their answers take long to parse, so they are dealt to all cores before they are made answers.
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type").repartition(ANSWERED * spark.sparkContext.defaultParallelism, "event_id")
    answers = events.select(c("event_id").cast("string").alias("episode_id"), c("ts").cast("timestamp").alias("occurred_at"), answer.alias("answer"))
    got = models.payload_facts(answers)
    return got.select(c("episode_id").cast("long").alias("event_id"), "type", "statement", c("owner_mention").alias("owner"), "status", dates.day(c("occurred_at")).alias("day"), c("due_date").alias("due"), F.size("evidence").alias("n_quotes"))


@query("""
    WITH t AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM conversations), e AS (SELECT conv_id, count(*) FILTER (WHERE turn = 0 AND length(plain) >= 12) AS ok, count(*) FILTER (WHERE turn = 0 AND length(plain) < 12) AS bad FROM t GROUP BY conv_id)
    SELECT count(*) AS episodes, CAST(sum(ok) AS BIGINT) AS accepted, CAST(sum(bad) + count(*) AS BIGINT) AS rejected, sum(ok) / (sum(ok) + sum(bad) + count(*))::DOUBLE AS acceptance_rate,
        7 * count(*) AS input_tokens, 3 * count(*) AS output_tokens, count(*) AS timed FROM e""")
def extraction_totals(spark: SparkSession, d: str) -> DataFrame:
    """The whole extraction over conversations: rendered, asked, read, repaired, checked and written. The model quotes the first utterance at a
    wrong place, makes one quote up, and tells what each call cost."""
    turns = table(spark, d, "conversations")
    episodes = turns.select(F.col("conv_id").cast("string").alias("episode_id")).distinct().select("episode_id", F.lit("t").alias("title"), F.lit("X").alias("kind"), F.lit(HELD).cast("timestamp").alias("occurred_at"))
    said = turns.select(F.col("conv_id").cast("string").alias("episode_id"), F.col("turn").cast("int").alias("ordinal"), F.lit("x").alias("speaker"), F.lit(HELD).cast("timestamp").alias("at"), "text")

    def chat(prompts: list[str]) -> list[dict]:
        import json
        import re

        out = []
        for p in prompts:
            first = re.search(r"\[0\] x \([^)]*\): (.*?)(?:\n\[1\] x \(|\n?\Z)", p, re.S)
            fact = {"type": "DECISION", "statement": "what was said first", "status": "AGREED", "confidence": 0.9}
            quotes = [[first.group(1) if first else ""], ["words that nobody ever said"]]
            answer = json.dumps({"facts": [fact | {"evidence": [{"utterance": 77, "quote": q} for q in own]} for own in quotes]})
            out.append({"answer": answer, "input_tokens": 7, "output_tokens": 3})
        return out

    results = extract.run(episodes, said, chat)
    folder = shared_folder(spark, "extraction")
    got = stats.run_totals(extract.stored(results, folder))
    return got.select("episodes", "accepted", "rejected", "acceptance_rate", "input_tokens", "output_tokens", "timed")


@query("""SELECT l_orderkey, l_linenumber, 'slack:' || l_orderkey AS source, 'SLACK:' || l_partkey AS alias, 'slack:' || l_orderkey || '#' || l_linenumber AS utterance FROM lineitem""")
def key_forms(spark: SparkSession, d: str) -> DataFrame:
    """The forms of keys: of a source, of an alias, of an utterance."""
    source = ids.source_key(F.lit("SLACK"), F.col("l_orderkey").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", source.alias("source"), ids.alias_key(F.lit("SLACK"), F.col("l_partkey").cast("string")).alias("alias"), ids.utterance_id(source, F.col("l_linenumber")).alias("utterance"))


@query("""
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '2024-01-02 00:00:00' WHEN 1 THEN '2024-01-02 10:30:00' WHEN 5 THEN '2024-01-02 00:00:00' END AS instant, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 5) THEN DATE '2024-01-02' END AS day FROM orders""")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates and instants in the forms that sources have: a day, an instant, a day with words after it, a day that is none, words, a day in blanks."""
    forms = F.array(*[F.lit(x) for x in ("2024-01-02", "2024-01-02T10:30:00Z", "2024-01-02T99", "2024-02-30", "soon", " 2024-01-02 ")])
    form = F.element_at(forms, (F.col("o_orderkey") % 6 + 1).cast("int"))
    instant = F.when(F.col("o_orderkey") % 6 == 2, None).otherwise(dates.instant_of(form))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(instant, "yyyy-MM-dd HH:mm:ss").alias("instant"), dates.date_of(form).alias("day"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS name, CASE p_partkey % 5 WHEN 0 THEN 'Decision' WHEN 1 THEN 'ActionItem' WHEN 2 THEN 'Commitment' WHEN 3 THEN 'Risk' ELSE 'OpenQuestion' END AS label,
        CASE p_partkey % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bob Ray' WHEN 2 THEN 'Ann Lee' END AS answered FROM part""")
def small_forms(spark: SparkSession, d: str) -> DataFrame:
    """Blank names made null, types as labels, and answers as one of the names that were given."""
    c = F.col
    kinds = F.array(*[F.lit(t) for t in ("DECISION", "ACTION_ITEM", "COMMITMENT", "RISK", "OPEN_QUESTION")])
    given = F.array(F.lit("Bob Ray"), F.lit("Ann Lee"))
    said = F.element_at(F.array(F.lit("ann lee — she said so"), F.lit("Bob"), F.lit("Ann Lee, as it seems - sure"), F.lit("nobody")), (c("p_partkey") % 4 + 1).cast("int"))
    said = F.when(c("p_partkey") % 4 == 2, F.lit("Ann Lee-- sure")).otherwise(said)
    name = F.when(c("p_partkey") % 3 > 0, F.concat(F.lit(" "), "p_name", F.lit("\t"))).otherwise(" \n")
    return table(spark, d, "part").select("p_partkey", text.blank_to_null(name).alias("name"), text.label_of(F.element_at(kinds, (c("p_partkey") % 5 + 1).cast("int"))).alias("label"), text.match_name(said, given).alias("answered"))


def nations(spark: SparkSession, d: str) -> directory.Directory:
    """Nations as people, present in the episode of their region."""
    rows, c, none = table(spark, d, "nation"), F.col, F.lit(None).cast("string")
    person = F.concat(F.lit("n"), c("n_nationkey").cast("string"))
    people = rows.select(person.alias("person_id"), c("n_name").alias("name"), F.concat(person, F.lit("@X.test")).alias("email"), none.alias("title"), F.array().cast("array<string>").alias("aliases"))
    return directory.Directory(people, rows.select(F.lit("SLACK").alias("system"), person.alias("value"), person.alias("person_id")), rows.select(c("n_regionkey").cast("string").alias("episode_id"), person.alias("person_id")), people.limit(0))


@query("""
    SELECT CAST(n_regionkey AS VARCHAR) AS episode_id, 'label ' || n_nationkey AS label, CASE WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey WHEN n_nationkey % 3 = 1 THEN 'n' || first END AS person_id,
        CASE n_nationkey % 3 WHEN 0 THEN 'HANDLE' WHEN 1 THEN 'LLM_ADJUDICATED' ELSE 'UNRESOLVED' END AS method
    FROM nation JOIN (SELECT n_regionkey, arg_min(n_nationkey, n_name) AS first FROM nation GROUP BY 1) USING (n_regionkey)""")
def adjudicated_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Every third speaker has a handle; of the others a model names the first who is present, or somebody who is not there."""
    who = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("episode_id"), F.lit("SLACK").alias("system"), F.concat(F.when(F.col("n_nationkey") % 3 == 0, "n").otherwise("u"), F.col("n_nationkey").cast("string")).alias("raw_id"), F.concat(F.lit("label "), F.col("n_nationkey").cast("string")).alias("speaker"))
    number = F.regexp_extract("raw_id", r"\d+", 0).cast("int")
    chosen = lambda asked: asked.withColumn("answer", F.when(number % 3 == 1, F.lower(F.col("candidates")[0])).otherwise("somebody else"))
    return resolve.speakers(who, nations(spark, d), chosen).select("episode_id", "label", "person_id", "method")


@query("""
    WITH w AS (SELECT event_type, user_id, CASE event_id % 3 WHEN 0 THEN 'SLACK' WHEN 1 THEN 'NOTION' ELSE 'ZOOM' END AS system FROM events)
    SELECT system, 'u' || user_id AS raw_id, 'label ' || user_id AS label, count(DISTINCT event_type) AS n_episodes FROM w WHERE system <> 'ZOOM' AND (user_id % 4 = 0 OR system = 'NOTION' AND user_id % 4 = 1) GROUP BY ALL""")
def missing_handles(spark: SparkSession, d: str) -> DataFrame:
    """Handles that the directory lacks: every fourth user has no alias at all, the next ones have one in one source only."""
    c, none = F.col, F.lit(None).cast("string")
    events = table(spark, d, "events").select("event_id", "event_type", "user_id")
    system = F.element_at(F.array(F.lit("SLACK"), F.lit("NOTION"), F.lit("ZOOM")), (c("event_id") % 3 + 1).cast("int"))
    name = lambda head: F.concat(F.lit(head), c("user_id").cast("string"))
    who = events.select(c("event_type").alias("episode_id"), system.alias("system"), name("u").alias("raw_id"), name("label ").alias("speaker"))
    users = events.select("user_id").distinct().where("user_id % 4 > 0")
    people = users.select(name("p").alias("person_id"), name("Name ").alias("name"), none.alias("email"), none.alias("title"), F.array().cast("array<string>").alias("aliases"))
    sources = F.when(c("user_id") % 4 == 1, F.array(F.lit("SLACK"))).otherwise(F.array(F.lit("SLACK"), F.lit("NOTION")))
    aliases = users.select(F.explode(sources).alias("system"), name("u").alias("value"), name("p").alias("person_id"))
    present = people.select(F.lit("none").alias("episode_id"), "person_id").limit(0)
    return resolve.missing_handles(resolve.speakers(who, directory.Directory(people, aliases, present, people.limit(0))))


@query("""
    SELECT 'prefix' AS asked, 'n' || n_nationkey AS person_id FROM nation WHERE starts_with(regexp_replace(lower(n_name), '[^a-z0-9 ]', '', 'g'), 'i') UNION ALL SELECT 'email', 'n' || n_nationkey FROM nation WHERE n_nationkey = 3
    UNION ALL SELECT 'alias', 'n' || n_nationkey FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'episode', 'n' || n_nationkey FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'name', 'n' || n_nationkey FROM nation WHERE lower(n_name) = (SELECT min(lower(n_name)) FROM nation)""")
def directory_lookups(spark: SparkSession, d: str) -> DataFrame:
    """People by the beginning of a name, an e-mail, an alias, an episode and a name."""
    people = nations(spark, d)
    first = people.people.agg(F.min(F.lower("name"))).first()[0]
    found = {"prefix": people.by_name_prefix("I"), "email": people.by_email("N3@x.TEST"), "alias": people.by_alias("SLACK", "n4"), "episode": people.participants_of("2"), "name": people.by_name(first)}
    frames = [df.select(F.lit(k).alias("asked"), "person_id") for k, df in found.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("""
    WITH a AS (SELECT n_name AS name, 'r' || n_nationkey % 2 AS person FROM nation)
    SELECT a.name AS first, b.name AS second, a.person AS person_id FROM a JOIN a AS b ON b.name = (SELECT min(c.name) FROM a AS c WHERE c.name > a.name) AND a.person = b.person""")
def fused_names(spark: SparkSession, d: str) -> DataFrame:
    """Nations that stand next to each other by name are stated not to be one; those of even numbers were made one, and those of odd ones."""
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("r"), (F.col("n_nationkey") % 2).cast("string")).alias("person_id"))
    pairs = rows.select(F.array("name", F.lead("name").over(Window.orderBy("name"))).alias("pair"), F.lit("x").alias("why")).where("pair[1] IS NOT NULL")
    return resolve.fused_people(rows, pairs).select(F.col("pair")[0].alias("first"), F.col("pair")[1].alias("second"), "person_id")


@query("""SELECT event_type AS key, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS from_us, count(*) AS n FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events counted by type and hour as a stream."""
    folder = shared_folder(spark, "windows")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    rows = source.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    counted = stream_versions.windowed_counts(rows, "at", "key", "1 hour", "1 day").select("key", F.unix_micros("window.start").alias("from_us"), "n")
    keep = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")
    counted.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, from_us long, n long").parquet(f"{folder}/out")
