"""Search, graph, scoring, export and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolore.catalog import VERSIONS_SQL, Catalog, event_facts, table
from chronolore.functions.text import citations, salient_terms, term_coverage
from chronolore.lineage import shared_folder
from chronolore.operators import graph, scoring, search, stats, vector_index
from chronolore.operators.acl import readable

query = Catalog()


@query(r"""
    WITH t AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)
    SELECT term, count(*) AS df FROM t WHERE term <> '' GROUP BY term""")
def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return search.document_frequencies(table(spark, d, "documents"), "doc_id", "text")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


BM25_SQL = r"""
    stop AS (SELECT unnest(['the','and','for','did','does','was','are','who','what','when','where','why','how','our','with','that','this','has','have','any','still','there','yet','about']) AS w),
    ask AS (SELECT DISTINCT item_id AS query_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark),
    q AS (SELECT * FROM ask WHERE length(term) > 2 AND term NOT IN (SELECT w FROM stop)),
    tok AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) WHERE term <> ''),
    len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id),
    n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(length) FROM len) / (SELECT count(*) FROM documents)::DOUBLE AS avg_length),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    bm AS (
        SELECT query_id, doc_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length)))), 6) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), n GROUP BY ALL),
    words AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM bm)"""


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM words WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents for each benchmark text as a question."""
    return search.bm25_top(table(spark, d, "documents").select("doc_id", "text"), asked(spark, d), 10, "doc_id", "text").select("query_id", "doc_id", "score", "rank")


@query("""
    WITH s AS (
        SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every vector."""
    rows = table(spark, d, "embeddings")
    return search.vector_top_all(rows, rows, 10, "vec_id").select("query_id", "vec_id", "score", "rank")


@query("""
    WITH s AS (
        SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND v.vec_id % 5 > 0 AND v.label <> 3
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""")
def indexed_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest readable vectors of every vector from a stored index: every fifth vector and those of one label are hidden, which the search tests inside."""
    rows = table(spark, d, "embeddings").withColumn("acl_grants", F.when(F.col("vec_id") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    index = vector_index.build(rows, shared_folder(spark, "vectors"), "vec_id")
    return vector_index.search(index, rows, 10, allowed=readable(F.col("acl_grants"), []) & (F.col("label") != 3)).select("query_id", "vec_id", "score", "rank")


VECTOR_SEED_SQL = """
    vs AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN benchmark ON q.vec_id = item_id JOIN embeddings v ON q.vec_id <> v.vec_id),
    vectors AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM vs)"""
FUSED_SQL = f"""{BM25_SQL}, {VECTOR_SEED_SQL},
    pair AS (SELECT query_id, doc_id, rank FROM words WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, rank FROM vectors WHERE rank <= 40),
    fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM pair GROUP BY ALL)"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    rows, words = table(spark, d, "embeddings"), search.bm25_top(table(spark, d, "documents").select("doc_id", "text"), asked(spark, d), search.SEEDS, "doc_id", "text")
    items = rows.join(asked(spark, d).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    near = search.vector_top_all(rows, items, search.SEEDS, "vec_id").withColumnRenamed("vec_id", "doc_id")
    return search.fuse(words.select("query_id", "doc_id", "rank").unionByName(near.select("query_id", "doc_id", "rank")), ["query_id"], "doc_id")


@query(f"WITH {FUSED_SQL} SELECT query_id, doc_id, score FROM fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d)


@query(f"""
    WITH {FUSED_SQL}, f AS (
        SELECT query_id, doc_id, score, source AS title FROM fused JOIN documents USING (doc_id)
    ), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(title, '?') ORDER BY score DESC, doc_id) AS k FROM f)
    SELECT query_id, doc_id, score, title, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM c WHERE k <= 3 QUALIFY rank <= 8""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: both strategies, fused, put in order and kept diverse, for each benchmark text as a question."""
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.col("source").alias("title"))
    facts = fused(spark, d).join(docs, "doc_id").select("query_id", F.col("doc_id").alias("fact_id"), "score", F.lit(None).cast("timestamp").alias("valid_to"), F.lit("2024-01-01").cast("timestamp").alias("occurred_at"), "title")
    return search.rerank(facts, ["query_id"]).select("query_id", F.col("fact_id").alias("doc_id"), "score", "title", "rank")


@query(f"""
    WITH {VERSIONS_SQL}, r AS (
        SELECT user_id, fact_id, type, value AS score, valid_to, occurred_at, row_number() OVER (PARTITION BY user_id, type ORDER BY value DESC, valid_to IS NULL DESC, occurred_at DESC, fact_id) AS k FROM v)
    SELECT user_id, fact_id, type, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, valid_to IS NULL DESC, occurred_at DESC, fact_id) AS INT) AS rank FROM r WHERE k <= 3 QUALIFY rank <= 8""")
def rerank_diverse(spark: SparkSession, d: str) -> DataFrame:
    """The eight best facts of each user, three of a type at most."""
    from chronolore.catalog.facts import versions

    rows = versions(spark, d).select("user_id", "fact_id", F.col("value").alias("score"), "valid_to", "occurred_at", F.col("type").alias("title"))
    return search.rerank(rows, ["user_id"]).select("user_id", "fact_id", F.col("title").alias("type"), "score", "rank")


def supersedes(spark: SparkSession, d: str) -> DataFrame:
    """Each event replaces the one before it of its user and type."""
    order = Window.partitionBy("user_id", "type").orderBy("occurred_at", "fact_id")
    return event_facts(table(spark, d, "events")).select(F.col("fact_id").alias("src"), F.lag("fact_id").over(order).alias("dst")).where("dst IS NOT NULL")


def allowed(spark: SparkSession, d: str) -> DataFrame:
    return event_facts(table(spark, d, "events")).where(readable(F.col("acl_grants"), [])).select(F.col("fact_id").alias("node"))


# Readable facts in a row without a hidden one between them are one run; walks stay within it.
RUNS_SQL = f"""{VERSIONS_SQL}, g AS (SELECT *, sum(CASE WHEN hidden THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, type ORDER BY place) AS run FROM v)"""


@query(f"""WITH {RUNS_SQL}
    SELECT a.fact_id AS seed, b.fact_id AS node, CAST(b.place - a.place AS INT) AS depth FROM g a JOIN g b ON a.user_id = b.user_id AND a.type = b.type AND a.run = b.run AND NOT a.hidden AND NOT b.hidden AND abs(a.place - b.place) <= 10""")
def chain_trace(spark: SparkSession, d: str) -> DataFrame:
    """All readable versions of the decision of every event; negative depth is older."""
    return graph.all_chains(supersedes(spark, d), allowed(spark, d))


@query(f"""WITH {RUNS_SQL}
    SELECT a.fact_id AS seed, b.fact_id AS node, CAST(a.place - b.place AS INT) AS depth FROM g a JOIN g b ON a.user_id = b.user_id AND a.type = b.type AND a.run = b.run AND NOT a.hidden AND NOT b.hidden AND a.place - b.place BETWEEN 1 AND 5""")
def history_depth(spark: SparkSession, d: str) -> DataFrame:
    """What each readable fact replaced, up to five steps back."""
    return graph.closure(supersedes(spark, d), graph.CURRENCY_HOPS, allowed(spark, d)).select(F.col("src").alias("seed"), F.col("dst").alias("node"), "depth")


@query(f"""WITH {RUNS_SQL}
    SELECT fact_id AS seed, fact_id FROM g UNION
    SELECT a.fact_id, b.fact_id FROM g a JOIN g b ON a.user_id = b.user_id AND a.type = b.type AND a.run = b.run AND NOT a.hidden AND NOT b.hidden AND b.valid_to IS NULL AND b.place - a.place BETWEEN 1 AND 5""")
def currency_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every fact with the current facts it leads to, itself among them."""
    from chronolore.catalog.facts import versions

    facts = versions(spark, d)
    return graph.currency_by_seed(supersedes(spark, d), facts.select(F.col("fact_id").alias("seed")), facts, [])


@query(f"""WITH {VERSIONS_SQL}, t AS (SELECT user_id, type, least(count(*) - 1, 10) AS length, max_by(fact_id, place) AS head FROM v GROUP BY ALL HAVING count(*) > 1)
    SELECT head, CAST(length AS INT) AS length FROM t ORDER BY length DESC, head LIMIT 5""")
def longest_chains(spark: SparkSession, d: str) -> DataFrame:
    return graph.longest_chains(supersedes(spark, d)).select("head", F.col("length").cast("int").alias("length"))


@query("""
    WITH r AS (SELECT event_id, user_id, value, CAST(row_number() OVER (ORDER BY value DESC, event_id) AS INT) AS rank FROM events),
    s AS (SELECT r.*, e.event_type, e.event_id % 5 = 0 AS hidden FROM r JOIN events e USING (event_id))
    SELECT c_custkey AS person_id, c_name AS name, min(rank) AS best_rank, CAST(count(*) AS INT) AS n_facts, string_agg(DISTINCT CASE WHEN event_id % 2 = 0 THEN 'HANDLE' ELSE 'EMAIL' END, ',' ORDER BY CASE WHEN event_id % 2 = 0 THEN 'HANDLE' ELSE 'EMAIL' END) AS methods
    FROM s JOIN customer ON c_custkey = user_id WHERE NOT hidden GROUP BY ALL""")
def owner_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Customers as owners of all events, ranked by value."""
    facts = event_facts(table(spark, d, "events")).withColumn("valid_to", F.lit(None).cast("timestamp"))
    ranked = search.global_rank(facts.select("fact_id", "value"), [F.desc("value"), F.col("fact_id")])
    owned = facts.select("fact_id", F.col("user_id").alias("person_id"), F.when(F.col("fact_id") % 2 == 0, "HANDLE").otherwise("EMAIL").alias("method"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("email"))
    found = graph.owners(facts, owned, people, ranked.select("fact_id", "rank"), [])
    return found.select("person_id", "name", "best_rank", "n_facts", F.array_join("methods", ",").alias("methods"))


@query("""SELECT count(*) AS unowned FROM events LEFT JOIN customer ON c_custkey = user_id * 20 WHERE c_custkey IS NULL""")
def unowned_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = event_facts(table(spark, d, "events"))
    owned = facts.join(table(spark, d, "customer"), F.col("user_id") * 20 == F.col("c_custkey")).select("fact_id")
    return graph.unowned(facts, owned).agg(F.count(F.lit(1)).alias("unowned"))


def places(spark: SparkSession, d: str) -> graph.Graph:
    """Regions, nations, customers and suppliers; regions 1 and 3 need a grant."""
    none, c = F.lit(None).cast("array<string>"), F.col
    node = lambda t, kind, key, label, acl=none: table(spark, d, t).select(F.concat(F.lit(f"{kind}:"), c(key).cast("string")).alias("node"), F.lit(kind).alias("kind"), c(label).alias("label"), acl.alias("acl_grants"))
    closed = F.when(c("r_regionkey").isin(1, 3), F.array(F.lit("region"))).otherwise(F.array().cast("array<string>"))
    nodes = node("region", "Region", "r_regionkey", "r_name", closed).unionByName(node("nation", "Nation", "n_nationkey", "n_name")).unionByName(node("customer", "Customer", "c_custkey", "c_name")).unionByName(node("supplier", "Supplier", "s_suppkey", "s_name"))
    edge = lambda t, a, ka, b, kb, kind: table(spark, d, t).select(F.concat(F.lit(f"{a}:"), c(ka).cast("string")).alias("src"), F.concat(F.lit(f"{b}:"), c(kb).cast("string")).alias("dst"), F.lit(kind).alias("type"))
    edges = edge("nation", "Nation", "n_nationkey", "Region", "n_regionkey", "DERIVED_FROM").unionByName(edge("customer", "Customer", "c_custkey", "Nation", "c_nationkey", "ABOUT")).unionByName(edge("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", "ABOUT"))
    return graph.Graph(nodes, edges)


@query("""
    WITH RECURSIVE ends AS (
        SELECT (SELECT min(c_custkey) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0) AS c, (SELECT max(s_suppkey) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 0) AS s
    ), e AS (
        SELECT 'Nation:' || n_nationkey AS a, 'Region:' || n_regionkey AS b, 'DERIVED_FROM' AS t FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'ABOUT' FROM customer UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'ABOUT' FROM supplier
    ), u AS (SELECT a, b, t, true AS fwd FROM e UNION ALL SELECT b, a, t, false FROM e), ok AS (SELECT * FROM u WHERE a NOT IN ('Region:1', 'Region:3') AND b NOT IN ('Region:1', 'Region:3') AND (b NOT LIKE '%:%' OR b LIKE 'Nation%' OR b LIKE 'Region%' OR b = (SELECT 'Supplier:' || s FROM ends))),
    p AS (
        SELECT 'Customer:' || c AS stop, ['Customer:' || c] AS nodes, 0 AS hops FROM ends
        UNION ALL SELECT ok.b, list_append(p.nodes, ok.b), hops + 1 FROM p JOIN ok ON ok.a = p.stop WHERE hops < 6 AND NOT list_contains(p.nodes, ok.b)
    ), f AS (SELECT * FROM p WHERE stop = (SELECT 'Supplier:' || s FROM ends))
    SELECT CAST(row_number() OVER (ORDER BY nodes) AS INT) AS path_no, CAST(hops AS INT) AS hops, array_to_string(nodes, '|') AS nodes FROM f WHERE hops = (SELECT min(hops) FROM f) QUALIFY path_no <= 3""")
def path_between(spark: SparkSession, d: str) -> DataFrame:
    """Between the first customer and the last supplier of region 0."""
    of = table(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey")
    first = table(spark, d, "customer").join(of, F.col("c_nationkey") == F.col("n_nationkey")).agg(F.min("c_custkey")).first()[0]
    last = table(spark, d, "supplier").join(of, F.col("s_nationkey") == F.col("n_nationkey")).agg(F.max("s_suppkey")).first()[0]
    found = graph.shortest_paths(places(spark, d), f"Customer:{first}", f"Supplier:{last}", [])
    return found.select("path_no", "hops", F.array_join("nodes", "|").alias("nodes"))


@query("""SELECT 'Customer:' || c_custkey AS node, 'Customer' AS kind, c_name AS label FROM customer WHERE c_name = 'Customer#000000007'""")
def entity_resolve_exact(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_entity(places(spark, d), spark.createDataFrame([], "person_id string, value string"), "customer#000000007 ", [])


@query("""
    WITH n AS (SELECT 'Nation:' || n_nationkey AS node, 'Nation' AS kind, n_name AS label FROM nation UNION ALL SELECT 'Region:' || r_regionkey, 'Region', r_name FROM region WHERE r_regionkey NOT IN (1, 3)
        UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name FROM supplier)
    SELECT node, kind, label FROM n WHERE contains(lower(label), '_1') OR contains(lower(node), '_1') ORDER BY kind, label, node LIMIT 10""")
def entity_resolve_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_entity(places(spark, d), spark.createDataFrame([], "person_id string, value string"), "_1", [])


@query("""
    WITH m AS (
        SELECT g.vec_id AS gold_id, g.label AS gold_type, f.vec_id AS found, f.label + (f.vec_id % 2) AS type, round(list_cosine_similarity(g.embedding::DOUBLE[], list_reverse(f.embedding)::DOUBLE[]), 9) AS similarity
        FROM embeddings g JOIN embeddings f ON f.label IN (g.label, (g.label + 1) % 10)
    ), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gold_id ORDER BY similarity DESC, (SELECT 0), found) AS k FROM m WHERE similarity >= 0.3) WHERE k = 1)
    SELECT CAST(g.label AS VARCHAR) AS type, count(*) AS gold, count(*) FILTER (WHERE b.type = g.label) AS matched, count(*) FILTER (WHERE b.type <> g.label) AS mistyped, count(*) FILTER (WHERE b.type = g.label) / count(*)::DOUBLE AS recall
    FROM embeddings g LEFT JOIN b ON b.gold_id = g.vec_id GROUP BY g.label""")
def extraction_recall(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a gold fact, to be found among the vectors, read backwards, in the episodes of its label and the next."""
    rows = table(spark, d, "embeddings")
    text = lambda c: c.cast("string")
    gold = rows.select(text(F.col("vec_id")).alias("id"), text(F.col("label")).alias("type"), F.array(text(F.col("label")), text((F.col("label") + 1) % 10)).alias("sources"), "embedding")
    found = rows.select(text(F.col("label")).alias("episode_id"), text(F.col("label") + F.col("vec_id") % 2).alias("type"), F.col("vec_id").alias("seq"), F.reverse("embedding").alias("embedding"), text(F.col("vec_id")).alias("statement"))
    return scoring.recall_by_type(gold, scoring.best_matches(gold, found, 0.3))


@query("""
    WITH b AS (SELECT conv_id, turn, text, conv_id % 5 = 0 AS refused, turn % 3 AS k FROM conversations)
    SELECT CASE WHEN k = 1 AND contains(lower(text), 'qu') THEN 'FORBIDDEN' WHEN k = 2 AND conv_id % 2 = 0 THEN CASE WHEN refused THEN 'PASS' ELSE 'FORBIDDEN' END WHEN refused THEN 'MISSED'
        WHEN conv_id % 3 > 0 THEN 'MISSED' WHEN turn % 2 = 0 THEN 'UNSUPPORTED' ELSE 'PASS' END AS verdict, count(*) AS n FROM b GROUP BY 1""")
def verdict_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Turns as answers: some refused, some with a forbidden phrase, some off target, half of them cited."""
    turns, c = table(spark, d, "conversations"), F.col
    none = F.array().cast("array<string>")
    rows = turns.select(
        F.concat_ws("/", "conv_id", "turn").alias("id"), F.lit("?").alias("question"), none.alias("principal"), F.lit("").alias("expected"),
        F.when((c("turn") % 3 == 2) & (c("conv_id") % 2 == 0), none).otherwise(F.array(F.lit("F1"))).alias("expected_facts"), F.when(c("turn") % 3 == 1, F.array(F.lit("QU"))).otherwise(none).alias("must_not_say"), none.alias("must_not_lead_with"),
    )
    cited = F.when(c("turn") % 2 == 1, F.concat(c("text"), F.lit(" [1]"))).otherwise(F.regexp_replace("text", r"\[\d+\]", ""))
    answers = turns.select(F.concat_ws("/", "conv_id", "turn").alias("id"), cited.alias("answer"), (c("conv_id") % 5 == 0).alias("refused"), F.lit(3).alias("n_cards"), F.when(c("conv_id") % 3 == 0, 0.62).otherwise(0.61).alias("similarity"))
    return scoring.verdict_histogram(scoring.grade(rows, answers))


@query(r"""
    WITH p AS (SELECT a.conv_id, a.turn, a.text AS expected, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    t AS (SELECT conv_id, turn, expected, answer, list_distinct(list_filter(string_split_regex(expected, '[^\p{L}\p{N}/]+'), lambda x: regexp_matches(x, '\p{Nd}') OR (length(x) > 3 AND regexp_matches(x, '^\p{Lu}')))) AS terms FROM p)
    SELECT conv_id, turn, CAST(len(terms) AS INT) AS n_terms FROM t""")
def salient_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Salient terms of each turn that has an answer."""
    turns = table(spark, d, "conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.size(salient_terms(F.col("text"))).alias("n_terms"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0.0 END AS coverage FROM orders""")
def answer_term_coverage(spark: SparkSession, d: str) -> DataFrame:
    """An order's number and date as expected answer: said whole, with another number, or not at all."""
    key = F.concat(F.lit("N"), F.col("o_orderkey").cast("string"))
    wanted = F.concat(F.lit("It is "), key, F.lit(" by Monday."))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("so "), F.lower(key), F.lit(", on MONDAY"))).when(F.col("o_orderkey") % 3 == 1, F.concat(key, F.lit("5 by Monday"))).otherwise("nothing")
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), term_coverage(said, wanted).alias("coverage"))


@query("""SELECT o_orderkey, o_orderkey % 9 || ',' || (o_orderkey % 9 + 1) AS cited FROM orders""")
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") % 9
    said = F.format_string("Yes [%d], and [%d], again [%d]; not [x].", n, n + 1, n)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(citations(said), lambda x: x.cast("string")), ",").alias("cited"))


@query("""SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY event_type""")
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(table(spark, d, "events"), "event_type")


@query("""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, n, min(value) FILTER (WHERE k = ceil(0.5 * n)) AS p50, min(value) FILTER (WHERE k = ceil(0.95 * n)) AS p95, min(value) FILTER (WHERE k = ceil(0.99 * n)) AS p99 FROM r GROUP BY ALL""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of event values by type."""
    return stats.percentiles(table(spark, d, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])


@query("""
    SELECT event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, true AS p50_near, true AS p95_near, true AS p99_near, true AS users_near FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def sketched_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of event values by type from sketches of each day, stored and merged: their number of rows and days, and whether each percentile's rank is within 1.7 %
    of the rows of latency_percentiles, and the number of different users within 5 % of the true one."""
    events, c, shares = table(spark, d, "events"), F.col, [0.5, 0.95, 0.99]
    folder = shared_folder(spark, "sketches")
    stats.daily_sketches(events, ["event_type"], "ts", "value", "user_id").write.parquet(folder)
    days = spark.read.parquet(folder)
    got = stats.from_sketches(days, ["event_type"], shares).join(days.groupBy("event_type").agg(F.count_distinct("day").alias("days")), "event_type")
    names = [f"p{round(100 * s)}" for s in shares]
    ranks = [f(c("value"), c(p)).alias(f"{p}_{side}") for p in names for side, f in (("below", lambda v, q: F.count_if(v < q)), ("upto", lambda v, q: F.count_if(v <= q)))]
    true = events.join(got.select("event_type", *names), "event_type").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), *ranks)
    near = [((c(f"{p}_below") <= (s + 0.017) * c("n")) & (c(f"{p}_upto") >= (s - 0.017) * c("n"))).alias(f"{p}_near") for p, s in zip(names, shares, strict=True)]
    return got.join(true, "event_type").select("event_type", "n", "days", *near, (F.abs(c("members") - c("users")) <= 0.05 * c("users")).alias("users_near"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) AS seconds,
    CASE WHEN max(value) > 0 THEN count(*) FILTER (WHERE event_type <> 'error') / max(value) ELSE 0 END AS per_second FROM events GROUP BY user_id""")
def request_throughput(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return stats.throughput(events, ["user_id"], "ok", "value")


@query("""SELECT count(*) AS n, count(DISTINCT props) AS different, (count(*) - count(DISTINCT props)) / count(*)::DOUBLE AS hit_rate FROM events""")
def embedding_reuse(spark: SparkSession, d: str) -> DataFrame:
    """How many texts need no vector of their own."""
    return stats.reuse(table(spark, d, "events"), "props")
