"""Validation, grounding, access, time, supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolore.catalog import EVENT_FACTS_SQL, HELD, VERSIONS_SQL, Catalog, event_facts, table
from chronolore.functions.dates import as_of
from chronolore.lineage import shared_folder
from chronolore.operators import acl, stats, supersede, temporal, validate
from chronolore.sources import episodes, runs
from chronolore.sources.episodes import render
from chronolore.streaming import restated
from chronolore.streaming import versions as stream_versions

query = Catalog()


def checked_facts(spark: SparkSession, d: str) -> DataFrame:
    """Event facts with columns that break rules in many ways."""
    f, no = event_facts(table(spark, d, "events")), F.col("fact_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("AGREED", "PROPOSED", "SUPERSEDED", "DONE", "BLOCKED")]), (no % 5 + 1).cast("int"))
    return f.select(
        no.alias("fact_no"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("episode_id"), "type",
        F.when(no % 11 == 0, F.lit(" ")).when(no % 13 == 0, F.lit("short")).when(no % 17 == 0, F.repeat("statement", 40)).otherwise(F.col("statement")).alias("statement"),
        F.when(no % 3 > 0, F.lit("someone")).alias("owner_mention"), "occurred_at", F.date_add(F.to_date("occurred_at"), (no % 4).cast("int") - 1).alias("due_date"), status.alias("status"),
        F.when(no % 7 > 0, F.array(F.struct(F.lit("e").alias("episode_id"), F.lit(0).alias("ordinal"), F.lit("quote").alias("span")))).otherwise(F.array().cast("array<struct<episode_id:string,ordinal:int,span:string>>")).alias("evidence"),
        F.round(F.col("value") / 100, 4).alias("confidence"),
    )


@query(f"""
    WITH {EVENT_FACTS_SQL}, c AS (
        SELECT fact_id, type, CASE WHEN fact_id % 11 = 0 THEN ' ' WHEN fact_id % 13 = 0 THEN 'short' WHEN fact_id % 17 = 0 THEN repeat(statement, 40) ELSE statement END AS s, fact_id % 3 > 0 AS owned, fact_id % 7 > 0 AS quoted,
            ['AGREED', 'PROPOSED', 'SUPERSEDED', 'DONE', 'BLOCKED'][fact_id % 5 + 1] AS status, fact_id % 4 = 0 AS early, round(value / 100, 4) AS confidence FROM f
    ), i AS (
        SELECT fact_id, list_filter([
            CASE WHEN trim(s) = '' THEN 'REJECT statement' END, CASE WHEN type IN ('ACTION_ITEM', 'COMMITMENT') AND NOT owned THEN 'REJECT owner' END, CASE WHEN NOT quoted THEN 'REJECT evidence' END,
            CASE WHEN trim(s) <> '' AND length(s) < 10 THEN 'REJECT statement' END, CASE WHEN trim(s) <> '' AND length(s) > 500 THEN 'WARN statement' END,
            CASE WHEN confidence < 0 OR confidence > 1 THEN 'REJECT confidence' WHEN confidence < 0.55 THEN 'WARN confidence' END,
            CASE WHEN status = 'SUPERSEDED' THEN 'REJECT status' WHEN type IN ('RISK', 'OPEN_QUESTION') AND status IN ('AGREED', 'DONE') THEN 'WARN status' END,
            CASE WHEN early THEN 'WARN dueDate' END], lambda x: x IS NOT NULL) AS issues FROM c)
    SELECT fact_id AS event_id, array_to_string(issues, ', ') AS issues, len(list_filter(issues, lambda x: starts_with(x, 'REJECT'))) = 0 AS accepted FROM i""")
def validate_fact_issues(spark: SparkSession, d: str) -> DataFrame:
    checked = checked_facts(spark, d).withColumn("issues", validate.field_issues())
    named = F.array_join(F.transform("issues", lambda i: F.concat(i["severity"], F.lit(" "), i["field"])), ", ")
    return checked.select(F.col("fact_no").alias("event_id"), named.alias("issues"), (~F.exists("issues", lambda i: i["severity"] == "REJECT")).alias("accepted"))


@query(f"""
    WITH {EVENT_FACTS_SQL}, c AS (
        SELECT type, CASE WHEN fact_id % 11 = 0 THEN ' ' WHEN fact_id % 13 = 0 THEN 'short' WHEN fact_id % 17 = 0 THEN repeat(statement, 40) ELSE statement END AS s, fact_id % 3 > 0 AS owned, fact_id % 7 > 0 AS quoted,
            fact_id % 5 + 1 = 3 AS superseded, round(value / 100, 4) AS confidence FROM f
    ), x AS (
        SELECT unnest([CASE WHEN trim(s) = '' THEN 'missing required field' WHEN length(s) < 10 THEN 'statement too short' END, CASE WHEN type IN ('ACTION_ITEM', 'COMMITMENT') AND NOT owned THEN 'missing required field' END,
            CASE WHEN NOT quoted THEN 'missing required field' END, CASE WHEN confidence < 0 OR confidence > 1 THEN left('outside [0,1]: ' || confidence, 40) END, CASE WHEN superseded THEN 'illegal status' END]) AS cause FROM c)
    SELECT cause, count(*) AS n FROM x WHERE cause IS NOT NULL GROUP BY cause""")
def rejection_causes(spark: SparkSession, d: str) -> DataFrame:
    """All rejections by cause."""
    rejected = checked_facts(spark, d).withColumn("i", F.explode(F.filter(validate.field_issues(), lambda i: i["severity"] == "REJECT")))
    run = rejected.select(F.array(F.struct(F.array(F.struct("i.severity", "i.field", "i.message")).alias("issues"))).alias("rejected"))
    return stats.rejections(run)


def quotes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A quote of each turn, ten characters in: cited at its own turn, or, for every third conversation, one too early; every seventh is
    made up."""
    said = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("episode_id"), F.col("turn").cast("int").alias("ordinal"), "text")
    span = F.when(F.col("episode_id").cast("long") % 7 == 0, F.lit("nobody ever said these words")).otherwise(F.concat(F.lit("  "), F.substring("text", 11, 40)))
    cited = F.when(F.col("episode_id").cast("long") % 3 == 0, F.greatest(F.col("ordinal") - 1, F.lit(0))).otherwise(F.col("ordinal"))
    return said.select(F.concat_ws("/", "episode_id", "ordinal").alias("quote_id"), "episode_id", cited.cast("int").alias("ordinal"), span.alias("span"), F.col("ordinal").alias("of_turn")), said


QUOTES_SQL = r"""
    n AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS t, text FROM conversations),
    q AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'nobody ever said these words' ELSE lower(trim(regexp_replace(substr(text, 11, 40), '[ \t\n\r\f\v]+', ' ', 'g'))) END AS span, CASE WHEN conv_id % 3 = 0 THEN greatest(turn - 1, 0) ELSE turn END AS cited FROM conversations),
    h AS (SELECT q.conv_id, q.turn, q.cited, min(n.turn) AS found, coalesce(bool_or(n.turn = q.cited), false) AS at_cited FROM q LEFT JOIN n ON n.conv_id = q.conv_id AND length(q.span) >= 12 AND contains(n.t, q.span) GROUP BY 1, 2, 3)"""


@query(f"WITH {QUOTES_SQL} SELECT conv_id || '/' || turn AS quote_id, at_cited, CAST(coalesce(found, -1) AS INT) AS found FROM h")
def grounding_gate(spark: SparkSession, d: str) -> DataFrame:
    return validate.locate(*quotes(spark, d)).select("quote_id", "at_cited", F.coalesce("found", F.lit(-1)).alias("found"))


@query(f"WITH {QUOTES_SQL} SELECT conv_id || '/' || turn AS quote_id, at_cited, CAST(coalesce(found, -1) AS INT) AS found FROM h")
def long_episode_quotes(spark: SparkSession, d: str) -> DataFrame:
    """grounding_gate where every episode is too long for testing all its utterances: quotes are found by anchors."""
    return validate.locate(*quotes(spark, d), most_pairs=0).select("quote_id", "at_cited", F.coalesce("found", F.lit(-1)).alias("found"))


@query(f"WITH {QUOTES_SQL} SELECT conv_id || '/' || turn AS fact_no, CAST(CASE WHEN at_cited OR found IS NULL THEN cited ELSE found END AS INT) AS ordinal FROM h")
def repair_citations(spark: SparkSession, d: str) -> DataFrame:
    quoted, said = quotes(spark, d)
    facts = quoted.select(F.col("quote_id").alias("fact_no"), "episode_id", F.array(F.struct("episode_id", "ordinal", "span")).alias("evidence"))
    return validate.repair_citations(facts, said).select("fact_no", F.col("evidence")[0]["ordinal"].alias("ordinal"))


@query(f"""WITH {QUOTES_SQL}
    SELECT CASE WHEN at_cited THEN 'grounded' WHEN found IS NOT NULL THEN 'WARN evidence.utteranceOrdinal' ELSE 'REJECT evidence.verbatimSpan' END AS outcome, count(*) AS n FROM h GROUP BY 1""")
def grounding_outcomes(spark: SparkSession, d: str) -> DataFrame:
    quoted, said = quotes(spark, d)
    facts = quoted.select(F.col("quote_id").alias("fact_no"), "episode_id", F.array(F.struct("episode_id", "ordinal", "span")).alias("evidence"))
    issues = facts.select("fact_no").join(validate.grounding_issues(facts, said), "fact_no", "left")
    named = F.coalesce(F.array_join(F.transform("quote_issues", lambda i: F.concat(i["severity"], F.lit(" "), i["field"])), ", "), F.lit("grounded"))
    return issues.groupBy(named.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
    SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def passages_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """Which benchmark passages stand in which documents."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return validate.passages(table(spark, d, "documents").select("doc_id", "text"), items).select("item_id", "doc_id")


@query("""
    WITH s AS (
        SELECT l_orderkey, CASE WHEN r_regionkey > 0 THEN 'slack:' || r_name END AS g, CASE WHEN r_regionkey = 0 THEN 1 WHEN r_regionkey < 3 THEN 2 ELSE 3 END AS rank
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT l_orderkey, coalesce(string_agg(DISTINCT g, ',' ORDER BY g), '') AS grants, ['PUBLIC', 'RESTRICTED', 'PRIVATE'][max(rank)] AS visibility, CAST(count(*) AS INT) AS n_sources FROM s GROUP BY l_orderkey""")
def acl_inherit(spark: SparkSession, d: str) -> DataFrame:
    """An order derives from the suppliers of its line items; a supplier's container is its region."""
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    visibility = F.when(F.col("r_regionkey") == 0, "PUBLIC").when(F.col("r_regionkey") < 3, "RESTRICTED").otherwise("PRIVATE")
    sources = places.select("s_suppkey", visibility.alias("visibility"), acl.grants_of(F.lit("SLACK"), F.col("r_name"), visibility).alias("acl_grants"))
    merged = acl.inherit(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(sources, F.col("l_suppkey") == F.col("s_suppkey")), ["l_orderkey"])
    return merged.select("l_orderkey", F.array_join("acl_grants", ",").alias("grants"), "visibility", "n_sources")


ORDER_GRANTS_SQL = """
    s AS (SELECT DISTINCT l_orderkey, r_regionkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    h AS (SELECT l_orderkey, bool_or(r_regionkey IN (2, 4)) AS hidden FROM s GROUP BY l_orderkey)"""
HELD_GRANTS = ["slack:AMERICA", "slack:EUROPE"]




@query(f"WITH {ORDER_GRANTS_SQL} SELECT l_orderkey FROM h WHERE NOT hidden")
def acl_readable(spark: SparkSession, d: str) -> DataFrame:
    return acl_inherit(spark, d).where(acl.readable(F.filter(F.split("grants", ","), lambda g: g != ""), HELD_GRANTS)).select("l_orderkey")


@query(f"WITH {ORDER_GRANTS_SQL} SELECT o_orderpriority, count(DISTINCT o_orderkey) AS withheld FROM h JOIN orders ON o_orderkey = l_orderkey WHERE hidden GROUP BY o_orderpriority")
def withheld_count(spark: SparkSession, d: str) -> DataFrame:
    hidden = acl.withheld(acl_inherit(spark, d).withColumn("g", F.filter(F.split("grants", ","), lambda g: g != "")), "g", HELD_GRANTS)
    return hidden.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count_distinct("o_orderkey").alias("withheld"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.versions(event_facts(table(spark, d, "events")), ["user_id", "type"], "occurred_at", ["fact_id"])


@query(f"WITH {VERSIONS_SQL} SELECT fact_id, type, user_id, valid_from, valid_to FROM v WHERE valid_from <= TIMESTAMP '{HELD}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{HELD}')")
def asof_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).where(temporal.held_at(as_of(HELD))).select("fact_id", "type", "user_id", "valid_from", "valid_to")


@query(f"""WITH {VERSIONS_SQL} SELECT e.event_id, v.fact_id, v.type FROM events e JOIN v ON v.user_id = e.user_id AND v.valid_from <= e.ts + INTERVAL 36 HOUR AND (v.valid_to IS NULL OR v.valid_to > e.ts + INTERVAL 36 HOUR)""")
def facts_at_moments(spark: SparkSession, d: str) -> DataFrame:
    """For each event, what held of its user a day and a half later."""
    asked = table(spark, d, "events").select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("moment"))
    return temporal.held_at_each(versions(spark, d).select("fact_id", "user_id", "type", "valid_from", "valid_to"), asked, ["user_id"]).select("event_id", "fact_id", "type")


@query(f"WITH {VERSIONS_SQL} SELECT fact_id, type, user_id, value FROM v WHERE valid_to IS NULL")
def current_state(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).where(temporal.current()).select("fact_id", "type", "user_id", "value")


@query(f"""WITH {VERSIONS_SQL}, c AS (SELECT fact_id, valid_from, CASE WHEN fact_id % 4 = 0 THEN valid_from - INTERVAL 1 DAY ELSE valid_to END AS closed_at FROM v)
    SELECT fact_id, valid_from, greatest(valid_from, closed_at) AS valid_to FROM c WHERE closed_at IS NOT NULL AND closed_at <= valid_from""")
def zero_width_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth fact is closed a day before it began: the interval is clamped, and told."""
    v = versions(spark, d)
    at = F.when(F.col("fact_id") % 4 == 0, F.col("valid_from") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("valid_to"))
    ends = v.select("fact_id", at.alias("closed_at"), F.lit("x").alias("superseded_by")).where("closed_at IS NOT NULL")
    facts = v.select("fact_id", "valid_from", F.lit("AGREED").alias("status"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit("").alias("superseded_by"))
    return temporal.zero_width(temporal.close(facts, ends)).select("fact_id", "valid_from", "valid_to")


@query(f"""WITH {VERSIONS_SQL} SELECT type, CASE WHEN valid_to IS NULL THEN 'AGREED' ELSE 'SUPERSEDED' END AS status, count(*) AS n FROM v GROUP BY ALL""")
def closed_status(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d)
    nxt = F.lead("fact_id").over(Window.partitionBy("user_id", "type").orderBy("occurred_at", "fact_id")).cast("string")
    ends = v.select("fact_id", F.col("valid_to").alias("closed_at"), nxt.alias("superseded_by")).where("closed_at IS NOT NULL")
    facts = v.select("fact_id", "type", "valid_from", F.lit("AGREED").alias("status"), "valid_to", F.lit("").alias("superseded_by"))
    return temporal.close(facts, ends).groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


def vector_facts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as facts of ten types, a minute apart."""
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("fact_id"), F.col("label").cast("string").alias("type"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("statement"), F.timestamp_seconds(F.col("vec_id") * 60).alias("occurred_at"), "embedding", F.col("vec_id").alias("seq"))


@query("""
    WITH p AS (
        SELECT n.vec_id AS newer, o.vec_id AS older, round(list_cosine_similarity(n.embedding::DOUBLE[], o.embedding::DOUBLE[]), 6) AS similarity,
            row_number() OVER (PARTITION BY n.vec_id ORDER BY o.vec_id DESC) AS k
        FROM embeddings n JOIN embeddings o ON n.label = o.label AND o.vec_id < n.vec_id AND round(list_cosine_similarity(n.embedding::DOUBLE[], o.embedding::DOUBLE[]), 9) >= 0.25)
    SELECT CAST(newer AS VARCHAR) AS newer, CAST(older AS VARCHAR) AS older, similarity FROM p WHERE k = 1""")
def supersession_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Like pairs at 0.25, as no two vectors are as like as 0.80."""
    best = supersede.proposals(supersede.like_pairs(vector_facts(spark, d), 0.25, latest=True))
    return best.select("newer", "older", F.round("similarity", 6).alias("similarity"))


NUMBERS = (7919, 104729, 1299709)


@query(f"""
    WITH v AS (SELECT event_id, event_type, ts, {", ".join(f"CAST(event_id * {n} % 1000 AS DOUBLE) - 499.5::DOUBLE AS x{n}" for n in NUMBERS)} FROM events),
    u AS (SELECT event_id, event_type, ts, {", ".join(f"x{n} / sqrt({' + '.join(f'x{m} * x{m}' for m in NUMBERS)}) AS x{n}" for n in NUMBERS)} FROM v)
    SELECT a.event_id AS newer, b.event_id AS older, round({" + ".join(f"a.x{n} * b.x{n}" for n in NUMBERS)}, 6) AS similarity
    FROM u a JOIN u b ON a.event_type = b.event_type AND b.ts < a.ts AND {" + ".join(f"a.x{n} * b.x{n}" for n in NUMBERS)} >= 0.9995""")
def like_event_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All like pairs of events of one type, whose vectors are made of their numbers; found by pivots, as a type has many tiles here."""
    no = F.col("event_id")
    vector = F.array(*[(no * n % 1000).cast("double") - 499.5 for n in NUMBERS])
    facts = table(spark, d, "events").select(no.alias("fact_id"), F.col("event_type").alias("type"), F.col("ts").alias("occurred_at"), vector.alias("embedding"), no.alias("seq"))
    return supersede.like_pairs(facts, 0.9995, tile=64).select("newer", "older", F.round("similarity", 6).alias("similarity"))


@query()
def supersession_fold(spark: SparkSession, d: str) -> DataFrame:
    """The fold over all vectors with a judge that decides by the statements. No SQL: each verdict changes what is open for the next;
    tests hold the fold against a plain pass."""
    facts = vector_facts(spark, d)
    judge = lambda old, new, _: (("SUPERSEDES", "DUPLICATE", "UNRELATED")[(int(old[1:]) + int(new[1:])) % 3], "x")
    return supersede.fold_facts(facts, judge, 0.25).where("verdict IS NOT NULL").select("newer", "older", "verdict", F.round("similarity", 6).alias("similarity"))


@query("""
    WITH s AS (
        SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), i AS (
        SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s
    ), c AS (
        SELECT user_id, island, min({'at': ts, 'id': event_id}) AS c FROM i WHERE event_id % 4 = 0 GROUP BY ALL
    )
    SELECT CAST(i.event_id AS VARCHAR) AS fact_id, c.c.at AS closed_at, 'n' || c.c.id AS superseded_by, c.c.id <> i.event_id AS propagated FROM i JOIN c ON i.user_id = c.user_id AND i.island = c.island""")
def duplicate_closures(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring events of one user and type are duplicates; every fourth event is closed, and its group with it."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.lag("event_id").over(order).alias("u"), F.lag("event_type").over(order).alias("before"))
    name = lambda c: F.col(c).cast("string").alias(c)
    pairs = events.where(F.col("before") == F.col("event_type")).select(name("u"), F.col("event_id").cast("string").alias("v"))
    closed = events.where("event_id % 4 = 0").select(F.col("event_id").cast("string").alias("fact_id"), F.col("ts").alias("closed_at"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("superseded_by"))
    return supersede.propagate(pairs, closed)


@query("""
    SELECT conv_id AS episode_id, md5('# ' || 'conversation ' || conv_id || chr(10) || 'Source: ' || conv_id || chr(10) || 'Occurred: 2024-01-01 00:00' || chr(10) || chr(10) ||
        string_agg('[' || turn || '] ' || role || ' (' || strftime(TIMESTAMP '2024-01-01' + INTERVAL (turn) MINUTE, '%Y-%m-%d %H:%M') || '): ' || text || chr(10), '' ORDER BY turn)) AS rendered_md5
    FROM conversations GROUP BY conv_id""")
def rendered_episodes(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    said = turns.select(F.col("conv_id").alias("episode_id"), F.col("turn").cast("int").alias("ordinal"), F.col("role").alias("speaker"), F.timestamp_seconds(F.unix_seconds(start) + F.col("turn") * 60).alias("at"), "text")
    heads = turns.select(F.col("conv_id").alias("episode_id")).distinct().select("episode_id", F.concat(F.lit("conversation "), F.col("episode_id").cast("string")).alias("title"), F.lit("X").alias("kind"), start.alias("occurred_at"))
    return render(heads, said).select("episode_id", F.md5("rendered").alias("rendered_md5"))


@query(f"""WITH {VERSIONS_SQL} SELECT user_id || '/' || type AS key, CAST(fact_id AS VARCHAR) AS fact_id, valid_from, valid_to, CAST(next_id AS VARCHAR) AS superseded_by, false AS late FROM v WHERE valid_to IS NOT NULL""")
def stream_closures(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream: each fact closes the one before it of its user and type. What the stream tells is written to the checkpoint
    folder and read back when the input is used up."""
    folder = shared_folder(spark, "stream")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream takes one file only so
    facts = event_facts(source).select(F.concat_ws("/", "user_id", "type").alias("key"), F.col("fact_id").cast("string").alias("fact_id"), F.col("occurred_at").cast("timestamp").alias("at"))
    told = stream_versions.closures(facts).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    told.awaitTermination()
    return spark.read.schema(stream_versions.CLOSURES).parquet(f"{folder}/out")


@query(f"""WITH {VERSIONS_SQL} SELECT user_id || '/' || type AS key, lpad(CAST(fact_id AS VARCHAR), 12, '0') AS fact_id, epoch_us(valid_from) AS from_us, epoch_us(valid_to) AS to_us, lpad(CAST(next_id AS VARCHAR), 12, '0') AS superseded_by FROM v""")
def restated_versions(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream in four batches that each hold events of all times, so that most come late and take back what was told. The changes, netted, are the
    versions of a batch over all events."""
    folder, c = shared_folder(spark, "restated"), F.col
    table(spark, d, "events").repartition(4, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    # Ids as strings of one length sort as their numbers do.
    facts = event_facts(source).select(F.concat_ws("/", "user_id", "type").alias("key"), F.lpad(c("fact_id").cast("string"), 12, "0").alias("fact_id"), c("occurred_at").cast("timestamp").alias("at"))
    with restated.store_in_use(spark):
        told = restated.changes(facts, "100 years").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        told.awaitTermination()
    return restated.settled(spark.read.schema(restated.CHANGES).parquet(f"{folder}/out"))


@query("""
    WITH s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    i AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS n FROM i GROUP BY user_id, session""")
def activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user's events, with twelve hours at most between one event and the next."""
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return episodes.sessions(rows, ["user_id"], "at", "12 hours").select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n")


@query("""
    WITH a AS (SELECT event_type AS type, user_id FROM events WHERE event_id % 3 > 0), b AS (SELECT event_type AS type, user_id FROM events WHERE event_id % 4 > 0)
    SELECT type, user_id, 'gone' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL UNION ALL SELECT type, user_id, 'new', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""")
def run_difference(spark: SparkSession, d: str) -> DataFrame:
    """What two extraction runs don't share, as often as they don't: one lacks every third event, the other every fourth."""
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), "user_id")
    before, after = (rows.where(f"event_id % {n} > 0").drop("event_id") for n in (3, 4))
    return runs.difference(before, after).select("type", "user_id", "side", "n")


@query(f"""WITH {VERSIONS_SQL}, s AS (SELECT type, valid_to IS NULL AS current, value FROM v)
    SELECT coalesce(type, 'all') AS type, CASE WHEN grouping(current) = 1 THEN 'all' WHEN current THEN 'current' ELSE 'closed' END AS state, count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY CUBE (type, current)""")
def fact_cube(spark: SparkSession, d: str) -> DataFrame:
    """Counts and values by type and state, with all their totals."""
    rows = versions(spark, d).select("type", temporal.current().alias("current"), "value")
    state = F.when(F.grouping("current") == 1, "all").when(F.col("current"), "current").otherwise("closed")
    cubed = rows.cube("type", "current").agg(state.alias("state"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return cubed.select(F.coalesce("type", F.lit("all")).alias("type"), "state", "n", "value")
