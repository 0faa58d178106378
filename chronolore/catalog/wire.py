"""The driver's conversations written as chat threads, meeting transcripts and pages, read back by the readers, and loaded."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolore import schemas
from chronolore.catalog import Catalog, table
from chronolore.functions.text import strip
from chronolore.lineage import cut, shared_folder
from chronolore.operators import search, stats, validate
from chronolore.plans import load
from chronolore.sources import chat, directory, episodes, files, meetings, pages, runs

query = Catalog()

FLAT = r"replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ':', ';')"
# Conversations 0, 3, 6, ... are threads, 1, 4, ... are meetings, 2, 5, ... are pages.
CHAT_SQL = """
    c AS (
        SELECT conv_id, turn, text, CASE WHEN turn % 4 = 3 THEN '' ELSE 'U' || role END AS raw_id, to_timestamp(1700000000 + conv_id * 1000 + turn)::TIMESTAMP + to_microseconds(turn) AS tm, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal,
            'slack:C' || conv_id % 5 || '/' || conv_id || '.000000' AS episode_id
        FROM conversations WHERE conv_id % 3 = 0)"""
MEETING_SQL = f"""
    m AS (
        SELECT conv_id, turn, role, {FLAT} AS said, CASE WHEN conv_id % 2 = 0 THEN 'z-' || conv_id ELSE 'm' || conv_id END AS external_id, CASE WHEN conv_id % 2 = 0 THEN TIMESTAMP '2024-01-01 10:00:00' ELSE TIMESTAMP '1970-01-01' END AS start,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal
        FROM conversations WHERE conv_id % 3 = 1)"""
PAGE_SQL = rf"""
    p AS (
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, {FLAT} AS said, CASE WHEN conv_id % 2 = 0 THEN 'pg-' || conv_id ELSE 'p' || conv_id || '.md' END AS external_id,
            CASE WHEN conv_id % 4 > 0 THEN 'Editor ' || conv_id % 3 ELSE 'Writer ' || conv_id % 5 END AS author
        FROM conversations WHERE conv_id % 3 = 2)"""


def flat(c: Column) -> Column:
    return F.replace(strip(F.regexp_replace(c, r"\s+", " ")), F.lit(":"), F.lit(";"))


def joined(turns: DataFrame, line: Column, between: str) -> DataFrame:
    """conv_id, body: the lines of each conversation in order."""
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), between).alias("body"))


@cache
def corpus(spark: SparkSession, d: str) -> str:
    """The folder that the conversations were written to as files of the three formats."""
    turns, c = table(spark, d, "conversations").where("conv_id IS NOT NULL"), F.col
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    no = c("conv_id").cast("string")
    ts = F.format_string("%d.%06d", 1700000000 + c("conv_id") * 1000 + c("turn"), c("turn"))
    message = F.struct(ts.alias("ts"), F.when(c("turn") % 4 < 3, F.concat(F.lit("U"), "role")).alias("user"), "text", F.concat(F.lit("https://chat.test/"), no).alias("permalink"))
    channel = F.struct(F.concat(F.lit("C"), (c("conv_id") % 5).cast("string")).alias("id"), F.when(c("conv_id") % 2 == 0, F.concat(F.lit("room "), (c("conv_id") % 5).cast("string"))).alias("name"), F.when(c("conv_id") % 4 == 0, "RESTRICTED").alias("visibility"))
    threads = turns.where("conv_id % 3 = 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    threads = threads.select(text("slack/threads/t", no, ".json").alias("path"), F.to_json(F.struct(channel.alias("channel"), text(no, ".000000").alias("thread_ts"), "messages")).alias("text"))
    users = spark.createDataFrame([("slack/users.json", '[{"id": "Uuser", "name": "user", "real_name": "User One", "profile": {"display_name": "user!", "email": "USER@x.test"}}, {"id": "Uassistant", "name": "assistant", "real_name": "Person 3"}]')], "path string, text string")
    ms = c("turn") * 1500
    time = F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    met = turns.where("conv_id % 3 = 1")
    vtt = joined(met, text(time, " --> later\n", c("role"), ": ", flat(c("text"))), "\n\n").select(text("zoom/m", no, ".vtt").alias("path"), text("WEBVTT\n\n", c("body"), "\n").alias("text"))
    person = F.struct(F.concat(F.lit("Person "), (c("conv_id") % 7).cast("string")).alias("name"), F.when(c("conv_id") % 4 == 0, F.concat(F.lit("P"), (c("conv_id") % 7).cast("string"), F.lit("@x.test"))).alias("email"))
    meta = met.where("conv_id % 2 = 0").select("conv_id").distinct().select(text("zoom/m", no, ".meta.json").alias("path"), F.to_json(F.struct(text("z-", no).alias("uuid"), text("Topic ", no).alias("topic"), F.lit("2024-01-01T10:00:00Z").alias("start_time"), F.struct(F.lit("ops").alias("id"), F.lit("PRIVATE").alias("visibility")).alias("scope"), F.array(person).alias("participants"))).alias("text"))
    front = text("---\n", F.when(c("conv_id") % 2 == 0, text("id: pg-", no, "\n")).otherwise(""), 'title: "Page ', no, '"\ncreated_by: Writer ', (c("conv_id") % 5).cast("string"), "\n", F.when(c("conv_id") % 4 > 0, text("last_edited_by: \"Editor ", (c("conv_id") % 3).cast("string"), "\"\n")).otherwise(""), "last_edited_time: 2024-02-01\nurl: https://wiki.test/", no, "\n---\n\n# Start\n\n")
    page = joined(turns.where("conv_id % 3 = 2"), flat(c("text")), "\n\n").select(text("notion/p", no, ".md").alias("path"), F.concat(front, "body").alias("text"))
    root = shared_folder(spark, "corpus")
    files.write(threads.unionByName(users).unionByName(vtt).unionByName(meta).unionByName(page), root)
    return root


@query(rf"""WITH {CHAT_SQL}
    SELECT episode_id, 'C' || any_value(conv_id) % 5 || '/' || any_value(conv_id) || '.000000' AS external_id, 'SLACK_THREAD' AS kind, '#' || CASE WHEN any_value(conv_id) % 2 = 0 THEN 'room ' || any_value(conv_id) % 5 ELSE 'C' || any_value(conv_id) % 5 END || ' — ' || (
            CASE WHEN length(trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g'))) <= 70 THEN trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) ELSE substr(trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')), 1, 67) || '...' END) AS title,
        epoch_us(min(tm)) AS occurred_us, CASE WHEN any_value(conv_id) % 4 = 0 THEN 'slack:C' || any_value(conv_id) % 5 ELSE '' END AS grants, sha256(string_agg('SLACK:' || raw_id || chr(0) || text || chr(0), '' ORDER BY ordinal)) AS content_hash
    FROM c GROUP BY episode_id""")
def chat_episodes(spark: SparkSession, d: str) -> DataFrame:
    found = chat.read(spark, corpus(spark, d)).episodes
    return found.select("episode_id", "external_id", "kind", "title", F.unix_micros("occurred_at").alias("occurred_us"), F.array_join("acl_grants", ",").alias("grants"), "content_hash")


@query(f"""WITH {CHAT_SQL}
    SELECT episode_id, CAST(ordinal AS INT) AS ordinal, raw_id, CASE raw_id WHEN 'Uuser' THEN 'user!' WHEN 'Uassistant' THEN 'Person 3' ELSE raw_id END AS speaker, epoch_us(tm) AS at_us, md5(text) AS text_md5, 'https://chat.test/' || conv_id AS permalink FROM c""")
def chat_utterances(spark: SparkSession, d: str) -> DataFrame:
    said = chat.read(spark, corpus(spark, d)).utterances
    return said.select("episode_id", "ordinal", "raw_id", "speaker", F.unix_micros("at").alias("at_us"), F.md5("text").alias("text_md5"), "permalink")


@query(f"""WITH {MEETING_SQL}
    SELECT 'zoom:' || external_id AS episode_id, CASE WHEN any_value(conv_id) % 2 = 0 THEN 'Topic ' || any_value(conv_id) ELSE 'm' || any_value(conv_id) END AS title, epoch_us(any_value(start)) AS occurred_us,
        CASE WHEN any_value(conv_id) % 2 = 0 THEN 'PRIVATE' ELSE 'PUBLIC' END AS visibility, CASE WHEN any_value(conv_id) % 2 = 0 THEN 'zoom:ops' ELSE '' END AS grants
    FROM m GROUP BY external_id""")
def meeting_episodes(spark: SparkSession, d: str) -> DataFrame:
    found = meetings.read(spark, corpus(spark, d)).episodes
    return found.select("episode_id", "title", F.unix_micros("occurred_at").alias("occurred_us"), "visibility", F.array_join("acl_grants", ",").alias("grants"))


@query(f"""WITH {MEETING_SQL}
    SELECT 'zoom:' || external_id AS episode_id, CAST(ordinal AS INT) AS ordinal, 'm' || conv_id || ':' || role AS raw_id, role AS speaker, epoch_us(start) + turn * 1500000 AS at_us, md5(said) AS text_md5 FROM m""")
def meeting_utterances(spark: SparkSession, d: str) -> DataFrame:
    said = meetings.read(spark, corpus(spark, d)).utterances
    return said.select("episode_id", "ordinal", "raw_id", "speaker", F.unix_micros("at").alias("at_us"), F.md5("text").alias("text_md5"))


@query(f"""WITH {PAGE_SQL}
    SELECT 'notion:' || external_id AS episode_id, 'Page ' || any_value(conv_id) AS title, epoch_us(TIMESTAMP '2024-02-01') AS occurred_us, 'https://wiki.test/' || any_value(conv_id) AS permalink, external_id AS scope_id FROM p GROUP BY external_id""")
def page_episodes(spark: SparkSession, d: str) -> DataFrame:
    found = pages.read(spark, corpus(spark, d)).episodes
    return found.select("episode_id", "title", F.unix_micros("occurred_at").alias("occurred_us"), "permalink", "scope_id")


@query(f"""WITH {PAGE_SQL}
    SELECT 'notion:' || external_id AS episode_id, CAST(ordinal AS INT) AS ordinal, author AS speaker, md5(CASE WHEN ordinal = 0 THEN '# Start' || chr(10) ELSE '' END || said) AS text_md5 FROM p""")
def page_utterances(spark: SparkSession, d: str) -> DataFrame:
    """Blocks between blank lines; the heading is folded into the first."""
    return pages.read(spark, corpus(spark, d)).utterances.select("episode_id", "ordinal", "speaker", F.md5("text").alias("text_md5"))


@query(f"""WITH {PAGE_SQL}
    SELECT DISTINCT 'p' || conv_id || '.md' AS file, CASE WHEN conv_id % 4 > 0 THEN 'Writer ' || conv_id % 5 || ',Editor ' || conv_id % 3 ELSE 'Writer ' || conv_id % 5 END AS authors FROM p""")
def page_authors(spark: SparkSession, d: str) -> DataFrame:
    return pages.files(spark, corpus(spark, d)).select("file", F.array_join(pages.authors(F.col("value")), ",").alias("authors"))


@query(f"""WITH {CHAT_SQL}, {MEETING_SQL}, {PAGE_SQL}, e AS (
        SELECT episode_id, min(tm) AS tm FROM c GROUP BY 1 UNION ALL SELECT DISTINCT 'zoom:' || external_id, start FROM m UNION ALL SELECT DISTINCT 'notion:' || external_id, TIMESTAMP '2024-02-01' FROM p)
    SELECT episode_id, CAST(row_number() OVER (ORDER BY tm, episode_id) AS INT) AS place FROM e""")
def corpus_by_time(spark: SparkSession, d: str) -> DataFrame:
    """All readers' episodes in the order of their times."""
    found, _ = load.read_corpus(spark, corpus(spark, d))
    return search.global_rank(found.episodes.select("episode_id", "occurred_at"), [F.col("occurred_at"), F.col("episode_id")]).select("episode_id", F.col("rank").alias("place"))


@query(f"""WITH {MEETING_SQL}, w AS (SELECT DISTINCT conv_id FROM m WHERE conv_id % 2 = 0)
    SELECT 'zoom:z-' || conv_id AS episode_id, CASE WHEN conv_id % 4 = 0 THEN 'person:email:p' || conv_id % 7 || '@x.test' ELSE 'person:name:person ' || conv_id % 7 END AS person_id FROM w""")
def meeting_participants(spark: SparkSession, d: str) -> DataFrame:
    return directory.read(spark, corpus(spark, d)).participants


TYPES = list(schemas.REQUIRED_FIELDS)
SAID_SQL = f"""{CHAT_SQL}, {MEETING_SQL}, {PAGE_SQL}, u AS (
        SELECT episode_id, ordinal, text, tm FROM c UNION ALL SELECT 'zoom:' || external_id, ordinal, said, start + to_milliseconds(turn * 1500) FROM m
        UNION ALL SELECT 'notion:' || external_id, ordinal, CASE WHEN ordinal = 0 THEN '# Start' || chr(10) ELSE '' END || said, TIMESTAMP '2024-02-01' FROM p
    ), n AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS plain FROM u),
    f AS (
        SELECT episode_id, ordinal, text, tm, {TYPES}[CAST(ordinal % 5 + 1 AS INT)] AS type, 'The fact ' || ordinal || ' of ' || episode_id AS statement FROM n WHERE ordinal % 2 = 0 AND (ordinal % 5 NOT IN (1, 2) OR ordinal % 4 = 0) AND length(plain) >= 12)"""
FACT_ID_SQL = "'fact:' || substr(sha256(episode_id || chr(0) || type || chr(0) || statement), 1, 24)"


def extracted_from(utterances: DataFrame) -> DataFrame:
    """Every second utterance is a fact that quotes it, once at its place and once where nothing is; those of even fours have an owner."""
    c, none = F.col, F.array().cast("array<string>")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (c("ordinal") % 5 + 1).cast("int"))
    quote = lambda at, span: F.struct(c("episode_id"), at.cast("int").alias("ordinal"), span.alias("span"))
    return utterances.where("ordinal % 2 = 0").select(
        "episode_id", kind.alias("type"), F.concat(F.lit("The fact "), c("ordinal").cast("string"), F.lit(" of "), "episode_id").alias("statement"), F.when(c("ordinal") % 4 == 0, F.lit("Person 3,")).alias("owner_mention"), none.alias("participant_mentions"),
        c("at").alias("occurred_at"), F.lit(None).cast("date").alias("due_date"), F.lit("PROPOSED").alias("status"), F.array(F.concat(F.lit(" Topic "), (c("ordinal") % 4).cast("string")), F.lit(" ")).alias("topics"), F.array(quote(c("ordinal"), c("text")), quote(c("ordinal") + 1000, c("text"))).alias("evidence"), F.lit(0.9).alias("confidence"),
    )


@cache
def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The facts of extracted_from(), loaded, written and read back."""
    found, people = load.read_corpus(spark, corpus(spark, d))
    accepted, _ = load.accept(extracted_from(found.utterances), found.utterances)
    folder = shared_folder(spark, "tables")
    load.write(load.build(found, people, accepted, load.Slots(least_similarity=2.0)), folder)
    return load.read(spark, folder)


def places_of(texts: list[str]) -> np.ndarray:
    """An embedder for which facts of threads are like if their numbers are, and others like nothing."""
    out = np.zeros((len(texts), 8), np.float32)
    for row, text in zip(out, texts, strict=True):
        if " of slack:" in (text or ""):
            row[int(text.split()[2]) // 2 % 8] = 1
    return out


def third_is_the_same(older: str, newer: str, similarity: float) -> tuple[str, str]:
    """A judge for whom a fact of a conversation of threes of threes says what was said before; others replace it."""
    return ("DUPLICATE", "") if int(newer.rpartition("/")[2].split(".")[0]) % 9 == 0 else ("SUPERSEDES", "something")


@cache
def synced(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Half of the corpus loaded, with what replaces what, then all of it synchronised: the folder, and what was rewritten."""
    found, people = load.read_corpus(spark, corpus(spark, d))
    accepted = cut(load.accept(extracted_from(found.utterances), found.utterances)[0])
    slots, folder = load.Slots(embedder=places_of, judge=third_is_the_same), shared_folder(spark, "synced")
    half = F.pmod(F.xxhash64("episode_id"), F.lit(2)) == 0
    load.write(load.build(episodes.Episodes(found.episodes.where(half), found.utterances.where(half)), people, accepted.where(half), slots), folder)
    return folder, load.sync(spark, folder, found, people, accepted, slots)


REPLACED_SQL = f"""{SAID_SQL}, s AS (
        SELECT {FACT_ID_SQL} AS fact_id, tm, type, ordinal // 2 % 8 AS place, CAST(split_part(split_part(episode_id, '/', 2), '.', 1) AS BIGINT) % 9 > 0 AS replaces FROM f WHERE starts_with(episode_id, 'slack:')
    ), i AS (
        SELECT *, sum(CASE WHEN replaces THEN 1 ELSE 0 END) OVER w AS island, lag(fact_id) OVER w AS before, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY type, place ORDER BY tm, fact_id)
    ), g AS (
        SELECT type, place, island, arg_min(fact_id, n) AS first, min(tm) AS first_tm FROM i GROUP BY ALL
    ), r AS (
        SELECT i.fact_id, i.replaces, i.before, i.n, g.first AS superseded_by, g.first_tm FROM i LEFT JOIN g ON g.type = i.type AND g.place = i.place AND g.island = i.island + 1
    )"""


@query(f"""WITH {REPLACED_SQL} SELECT {FACT_ID_SQL} AS fact_id, CASE WHEN r.superseded_by IS NULL THEN 'PROPOSED' ELSE 'SUPERSEDED' END AS status, 'PROPOSED' AS status_given, epoch_us(r.first_tm) AS valid_to_us, r.superseded_by
    FROM f LEFT JOIN r ON r.fact_id = {FACT_ID_SQL}""")
def synced_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts after a load of half the corpus and a synchronisation with all of it: what replaces what is as if all had been loaded at once, passed on among
    duplicates."""
    return load.read(spark, synced(spark, d)[0])["facts"].select("fact_id", "status", "status_given", F.unix_micros("valid_to").alias("valid_to_us"), "superseded_by")


@query(f"""WITH {REPLACED_SQL} SELECT (SELECT count(*) FROM f) AS facts, (SELECT count(*) FROM r WHERE replaces AND before IS NOT NULL) AS superseding, (SELECT count(*) FROM r WHERE NOT replaces AND before IS NOT NULL) AS duplicates,
    (SELECT count(*) FROM r WHERE superseded_by IS NOT NULL) - (SELECT count(*) FROM r WHERE replaces AND before IS NOT NULL) AS propagated, 15 AS tables""")
def synced_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the synchronised load counts; how many tables it reports on."""
    folder, told = synced(spark, d)
    report = stats.load_report(load.read(spark, folder))
    return report.select("facts", "superseding", "duplicates", "propagated", F.lit(told.count()).cast("int").alias("tables"))


@query(f"""WITH {SAID_SQL} SELECT {FACT_ID_SQL} AS fact_id, episode_id, type, statement, epoch_us(tm) AS valid_from_us, 'PROPOSED' AS status FROM f""")
def load_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that passed the checks, under their ids; those that need an owner and have none are gone."""
    return tables(spark, d)["facts"].select("fact_id", "episode_id", "type", "statement", F.unix_micros("valid_from").alias("valid_from_us"), "status")


@query(f"""WITH {SAID_SQL} SELECT {FACT_ID_SQL} AS fact_id, episode_id, CAST(min(n.ordinal) AS INT) AS ordinal FROM f JOIN n USING (episode_id) WHERE n.ordinal = f.ordinal GROUP BY ALL
    UNION SELECT {FACT_ID_SQL}, episode_id, CAST(min(n.ordinal) AS INT) FROM f JOIN n USING (episode_id) WHERE contains(n.plain, lower(trim(regexp_replace(f.text, '\\s+', ' ', 'g')))) GROUP BY ALL""")
def load_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Where quotes stand: the second one of each fact cites nothing and is led to the first place that has it."""
    return tables(spark, d)["evidence"].select("fact_id", "episode_id", "ordinal").distinct()


@query(f"""WITH {SAID_SQL} SELECT {FACT_ID_SQL} AS fact_id, 'topic ' || ordinal % 4 AS topic FROM f""")
def load_topics(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)["topics"]


@query(f"""WITH {SAID_SQL}, who AS (SELECT count(*) AS mailed FROM m WHERE conv_id % 4 = 0 AND conv_id % 7 = 3), here AS (SELECT DISTINCT episode_id FROM c WHERE raw_id = 'Uassistant'),
    o AS (SELECT {FACT_ID_SQL} AS fact_id, CASE WHEN (SELECT mailed FROM who) = 0 THEN 'EXACT_NAME' WHEN episode_id IN (SELECT episode_id FROM here) THEN 'UNIQUE_IN_EPISODE' ELSE 'UNRESOLVED' END AS method FROM f WHERE ordinal % 4 = 0)
    SELECT fact_id, method, method <> 'UNRESOLVED' AS resolved FROM o""")
def load_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Owners of the facts that name one, and how they were found. One person of that name is resolved; of several, the one who spoke in the episode."""
    return tables(spark, d)["ownership"].select("fact_id", "method", F.col("person_id").isNotNull().alias("resolved"))


@query(f"""WITH {CHAT_SQL}, {MEETING_SQL}, {PAGE_SQL}, e AS (SELECT DISTINCT episode_id, 'SLACK' AS system FROM c UNION ALL SELECT DISTINCT 'zoom:' || external_id, 'ZOOM' FROM m UNION ALL SELECT DISTINCT 'notion:' || external_id, 'NOTION' FROM p)
    SELECT system, count(*) AS episodes FROM e GROUP BY system""")
def load_episodes(spark: SparkSession, d: str) -> DataFrame:
    return episodes.counts_by_system(tables(spark, d)["episodes"])


@query(f"""WITH {SAID_SQL}
    SELECT (SELECT count(DISTINCT episode_id) FROM u) AS episodes, (SELECT count(*) FROM u) AS utterances, (SELECT count(*) FROM f) AS facts, (SELECT count(*) FROM f WHERE ordinal % 4 = 0) AS named_owners, 0::BIGINT AS superseding, 0::BIGINT AS duplicates, 0::BIGINT AS propagated""")
def load_counts(spark: SparkSession, d: str) -> DataFrame:
    report = stats.load_report(tables(spark, d))
    return report.select("episodes", "utterances", "facts", (F.col("owned") + F.col("unresolved_owners")).alias("named_owners"), "superseding", "duplicates", "propagated")


@query("""SELECT component, true AS healthy FROM (VALUES ('people'), ('episodes'), ('utterances'), ('facts'), ('embedder'), ('chat')) AS t(component)""")
def doctor_report(spark: SparkSession, d: str) -> DataFrame:
    return load.doctor(tables(spark, d)).select("component", "healthy")


@query(f"""WITH {SAID_SQL}
    SELECT 'Fact' AS kind, count(*) AS nodes FROM f UNION ALL SELECT 'Episode', count(DISTINCT episode_id) FROM u UNION ALL SELECT 'Topic', count(DISTINCT ordinal % 4) FROM f""")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return load.graph(tables(spark, d)).nodes.where("kind <> 'Person'").groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


@query("""SELECT 'lineitem' AS table_name, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")
def key_faults(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur more than once, in a table where they do and in one where they do not."""
    frames = {t: table(spark, d, t) for t in ("lineitem", "orders")}
    return validate.schema_faults(frames, {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"]})


@query("""
    SELECT c_custkey, CASE WHEN o.k IS NULL THEN c_name ELSE 'changed' END AS name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey
    UNION ALL SELECT DISTINCT o_custkey, 'changed' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers, with those who ordered replaced and those unknown added."""
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("changed").alias("name")).distinct()
    return load.upsert(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")), new, ["c_custkey"])


@query("""SELECT n_nationkey % 3 AS kept, count(*) AS facts, CAST(sum(CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS dated FROM nation GROUP BY 1""")
def run_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Two runs are written; the newer one is found and its accepted facts read."""
    from datetime import datetime

    fact = F.struct(F.lit("RISK").alias("type"), F.col("n_name").alias("statement"), F.when(F.col("n_nationkey") % 3 == 1, "2024-01-01T00:00:00Z").otherwise("soon").alias("occurredAt"), F.array(F.struct(F.lit("e").alias("episodeId"), F.lit(0).alias("utteranceOrdinal"), F.col("n_name").alias("verbatimSpan"))).alias("evidence"), F.lit(0.5).alias("confidence"))
    rows = table(spark, d, "nation").select((F.col("n_nationkey") % 3).cast("string").alias("episodeId"), F.array(fact).alias("accepted"))
    folder = shared_folder(spark, "runs")
    runs.write_run(rows.limit(0), folder, datetime(2024, 1, 1))
    runs.write_run(rows, folder, datetime(2024, 1, 2))
    got = runs.accepted(runs.read_run(spark, runs.newest_run(spark, folder)))
    return got.groupBy(F.col("episode_id").cast("int").alias("kept")).agg(F.count(F.lit(1)).alias("facts"), F.count("occurred_at").alias("dated"))


@query("""
    SELECT 'source' AS kind, 'G' || n_nationkey AS holder, 'e' || n_nationkey AS missing FROM nation WHERE n_nationkey % 5 = 0
    UNION ALL SELECT 'entity', 'G' || n_nationkey, n_name FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'fact', 'Q' || r_regionkey, 'G' || (r_regionkey * 20) FROM region WHERE r_regionkey * 20 NOT IN (SELECT n_nationkey FROM nation)""")
def gold_key_faults(spark: SparkSession, d: str) -> DataFrame:
    """Nations as gold facts: every fifth names an unknown source, every fourth an unknown person; regions ask for facts that may not be there."""
    nation, region, c = table(spark, d, "nation"), table(spark, d, "region"), F.col
    no = c("n_nationkey").cast("string")
    fact = F.struct(F.concat(F.lit("G"), no).alias("id"), F.lit("RISK").alias("type"), c("n_name").alias("statement"), F.when(c("n_nationkey") % 4 == 1, c("n_name")).when(c("n_nationkey") % 4 == 2, "Ann").alias("owner"), F.array(F.concat(F.lit("e"), no)).alias("sources"))
    question = F.struct(F.concat(F.lit("Q"), c("r_regionkey").cast("string")).alias("id"), c("r_name").alias("question"), F.array(F.concat(F.lit("G"), (c("r_regionkey") * 20).cast("string"))).alias("expected_facts"))
    one = lambda df, name, item: df.agg(F.to_json(F.struct(F.collect_list(item).alias(name))).alias("text")).select(F.lit(f"{name}.json").alias("path"), "text")
    root = shared_folder(spark, "key")
    people = spark.createDataFrame([("entities.json", '{"entities": [{"canonical": "Ann"}], "non_matches": []}')], "path string, text string")
    files.write(one(nation, "facts", fact).unionByName(one(region, "questions", question)).unionByName(people), root)
    known = nation.where("n_nationkey % 5 > 0").select(F.concat(F.lit("e"), no).alias("episode_id"))
    return runs.key_faults(runs.gold_facts(spark, f"{root}/facts.json"), runs.gold_questions(spark, f"{root}/questions.json"), runs.gold_entities(spark, f"{root}/entities.json")[0], known)
