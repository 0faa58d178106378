"""Reading, turns, blocks, hashes, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolore.catalog import Catalog, table
from chronolore.functions import dates, ids, text
from chronolore.operators import resolve
from chronolore.sources import directory, episodes, meetings, pages

query = Catalog()


@query("""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(0) || text || chr(0), '' ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id""")
def episode_content_hash(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), ids.content_hash(F.col("turn"), F.col("role"), F.col("text")).alias("content_hash"))


@query("""SELECT event_id, 'fact:' || substr(sha256('user:' || user_id || chr(0) || upper(event_type) || chr(0) || coalesce(props, 'null')), 1, 24) AS fact_id FROM events""")
def fact_content_id(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select("event_id", ids.fact_id(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.upper("event_type"), F.col("props")).alias("fact_id"))


@query("""
    WITH s AS (
        SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), i AS (
        SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS turn_no FROM s
    )
    SELECT user_id, CAST(turn_no AS INT) AS turn_no, any_value(event_type) AS event_type, min(ts) AS ts, min_by(event_id, ts) AS event_id, string_agg(props, ' ' ORDER BY ts, event_id) AS props, CAST(count(*) AS INT) AS n_turns
    FROM i GROUP BY user_id, turn_no""")
def merge_turns(spark: SparkSession, d: str) -> DataFrame:
    """Events as turns, as no conversation has neighbouring turns of one role."""
    return episodes.merge_turns(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "props")


@query(r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents
    ), n AS (
        SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS block FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
    ), k AS (
        SELECT *, coalesce(sum(CASE WHEN length(block) <= 12 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ordinal FROM n
    )
    SELECT doc_id, CAST(ordinal AS INT) AS ordinal, md5(string_agg(block, chr(10) ORDER BY place)) AS text_md5 FROM k GROUP BY doc_id, ordinal""")
def block_fold(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks, those of 12 characters or fewer as headings: documents have neither blank lines nor marked headings."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.withColumn("block", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "")).where("block <> ''")
    folded = pages.fold_headings(lines, ["doc_id"], "place", "block", F.length("block") <= 12)
    return folded.select("doc_id", "ordinal", F.md5("text").alias("text_md5"))


@query("""
    WITH c AS (SELECT conv_id, turn, role, replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ':', ';') AS said FROM conversations)
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ordinal, role AS speaker, turn * 1500 AS offset_ms, md5(said) AS said_md5 FROM c WHERE said <> ''""")
def transcript_cues(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as transcripts and read back."""
    said = F.replace(text.strip(F.regexp_replace("text", r"\s+", " ")), F.lit(":"), F.lit(";"))
    ms = F.col("turn") * 1500
    time = F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    cue = F.concat(time, F.lit(" --> later\n"), "role", F.lit(": "), said, F.lit("\n\n"))
    files = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "")).alias("value"))
    turns = episodes.merge_turns(meetings.cues(files), ["conv_id"], ["place", "offset_ms"], "speaker", "said")
    return turns.where("said <> ''").select("conv_id", F.col("turn_no").alias("ordinal"), "speaker", "offset_ms", F.md5("said").alias("said_md5"))


@query("""SELECT page_id, url, CAST(page_id AS VARCHAR) AS id, CAST(length(html) AS BIGINT) AS body_chars FROM pages""")
def page_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    """Pages written with frontmatter and read back."""
    written = F.concat(F.lit("---\nid: "), F.col("page_id").cast("string"), F.lit('\nurl: "'), "url", F.lit('"\nnot a pair\n---\n'), "html")
    made = table(spark, d, "pages").select("page_id", "html", written.alias("file")).withColumn("m", pages.frontmatter(F.col("file")))
    return made.select("page_id", F.col("m")["url"].alias("url"), F.col("m")["id"].alias("id"), F.length(pages.body(F.col("file"))).cast("long").alias("body_chars"))


@query("""SELECT event_id, epoch_us(ts) AS micros, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def message_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Times written as chat message ids and read back."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    written = F.format_string("%d.%06d", F.floor(us / 1_000_000), us % 1_000_000)
    read = table(spark, d, "events").withColumn("at", dates.message_ts(written))
    return read.select("event_id", F.unix_micros("at").alias("micros"), dates.day(F.col("at")).alias("day"))


@query("""SELECT source AS system, count(*) AS episodes FROM documents GROUP BY source""")
def episodes_by_system(spark: SparkSession, d: str) -> DataFrame:
    return episodes.counts_by_system(table(spark, d, "documents").withColumnRenamed("source", "system"))


@query("""WITH h AS (SELECT conv_id, sha256(string_agg(role || chr(0) || text || chr(0), '' ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id)
    SELECT conv_id FROM h WHERE conv_id % 3 = 0""")
def changed_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Which conversations to load again, when a third of those stored has another hash."""
    new = episode_content_hash(spark, d).select(F.col("conv_id").alias("episode_id"), "content_hash")
    stored = new.withColumn("content_hash", F.when(F.col("episode_id") % 3 == 0, "other").otherwise(F.col("content_hash")))
    return episodes.changed(new, stored).select(F.col("episode_id").alias("conv_id"))


@query("""
    WITH u AS (SELECT 'person:email:' || lower(replace(c_name, '#', '.')) || '@x.test' AS person_id, c_name AS name, c_nationkey FROM customer),
    p AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 AND u.person_id IS NOT NULL THEN u.person_id ELSE 'person:name:' || regexp_replace(lower(s_name), '[^a-z0-9 ]', '', 'g') END AS person_id, s_name
        FROM supplier LEFT JOIN u ON s_suppkey % 2 = 0 AND u.name = 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')),
    e AS (SELECT person_id, 'SLACK:' || name AS alias FROM u UNION SELECT person_id, 'ZOOM:' || s_name FROM p)
    SELECT person_id, CAST(count(*) AS INT) AS n_aliases, string_agg(alias, ',' ORDER BY alias) AS aliases FROM e GROUP BY person_id""")
def directory_merge(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users; suppliers as participants, every second one with a customer's e-mail."""
    mail = lambda name: F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@x.test"))
    none = F.lit(None).cast("string")
    users = table(spark, d, "customer").select(F.col("c_name").alias("id"), F.col("c_name").alias("name"), F.col("c_name").alias("real_name"), mail(F.col("c_name")).alias("email"), none.alias("display_name"), none.alias("title"))
    other = F.format_string("Customer#%09d", "s_suppkey")
    met = table(spark, d, "supplier").select(F.lit("e").alias("episode_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, mail(other)).alias("email"))
    met = met.join(users.select("email").distinct().withColumn("_known", F.lit(1)), "email", "left").select("episode_id", "name", F.when(F.col("_known") == 1, F.col("email")).alias("email"))
    found = directory.merge(users, met, spark.createDataFrame([], "author string"))
    return found.people.select("person_id", F.size("aliases").alias("n_aliases"), F.array_join("aliases", ",").alias("aliases"))


def _people(spark: SparkSession, d: str) -> directory.Directory:
    """Nations' customers: named by nation and segment, so that names repeat; present in the episode of their nation."""
    who = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat("c_mktsegment", F.lit(" "), "n_name", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).otherwise(""))
    rows = who.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("person_id"), name.alias("name"), F.col("n_name").alias("nation"))
    people = rows.select("person_id", "name", F.concat("person_id", F.lit("@x.test")).alias("email"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("aliases"))
    aliases = rows.select(F.lit("SLACK").alias("system"), F.upper("person_id").alias("value"), "person_id")
    return directory.Directory(people, aliases, rows.select(F.col("nation").alias("episode_id"), "person_id"), rows.limit(0))


LADDER_SQL = r"""
    p AS (
        SELECT 'p' || c_custkey AS person_id, n_name AS nation, regexp_replace(lower(c_mktsegment || ' ' || n_name || CASE WHEN c_custkey % 10 = 0 THEN ' ' || c_custkey ELSE '' END), '[^a-z0-9 ]', '', 'g') AS name
        FROM customer JOIN nation ON c_nationkey = n_nationkey
    ), names AS (SELECT person_id, name FROM p UNION SELECT person_id, person_id FROM p),
    m AS (
        SELECT o_orderkey AS mention_no, n_name AS episode_id, regexp_replace(lower(mention), '[^a-z0-9 ]', '', 'g') AS norm, mention FROM (
            SELECT o_orderkey, n.n_name, CASE o_orderkey % 6
                WHEN 0 THEN 'P' || o_custkey || '@X.test' WHEN 1 THEN c_mktsegment || ' ' || n.n_name WHEN 2 THEN c_mktsegment || ' ' || n.n_name || ' ' || c_custkey
                WHEN 3 THEN 'P' || o_custkey WHEN 4 THEN 'nobody ' || o_custkey ELSE substr(c_mktsegment, 1, 4) END AS mention
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON n.n_nationkey = o_orderkey % 25)
    ), present AS (SELECT nation AS episode_id, person_id FROM p WHERE CAST(substr(person_id, 2) AS INT) % 7 = 0)"""


@query(rf"""
    WITH {LADDER_SQL}, d AS (SELECT DISTINCT episode_id, norm, mention FROM m),
    label AS (SELECT d.mention, d.episode_id, min(present.person_id) AS who FROM d JOIN present ON present.episode_id = d.episode_id AND lower(d.mention) = 'label ' || present.person_id GROUP BY 1, 2),
    x AS (SELECT d.norm, d.episode_id, d.mention, count(DISTINCT n.person_id) AS k, min(n.person_id) AS who, count(DISTINCT CASE WHEN r.person_id IS NOT NULL THEN n.person_id END) AS kp, min(CASE WHEN r.person_id IS NOT NULL THEN n.person_id END) AS whop
        FROM d LEFT JOIN names n ON n.name = d.norm LEFT JOIN present r ON r.episode_id = d.episode_id AND r.person_id = n.person_id GROUP BY 1, 2, 3),
    s AS (SELECT d.norm, d.episode_id, d.mention, count(DISTINCT n.person_id) AS k, min(n.person_id) AS who, count(DISTINCT CASE WHEN r.person_id IS NOT NULL THEN n.person_id END) AS kp, min(CASE WHEN r.person_id IS NOT NULL THEN n.person_id END) AS whop
        FROM d LEFT JOIN names n ON starts_with(n.name, d.norm) LEFT JOIN present r ON r.episode_id = d.episode_id AND r.person_id = n.person_id GROUP BY 1, 2, 3)
    SELECT m.mention_no,
        CASE WHEN contains(m.mention, '@') THEN lower(split_part(m.mention, '@', 1)) WHEN x.k = 1 THEN x.who WHEN x.k > 1 THEN CASE WHEN x.kp = 1 THEN x.whop END WHEN s.kp = 1 THEN s.whop WHEN s.k = 1 THEN s.who END AS person_id,
        CASE WHEN contains(m.mention, '@') THEN 'EMAIL' WHEN x.k = 1 THEN 'EXACT_NAME' WHEN x.k > 1 THEN CASE WHEN x.kp = 1 THEN 'UNIQUE_IN_EPISODE' ELSE 'UNRESOLVED' END WHEN s.kp = 1 THEN 'UNIQUE_IN_EPISODE' WHEN s.k = 1 THEN 'EXACT_NAME' ELSE 'UNRESOLVED' END AS method
    FROM m JOIN x ON x.norm = m.norm AND x.episode_id = m.episode_id AND x.mention = m.mention JOIN s ON s.norm = m.norm AND s.episode_id = m.episode_id AND s.mention = m.mention""")
def mention_ladder(spark: SparkSession, d: str) -> DataFrame:
    """A mention per order, in the episode of a nation: an e-mail, a name, a name with a number, a handle, nobody, or the start of a name."""
    people = _people(spark, d)
    own = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("o_orderkey") % 25 == F.col("n_nationkey"))
    key = F.col("o_custkey").cast("string")
    kinds = [F.concat(F.lit("P"), key, F.lit("@X.test")), F.concat("c_mktsegment", F.lit(" "), "n_name"), F.concat("c_mktsegment", F.lit(" "), "n_name", F.lit(" "), key), F.concat(F.lit("P"), key), F.concat(F.lit("nobody "), key), F.substring("c_mktsegment", 1, 4)]
    mention = F.element_at(F.array(*kinds), (F.col("o_orderkey") % 6 + 1).cast("int"))
    asked = own.select(F.col("o_orderkey").alias("mention_no"), F.col("n_name").alias("episode_id"), mention.alias("mention"))
    here = people.participants.where(F.substring("person_id", 2, 20).cast("int") % 7 == 0)
    speakers = here.select("episode_id", F.lit("SLACK").alias("system"), F.upper("person_id").alias("raw_id"), F.concat(F.lit("label "), "person_id").alias("label"), "person_id", F.lit("HANDLE").alias("method"), F.lit("").alias("rationale"))
    return resolve.mentions(asked, people, speakers).select("mention_no", "person_id", "method")


@query("""
    SELECT event_type AS episode_id, 'P' || user_id AS raw_id, CASE WHEN c.c_custkey IS NOT NULL THEN 'p' || user_id END AS person_id, CASE WHEN c.c_custkey IS NOT NULL THEN 'HANDLE' ELSE 'UNRESOLVED' END AS method
    FROM (SELECT DISTINCT event_type, user_id * 3 AS user_id FROM events) e LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def speaker_handles(spark: SparkSession, d: str) -> DataFrame:
    key = (F.col("user_id") * 3).cast("string")
    said = table(spark, d, "events").select(F.col("event_type").alias("episode_id"), F.lit("SLACK").alias("system"), F.concat(F.lit("P"), key).alias("raw_id"), F.concat(F.lit("someone "), key).alias("speaker"))
    return resolve.speakers(said, _people(spark, d)).select("episode_id", "raw_id", "person_id", "method")


@query("""
    WITH r AS (SELECT CASE WHEN c.c_custkey IS NOT NULL THEN 1 ELSE 0 END AS hit FROM (SELECT DISTINCT event_type, user_id * 3 AS user_id FROM events) e LEFT JOIN customer c ON c.c_custkey = e.user_id)
    SELECT count(*) AS n, CAST(sum(hit) AS BIGINT) AS certain, sum(hit) / count(*)::DOUBLE AS share FROM r""")
def deterministic_share(spark: SparkSession, d: str) -> DataFrame:
    return resolve.deterministic_share(speaker_handles(spark, d))


@query("""
    SELECT p_partkey, left(regexp_replace(trim(regexp_replace(replace(p_name || '/' || p_brand || ': ' || p_type || '.', '/', ' '), '[:#]', ' ', 'g')), '\\s+', ' ', 'g'), 100) AS slugged FROM part""")
def note_slugs(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit("/"), "p_brand", F.lit(": "), "p_type", F.lit("."))
    return table(spark, d, "part").select("p_partkey", F.concat(text.slug(name), F.lit(".")).alias("slugged"))


@query("""
    WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 2 AND w NOT IN (
        'the','and','for','did','does','was','are','who','what','when','where','why','how','our','with','that','this','has','have','any','still','there','yet','about'))) AS k FROM documents)
    SELECT doc_id, CAST(len(k) AS INT) AS n_keywords, md5(array_to_string(list_sort(k), ' ')) AS keywords_md5 FROM t""")
def text_keywords(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", text.keywords(F.col("text")).alias("k"))
    return words.select("doc_id", F.size("k").alias("n_keywords"), F.md5(F.array_join(F.array_sort("k"), " ")).alias("keywords_md5"))


@query("""
    SELECT doc_id, CASE WHEN contains(t, '.') THEN split_part(t, '.', 1) || '.' ELSE t END AS opening,
        CASE WHEN length(t) <= 70 THEN t ELSE substr(t, 1, 67) || '...' END AS title
    FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents)""")
def opening_sentences(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "documents").select("doc_id", text.strip(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    return flat.select("doc_id", text.opening_sentence(F.col("t")).alias("opening"), text.ellipsis(F.col("t"), 70).alias("title"))


@query("""
    WITH w AS (SELECT conv_id, turn, role || ' ' || conv_id || CASE turn % 5 WHEN 0 THEN '.' WHEN 1 THEN ',;' WHEN 2 THEN ' R.' WHEN 3 THEN '.:' ELSE '' END AS m FROM conversations)
    SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN left(m, length(m) - 1) WHEN 1 THEN left(m, length(m) - 2) WHEN 3 THEN left(m, length(m) - 2) ELSE m END AS mention FROM w""")
def cleaned_mentions(spark: SparkSession, d: str) -> DataFrame:
    tails = F.element_at(F.array(*[F.lit(t) for t in (".", ",;", " R.", ".:", "")]), (F.col("turn") % 5 + 1).cast("int"))
    name = F.concat(F.lit("  "), "role", F.lit(" "), F.col("conv_id").cast("string"), tails, F.lit("\t"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.clean_mention(name).alias("mention"))


@query("""SELECT order_key, CAST(row_number() OVER (PARTITION BY order_key ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS ordinal, l_partkey FROM (SELECT l_orderkey AS order_key, * FROM lineitem)""")
def thread_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as messages of a thread."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), (F.row_number().over(order) - 1).cast("int").alias("ordinal"), "l_partkey")
