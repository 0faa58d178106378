"""Checks of extracted facts: required fields, length, confidence, status, dates, and quotes against what was said."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolore import schemas
from chronolore.functions.text import ellipsis, is_blank, normalise
from chronolore.lineage import cut

# Fixed values.
SHORTEST, LONGEST, LOW_CONFIDENCE, SHORTEST_QUOTE, QUOTE_SHOWN = 10, 500, 0.55, 12, 80
#: Pairs of a quote and an utterance of one episode that are tested one by one; steps and runs of anchors, and the shortest quotes that have them.
MOST_PAIRS, ANCHORS = 1_000_000, [(5, 8, 12), (17, 32, 48)]
#: Words of a passage that are joined by equality, and passages too short for it that one pass carries along.
RUN, MOST_SHORT = 4, 256


def issue(severity: str, field: str | Column, message: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), (F.lit(field) if isinstance(field, str) else field).alias("field"), message.alias("message"))


def only_if(condition: Column, found: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(found)).otherwise(F.array().cast(f"array<{schemas.ISSUE}>"))


def required(fact_type: Column) -> Column:
    """Array of the fields that a type asks for."""
    out = F.array().cast("array<string>")
    for name, fields in schemas.REQUIRED_FIELDS.items():
        out = F.when(fact_type == name, F.array(*[F.lit(f) for f in fields])).otherwise(out)
    return out


def given(statement: str = "statement", owner: str = "owner_mention", evidence: str = "evidence") -> Column:
    """Array of the fields that a fact has, of those that any type asks for."""
    has = {"STATEMENT": ~is_blank(F.col(statement)), "OWNER": ~is_blank(F.col(owner)), "EVIDENCE": F.size(evidence) > 0}
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in has.items()]), lambda x: x.isNotNull())


def field_issues() -> Column:
    """Issues that a fact's own columns show, in the order of the checks."""
    c, statement, status, fact_type = F.col, F.col("statement"), F.col("status"), F.col("type")
    missing = F.transform(F.array_except(required(fact_type), given()), lambda f: issue("REJECT", F.lower(f), F.concat(fact_type, F.lit(" requires "), f)))
    length, said = F.length(statement), ~is_blank(statement)
    day = F.to_date("occurred_at")
    return F.concat(
        missing,
        only_if(said & (length < SHORTEST), issue("REJECT", "statement", F.concat(F.lit("too short to be self-contained: "), statement))),
        only_if(said & (length > LONGEST), issue("WARN", "statement", F.format_string("%d characters: so long a fact is usually several", length))),
        only_if((c("confidence") < 0) | (c("confidence") > 1), issue("REJECT", "confidence", F.concat(F.lit("outside [0,1]: "), c("confidence").cast("string")))),
        only_if((c("confidence") >= 0) & (c("confidence") < LOW_CONFIDENCE), issue("WARN", "confidence", F.format_string("low (%.2f): for a person to look at", c("confidence")))),
        only_if(status == "SUPERSEDED", issue("REJECT", "status", F.lit("SUPERSEDED is set when a newer fact comes, never by extraction"))),
        only_if(fact_type.isin("RISK", "OPEN_QUESTION") & status.isin("AGREED", "DONE"), issue("WARN", "status", F.concat(fact_type, F.lit(" cannot be "), status))),
        only_if(c("due_date") < day, issue("WARN", "dueDate", F.format_string("due %s comes before the conversation on %s", c("due_date").cast("string"), day.cast("string")))),
    )


def locate(quotes: DataFrame, utterances: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """quotes (quote_id, episode_id, ordinal, span, ...) with at_cited (the cited utterance has it) and found (the first that does, else
    null). A quote under SHORTEST_QUOTE characters is nowhere.

    Quotes meet all utterances of their episode by equality, and containment is tested there. Episodes of more than most_pairs such pairs are searched
    by anchors instead (located_by_anchors()), so that none, however long, is a task's alone."""
    said = utterances.select("episode_id", F.col("ordinal").alias("_said"), normalise(F.col("text")).alias("_text"))
    wanted = quotes.withColumn("_span", normalise(F.col("span")))
    asked = wanted.where(F.length("_span") >= SHORTEST_QUOTE).select("quote_id", "episode_id", "ordinal", "_span")
    pairs = asked.groupBy("episode_id").agg(F.count(F.lit(1)).alias("q")).join(said.groupBy(F.col("episode_id").alias("e")).agg(F.count(F.lit(1)).alias("u")), F.col("episode_id") == F.col("e"))
    large = cut(pairs.where(F.col("q") * F.col("u") > most_pairs).select("episode_id"))
    if large.isEmpty():
        places = located_by_episode(asked, said)
    else:
        of_large = lambda df, how: df.join(large.select(F.col("episode_id").alias("_l")), F.col("episode_id") == F.col("_l"), how)
        inside = [of_large(df, "left_semi") for df in (asked, said)]
        places = located_by_episode(of_large(asked, "left_anti"), of_large(said, "left_anti")).unionByName(located_by_anchors(*inside))
    return wanted.join(places, "quote_id", "left").withColumn("at_cited", F.coalesce("at_cited", F.lit(False))).drop("_span")


def located_by_episode(asked: DataFrame, said: DataFrame) -> DataFrame:
    """quote_id, found, at_cited of the quotes that stand somewhere."""
    hits = asked.join(said, "episode_id").where(F.contains(F.col("_text"), F.col("_span")))
    return hits.groupBy("quote_id").agg(F.min("_said").alias("found"), F.max(F.col("_said") == F.col("ordinal")).alias("at_cited"))


def located_by_anchors(asked: DataFrame, said: DataFrame) -> DataFrame:
    """located_by_episode() without meeting every utterance. A text's anchors are its runs of so many characters at every step-th place. Where a quote stands, an anchor
    begins among its first step characters, and lies in it whole: step + run - 1 is at most its length. So a quote's runs at its first step places
    are joined with the anchors by equality, and containment is tested on what meets. Long quotes have longer runs, which fewer texts share. Equal texts
    of an episode are one, with the first of their ordinals; whether the cited utterance has the quote is asked of that one alone."""
    cited = asked.join(said.withColumnRenamed("_said", "ordinal"), ["episode_id", "ordinal"]).where(F.contains(F.col("_text"), F.col("_span"))).select("quote_id").distinct().withColumn("at_cited", F.lit(True))
    texts = cut(said.where(F.length("_text") >= SHORTEST_QUOTE).groupBy("episode_id", "_text").agg(F.min("_said").alias("_said")).withColumn("_no", F.monotonically_increasing_id()))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for episode, number, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words, episode = text.as_py(), episode.as_py()
                for step, run, _ in ANCHORS:
                    for start in range(0, len(words) - run + 1, step << 16):
                        runs = sorted({words[i : i + run] for i in range(start, min(start + (step << 16), len(words) - run + 1), step)})
                        yield pa.RecordBatch.from_arrays([pa.repeat(episode, len(runs)), pa.repeat(number, len(runs)), pa.array(runs, pa.string())], names=["episode_id", "_no", "run"])

    length, ends = F.length("_span"), [*[shortest for *_, shortest in ANCHORS[1:]], 1 << 31]
    run_at = lambda run: lambda i: F.substr(F.col("_span"), i, F.lit(run))
    runs = [F.when((length >= shortest) & (length < end), F.transform(F.sequence(F.lit(1), F.lit(step)), run_at(run))) for (step, run, shortest), end in zip(ANCHORS, ends, strict=True)]
    of_quote = asked.select("quote_id", "episode_id", F.explode(F.array_distinct(F.coalesce(*runs))).alias("run"))
    of_text = texts.select("episode_id", "_no", "_text").mapInArrow(anchors, "episode_id string, _no long, run string")
    near = of_quote.join(of_text, ["episode_id", "run"]).select("quote_id", "_no").distinct()
    hits = near.join(texts.select("_no", "_text", "_said"), "_no").join(asked.select("quote_id", "_span"), "quote_id").where(F.contains(F.col("_text"), F.col("_span")))
    found = hits.groupBy("quote_id").agg(F.min("_said").alias("found"))
    return found.join(cited, "quote_id", "left").withColumn("at_cited", F.coalesce("at_cited", F.lit(False)))


def passages(texts: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id: which passages (item_id, passage) stand, letter by letter, in which texts (doc_id, text).

    The first and the last word of a passage may be parts of longer words of the text; those between them are whole words there. Up to
    RUN of these are joined by equality of their hash, and only what matches is searched. Passages of one or two words have none: they are
    a stated set, sent along to one pass over the texts, MOST_SHORT at a time."""
    split = items.where(F.col("passage").isNotNull()).select("item_id", "passage", F.split("passage", r"\s+").alias("w"))
    runs = split.withColumn("n", F.least(F.size("w") - 2, F.lit(RUN)))
    keyed = runs.where("n > 0").select("item_id", "passage", F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("n")), " ")).alias("k"), "n")
    words = texts.where(F.col("text").isNotNull()).select("doc_id", F.split("text", r"\s+").alias("w"))
    run_of = lambda n: lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " "))
    found = [texts.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}")]
    for n in sorted(r["n"] for r in keyed.select("n").distinct().collect()):
        have = words.where(F.size("w") >= n).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), run_of(n)))).alias("k"))
        near = have.join(keyed.where(F.col("n") == n), "k").select("doc_id", "item_id", "passage").distinct()
        found.append(near.join(texts, "doc_id").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id").distinct())
    short = runs.where("n <= 0").select("item_id", "passage")
    rows = short.count()
    parts = -(-rows // MOST_SHORT)
    for part in range(parts):
        asked = short.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        given = F.array(*[F.struct(F.lit(r["item_id"]).alias("item_id"), F.lit(r["passage"]).alias("passage")) for r in asked])
        if asked:
            found.append(texts.select("doc_id", F.explode(F.filter(given, lambda p: F.contains(F.col("text"), p["passage"]))).alias("p")).select("p.item_id", "doc_id").distinct())
    return reduce(DataFrame.unionByName, found)


def quotes_of(facts: DataFrame) -> DataFrame:
    """fact_no, place, quote_id and the evidence of each fact."""
    rows = facts.select("fact_no", F.col("episode_id").alias("own_episode"), F.posexplode("evidence").alias("place", "e"))
    return rows.select("fact_no", "place", "own_episode", F.concat_ws("/", "fact_no", "place").alias("quote_id"), "e.episode_id", "e.ordinal", "e.span")


def grounding_issues(facts: DataFrame, utterances: DataFrame) -> DataFrame:
    """fact_no, quote_issues: by each fact's quotes."""
    found = locate(quotes_of(facts), utterances)
    foreign = F.col("episode_id") != F.col("own_episode")
    own = (
        F.when(foreign, issue("REJECT", "evidence.episodeId", F.format_string("cites %s but was extracted from %s", "episode_id", "own_episode")))
        .when(~F.col("at_cited") & F.col("found").isNotNull(), issue("WARN", "evidence.utteranceOrdinal", F.format_string("span cites utterance %d but appears at %d", "ordinal", "found")))
        .when(~F.col("at_cited"), issue("REJECT", "evidence.verbatimSpan", F.concat(F.lit('ungrounded, not found anywhere in the episode: "'), ellipsis(F.col("span"), QUOTE_SHOWN), F.lit('"'))))
    )
    bad = found.withColumn("own", own).where("own IS NOT NULL")
    return bad.groupBy("fact_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "own"))), lambda x: x["own"]).alias("quote_issues"))


def validate(facts: DataFrame, utterances: DataFrame) -> DataFrame:
    """facts (schemas.EXTRACTED_FACTS and a unique fact_no) with issues and accepted."""
    quoted = grounding_issues(facts, utterances)
    joined = facts.join(quoted, "fact_no", "left")
    issues = F.concat(field_issues(), F.coalesce("quote_issues", F.array().cast(f"array<{schemas.ISSUE}>")))
    return joined.withColumn("issues", issues).withColumn("accepted", ~F.exists("issues", lambda i: i["severity"] == "REJECT")).drop("quote_issues")


def repair_citations(facts: DataFrame, utterances: DataFrame) -> DataFrame:
    """facts with evidence that cites the utterance where the quote first stands, if the cited one lacks it and another has it."""
    found = locate(quotes_of(facts).where(F.col("episode_id") == F.col("own_episode")), utterances)
    better = found.where(~F.col("at_cited") & F.col("found").isNotNull()).groupBy("fact_no").agg(F.map_from_entries(F.collect_list(F.struct("place", "found"))).alias("_better"))
    fixed = F.transform("evidence", lambda e, i: F.struct(e["episode_id"].alias("episode_id"), F.coalesce(F.try_element_at("_better", i), e["ordinal"]).alias("ordinal"), e["span"].alias("span")))
    return facts.join(better, "fact_no", "left").withColumn("evidence", F.when(F.col("_better").isNull(), F.col("evidence")).otherwise(fixed)).drop("_better")


def first_issue(severity: str) -> Column:
    return F.get(F.filter("issues", lambda i: i["severity"] == severity), F.lit(0))["message"]


def schema_faults(frames: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Rows (table_name, key, n) of keys that occur more than once: the uniqueness that stored tables promise."""
    faults = [frames[t].groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(t).alias("table_name"), F.concat_ws("/", *k).alias("key"), "n") for t, k in keys.items()]
    return reduce(DataFrame.unionByName, faults)
