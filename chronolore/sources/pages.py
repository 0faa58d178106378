"""Pages: notion/*.md, frontmatter and markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolore.functions.dates import instant_of
from chronolore.functions.text import strip
from chronolore.lineage import cut
from chronolore.sources.episodes import Episodes, assemble, exists, none
from chronolore.sources.files import gathered


def unquote(c: Column) -> Column:
    return F.when((F.length(c) >= 2) & F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def frontmatter(c: Column) -> Column:
    """Map of the flat `key: value` lines between the first two lines that start with ---; a later line of one key wins."""
    # What lambdas use again is bound to a name: an expression would be computed anew, over the whole page, for each line of the frontmatter.
    bound = lambda value, use: F.transform(F.array(value), use)[0]
    end = lambda lines: F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("---"))), True).cast("int")
    until = lambda lines: bound(end(lines), lambda n: F.when(n > 0, F.slice(lines, F.lit(1), n - 1)).otherwise(lines))
    inside = F.filter(bound(F.slice(F.split(c, r"\r?\n"), 2, 1 << 30), until), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), unquote(strip(F.substring(x, F.instr(x, ":") + 1, F.length(x)))).alias("v"))
    last = bound(F.transform(inside, pair), lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"])))
    return F.when(F.startswith(c, F.lit("---")), F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def body(c: Column) -> Column:
    """What follows the frontmatter."""
    close = F.locate("\n---", c, 4)
    return F.when(F.startswith(c, F.lit("---")) & (close > 0), F.regexp_replace(F.substring(c, close + 4, F.length(c)), r"^\s+", "")).otherwise(c)


def fold_headings(blocks: DataFrame, key: list[str], place: str, block: str, is_heading: Column) -> DataFrame:
    """Blocks with headings folded into the block below them: key, ordinal (from 0), text. A heading at the end stays by itself.

    An island is a block and the headings before it; it is numbered by the blocks before it.
    """
    by_place = Window.partitionBy(*key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocks.withColumn("ordinal", F.coalesce(F.sum(F.when(is_heading, 0).otherwise(1)).over(by_place), F.lit(0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(place, F.col(block).alias("_b"))))
    return numbered.groupBy(*key, "ordinal").agg(F.array_join(F.transform(parts, lambda p: p["_b"]), "\n").alias("text"))


def blocks(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """Blocks between blank lines, with lone headings folded in."""
    parts = pages.select(*key, F.posexplode(F.split(text, r"\n\s*\n")).alias("place", "raw")).withColumn("block", strip(F.col("raw"))).where("block <> ''")
    lone = F.startswith(F.col("block"), F.lit("#")) & ~F.contains(F.col("block"), F.lit("\n"))
    return fold_headings(parts, key, "place", "block", lone)


def authors(c: Column) -> Column:
    """Different created_by and last_edited_by values of a page's frontmatter, in order."""
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: x.rlike("^(created_by|last_edited_by):"))
    names = F.transform(lines, lambda x: unquote(strip(F.substring(x, F.instr(x, ":") + 1, F.length(x)))))
    return F.array_distinct(F.filter(names, lambda n: strip(n) != ""))


def files(spark: SparkSession, root: str) -> DataFrame:
    """Rows file, value."""
    if not exists(spark, f"{root}/notion"):
        return spark.createDataFrame([], "file string, value string")
    return gathered(spark.read.text(f"{root}/notion", wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file"), "value"))


def read(spark: SparkSession, root: str) -> Episodes:
    if not exists(spark, f"{root}/notion"):
        return none(spark)
    pages = files(spark, root).withColumn("m", frontmatter(F.col("value")))
    get = lambda k: F.try_element_at("m", F.lit(k))
    heads = cut(pages.select(
        F.lit("NOTION").alias("system"),
        F.coalesce(get("id"), "file").alias("external_id"),
        F.lit("NOTION_PAGE").alias("kind"),
        F.coalesce(get("title"), get("id"), "file").alias("title"),
        F.coalesce(instant_of(get("last_edited_time")), F.timestamp_seconds(F.lit(0))).alias("occurred_at"),
        get("url").alias("permalink"),
        F.coalesce(get("id"), "file").alias("scope_id"),
        F.coalesce(get("visibility"), F.lit("PUBLIC")).alias("visibility"),
        F.coalesce(get("last_edited_by"), get("created_by"), F.lit("unknown")).alias("author"),
        body(F.col("value")).alias("body"),
    ))
    said = blocks(heads, ["system", "external_id", "author", "occurred_at", "permalink"], "body")
    said = said.select("system", "external_id", "ordinal", F.col("author").alias("raw_id"), F.col("author").alias("speaker"), F.col("occurred_at").alias("at"), "text", "permalink")
    return assemble(heads.drop("author", "body"), said)
