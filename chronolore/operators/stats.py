"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolore.functions.text import rejection_class
from chronolore.functions.vectors import ratio


def run_totals(run: DataFrame) -> DataFrame:
    """One row of an extraction run: episodes, accepted, rejected, warnings, tokens in and out, seconds of its calls and how many were timed, acceptance_rate (1 of nothing)."""
    total = run.agg(
        F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum(F.size("accepted")), F.lit(0)).alias("accepted"), F.coalesce(F.sum(F.size("rejected")), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"), F.coalesce(F.sum("inputTokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("outputTokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(F.regexp_extract("elapsed", r"^PT([\d.]+)S$", 1).try_cast("double")), F.lit(0.0)).alias("seconds"), F.count("elapsed").alias("timed"),
    )
    return total.withColumn("acceptance_rate", ratio(F.col("accepted"), F.col("accepted") + F.col("rejected"), 1.0))


def rejections(run: DataFrame) -> DataFrame:
    """cause, n over all rejecting issues of a run."""
    issues = run.select(F.explode("rejected").alias("r")).select(F.explode("r.issues").alias("i")).where("i.severity = 'REJECT'")
    return issues.groupBy(rejection_class(F.col("i.message")).alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """value, n, percent."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def percentiles(rows: DataFrame, key: list[str], value: str, shares: list[float]) -> DataFrame:
    """key, n and p<share> by nearest rank: the ceil(share * n)-th value. percentile_disc picks that value, from counts of different values
    (merged before the shuffle), so no group is gathered in one list."""
    of = [F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * s)}") for s in shares]
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *of)


def throughput(rows: DataFrame, key: list[str], ok: str, seconds: str) -> DataFrame:
    """key, ok, errors, per_second."""
    return rows.groupBy(*key).agg(F.count_if(F.col(ok)).alias("ok"), F.count_if(~F.col(ok)).alias("errors"), F.max(seconds).alias("seconds")).withColumn("per_second", ratio(F.col("ok"), F.col("seconds"), 0.0))


def load_report(frames: dict[str, DataFrame]) -> DataFrame:
    """One row of counters over the tables of a load (plans.load): people, episodes, utterances, facts, evidence, owned, unresolved owners,
    superseding, duplicate and passed-on edges, and candidates that replaced nothing (duplicates included)."""
    count = lambda df, name, n=None: df.agg((n if n is not None else F.count(F.lit(1))).alias(name))
    judged = frames["judgements"]
    parts = [count(frames[t], t) for t in ("people", "episodes", "utterances", "facts", "evidence")]
    parts.append(frames["ownership"].agg(F.count_if(F.col("person_id").isNotNull()).alias("owned"), F.count_if(F.col("person_id").isNull()).alias("unresolved_owners")))
    verdicts = {"SUPERSEDES": "superseding", "DUPLICATE": "duplicates"}
    parts.append(judged.agg(*[F.count_if(F.col("verdict") == v).alias(n) for v, n in verdicts.items()], F.count_if(F.col("verdict") != "SUPERSEDES").alias("rejected_candidates")))
    parts.append(frames["edges"].agg(F.count_if("via_duplicate").alias("propagated")))
    one = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        one = one.join(p.withColumn("_k", F.lit(1)), "_k")
    return one.drop("_k")


def reuse(rows: DataFrame, text: str) -> DataFrame:
    """One row: n, different, hit_rate: the share of texts that a cache of all different ones answers (0 of nothing)."""
    total = rows.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(text).alias("different"))
    return total.withColumn("hit_rate", ratio(F.col("n") - F.col("different"), F.col("n"), 0.0))


def daily_sketches(rows: DataFrame, key: list[str], at: str, value: str, member: str) -> DataFrame:
    """day, key, values (a KLL sketch of the quantiles of a number), members (an HLL sketch of the different members): a few kilobytes for each day and key,
    however many rows it has. Stored by day, a new day is sketched alone. Nulls count in neither. A null day or key is one of its own."""
    day = F.to_date(F.col(at).cast("timestamp")).alias("day")
    return rows.groupBy(day, *key).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values"), F.hll_sketch_agg(F.col(member).cast("string")).alias("members"))


def from_sketches(sketches: DataFrame, key: list[str], shares: list[float]) -> DataFrame:
    """key, n (rows with a value, exact), p<share>, members (about how many different): the days' sketches merged, over any days that are left in. The rank of a
    quantile is off by 1.7 % of n at most with 99 % confidence, members by 1.6 % in the standard deviation."""
    merged = sketches.groupBy(*key).agg(F.kll_merge_agg_double("values").alias("_v"), F.hll_sketch_estimate(F.hll_union_agg("members")).alias("members"))
    n = F.kll_sketch_get_n_double("_v")
    of = [F.when(n > 0, F.kll_sketch_get_quantile_double("_v", F.lit(float(s)))).alias(f"p{round(100 * s)}") for s in shares]
    return merged.select(*key, n.alias("n"), *of, "members")
