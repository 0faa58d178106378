"""Results against answer keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolore.functions.text import citations, opening_sentence, term_coverage
from chronolore.functions.vectors import ratio

# Fixed values.
MATCH, ON_TARGET_SIMILARITY, ON_TARGET_COVERAGE = 0.72, 0.62, 0.6
#: Rows of a tile, about; gold facts scored at once; pairs counted exactly at once; how much a product may be off.
TILE, AT_ONCE, EXACT_AT_ONCE, ROUNDING = 8192, 256, 1 << 15, 2e-9


def padded(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, ...]:
    """Vectors as rows of doubles with zeros to the width, their lengths and norms, and which are null or hold a null (these are zero)."""
    rows = pa.concat_arrays(column.chunks)
    n = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, x = rows.flatten(), np.zeros((len(rows), width))
    at, place = np.repeat(np.arange(len(rows)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    x[at, place] = flat.to_numpy(zero_copy_only=False)
    void = rows.is_null().to_numpy(zero_copy_only=False)
    void[at[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = True
    x[void] = 0
    return x, n, np.sqrt(np.cumsum(x * x, axis=1)[:, -1]), void


def exact_cosines(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """vectors.cosine() of row i of a and row j of b, summed in the same order."""
    shorter, lengths = np.minimum(a[1][i], b[1][j]), a[2][i] * b[2][j]
    products = np.where(np.arange(a[0].shape[1]) < shorter[:, None], a[0][i] * b[0][j], 0.0)
    return np.where((np.isnan(lengths) | (lengths > 0)) & ~a[3][i] & ~b[3][j], np.cumsum(products, axis=1)[:, -1] / np.where(lengths == 0, 1.0, lengths), 0.0)


def best_matches(gold: DataFrame, found: DataFrame, least: float = MATCH) -> DataFrame:
    """The best found fact of each gold fact in the episodes that the key names. gold: id, type, sources, embedding. found: episode_id, type,
    seq, embedding, statement. Returns gold_id, gold_type, episode_id, type, statement, similarity; of equals the first by source, then seq.

    Both sides of an episode are dealt to tiles, and each two tiles are one group. A matrix product tells which found facts may be a gold fact's best in the tile, and
    only these are counted exactly and leave it: mostly one for each gold fact and tile. The products grow as gold facts times found facts of an
    episode, what is shuffled and held as their number times the tiles of the other side."""
    wanted = gold.select(F.col("id").alias("gold_id"), F.col("type").alias("gold_type"), F.col("embedding").alias("_g"), F.posexplode("sources").alias("_source", "episode_id"))
    there = found.select("episode_id", "type", "seq", F.col("embedding").alias("_f"), "statement")
    tiles = lambda df, n: df.groupBy("episode_id").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(n))
    both = tiles(wanted, "_golds").join(tiles(there, "_founds"), "episode_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda by, n: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    left = wanted.join(both, "episode_id").withColumn("_a", deal(["gold_id"], "_golds")).withColumn("_b", each("_founds")).drop("_golds", "_founds")
    right = there.join(both, "episode_id").withColumn("_b", deal(["seq", "statement"], "_founds")).withColumn("_a", each("_golds")).drop("_golds", "_founds")
    from_gold, from_found = ["gold_id", "gold_type", "_source", "episode_id"], ["type", "seq", "statement"]

    def run(golds: pa.Table, facts: pa.Table) -> pa.Table:
        picked = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(golds) and len(facts):
            facts = facts.take(pc.sort_indices(facts, sort_keys=[("seq", "ascending")], null_placement="at_start"))
            width = max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (golds.column("_g"), facts.column("_f"))) or 1
            a, b = padded(golds.column("_g"), width), padded(facts.column("_f"), width)
            # Of equal vectors only the first can be a best match.
            _, first = np.unique(np.column_stack([b[0], b[1], b[3]]), axis=0, return_index=True)
            first = np.sort(first)
            b = tuple(part[first] for part in b)
            with np.errstate(all="ignore"):
                x, y = (side[0] / np.where(side[2] == 0, 1.0, side[2])[:, None] for side in (a, b))
                for start in range(0, len(x), AT_ONCE):
                    scores = x[start : start + AT_ONCE] @ y.T
                    odd = np.isnan(scores)
                    best = np.where(odd, -np.inf, scores).max(axis=1)
                    near = odd | (scores >= np.maximum(best, least)[:, None] - ROUNDING)
                    i, j = np.nonzero(near)
                    for at in range(0, len(i), EXACT_AT_ONCE):
                        u, v = i[at : at + EXACT_AT_ONCE] + start, j[at : at + EXACT_AT_ONCE]
                        exact = exact_cosines(a, b, u, v)
                        # Of one gold fact's equal similarities the first stays.
                        order = np.lexsort((v, exact, u))
                        u, v, exact = u[order], v[order], exact[order]
                        same = (u[1:] == u[:-1]) & ((exact[1:] == exact[:-1]) | (np.isnan(exact[1:]) & np.isnan(exact[:-1])))
                        keep = np.append(True, ~same)
                        picked.append((u[keep], first[v[keep]], exact[keep]))
        u, v, exact = (np.concatenate(p) for p in zip(*picked, strict=True))
        columns = [side.column(c).take(pa.array(n, pa.int64())) for side, names, n in ((golds, from_gold, u), (facts, from_found, v)) for c in names]
        return pa.table([*columns, pa.array(exact, pa.float64())], names=[*from_gold, *from_found, "similarity"])

    told = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, names in ((left, from_gold), (right, from_found)) for c in names)
    near = left.groupBy("episode_id", "_a", "_b").cogroup(right.groupBy("episode_id", "_a", "_b")).applyInArrow(run, f"{told}, similarity double")
    pairs = near.withColumn("similarity", F.round("similarity", 9)).where(F.col("similarity") >= least)
    order = Window.partitionBy("gold_id").orderBy(F.desc("similarity"), "_source", "seq")
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("gold_id", "gold_type", "episode_id", "type", "statement", "similarity")


def recall_by_type(gold: DataFrame, matches: DataFrame) -> DataFrame:
    """type, gold, matched (type right too), mistyped, recall."""
    joined = gold.select(F.col("id").alias("gold_id"), "type").join(matches.select("gold_id", F.col("type").alias("_found")), "gold_id", "left")
    out = joined.groupBy("type").agg(F.count(F.lit(1)).alias("gold"), F.count_if(F.col("_found") == F.col("type")).alias("matched"), F.count_if(F.col("_found") != F.col("type")).alias("mistyped"))
    return out.withColumn("recall", ratio(F.col("matched"), F.col("gold"), 1.0))


def extraction_score(by_type: DataFrame, proposed: int, grounding_issues: int) -> DataFrame:
    """One row: gold, strict_recall, content_recall (any type), grounding_reject_rate (issues, not facts, over proposed facts)."""
    total = by_type.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "matched", "mistyped")])
    strict, content = ratio(F.col("matched"), F.col("gold"), 1.0), ratio(F.col("matched") + F.col("mistyped"), F.col("gold"), 1.0)
    return total.select("gold", strict.alias("strict_recall"), content.alias("content_recall"), ratio(F.lit(grounding_issues), F.lit(proposed), 0.0).alias("grounding_reject_rate"))


def violations(answer: Column, forbidden: Column, not_leading: Column) -> Column:
    """Forbidden phrases that the answer has, and phrases that it must not lead with but does."""
    has = F.filter(forbidden, lambda p: F.contains(F.lower(answer), F.lower(p)))
    leads = F.filter(not_leading, lambda p: F.contains(F.lower(opening_sentence(answer)), F.lower(p)))
    return F.concat(has, F.transform(leads, lambda p: F.concat(F.lit("leads with '"), p, F.lit("'"))))


def verdict(answer: Column, refused: Column, expected: Column, no_answer: Column, broken: Column, similarity: Column, cited: Column) -> Column:
    """FORBIDDEN before all; where the key has no answer only a refusal passes; then MISSED, UNSUPPORTED, PASS."""
    on_target = (F.when(refused, 0.0).otherwise(similarity) >= ON_TARGET_SIMILARITY) | (term_coverage(answer, expected) >= ON_TARGET_COVERAGE)
    return (
        F.when(F.size(broken) > 0, "FORBIDDEN")
        .when(no_answer, F.when(refused, "PASS").otherwise("FORBIDDEN"))
        .when(refused | ~on_target, "MISSED")
        .when(F.size(cited) == 0, "UNSUPPORTED")
        .otherwise("PASS")
    )


def grade(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions (gold_questions()) with answers (id, answer, refused, n_cards, similarity): id, verdict, similarity, violations, citations
    (numbers of given cards only), n_cards."""
    rows = questions.join(answers, "id")
    text = F.coalesce("answer", F.lit(""))
    broken = violations(text, F.col("must_not_say"), F.col("must_not_lead_with"))
    cited = F.filter(citations(text), lambda n: (n >= 1) & (n <= F.col("n_cards")))
    judged = verdict(text, F.col("refused"), F.col("expected"), F.size("expected_facts") == 0, broken, F.col("similarity"), cited)
    return rows.select("id", judged.alias("verdict"), "similarity", broken.alias("violations"), cited.alias("citations"), "n_cards")


def verdict_histogram(graded: DataFrame) -> DataFrame:
    return graded.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def pass_rate(graded: DataFrame) -> DataFrame:
    """One row: n, passed, rate (1 of nothing)."""
    return graded.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "PASS").alias("passed")).withColumn("rate", ratio(F.col("passed"), F.col("n"), 1.0))


