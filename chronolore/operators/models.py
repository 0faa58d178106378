"""Slots for models. Each is a plain function with a local, deterministic default; what a model makes is computed once per different text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolore import schemas
from chronolore.functions.dates import date_of, instant_of
from chronolore.functions.text import blank_to_null, clean_mention, is_blank, keywords, unwrap_fence

#: Texts to vectors of one length.
Embedder = Callable[[list[str]], np.ndarray]
#: Prompts to answers.
Chat = Callable[[list[str]], list[str]]

#: Prompts to answers that tell their cost: dicts with answer, input_tokens, output_tokens.
CountingChat = Callable[[list[str]], list[dict]]

DIMENSIONS, NOT_FOUND = 256, "NOT_IN_KNOWLEDGE_BASE"
#: Characters that count as a token where no model tells; times that a failing model is asked.
CHARACTERS_A_TOKEN, TRIES = 4, 3


def hashing_embedder(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Words and their three-letter parts, hashed with signs to a unit vector. A blank text is zero."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in (text or "").lower().split():
            padded = f"^{word}$"
            for part in [word, *(padded[i : i + 3] for i in range(len(padded) - 2))]:
                h = xxhash.xxh64_intdigest(part)
                row[h % dimensions] += 1 if h >> 63 else -1
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(lengths > 0, lengths, 1)


def refusing_chat(prompts: list[str]) -> list[str]:
    """The model that knows nothing."""
    return [NOT_FOUND for _ in prompts]


def embed(rows: DataFrame, text: str, embedder: Embedder = hashing_embedder, column: str = "embedding") -> DataFrame:
    """rows with a vector for each text; a text that occurs often is embedded once. Null for null."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(embedder(part.tolist())))

    different = rows.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct().withColumn(column, vectors("_text"))
    return rows.join(different, rows[text] == different["_text"], "left").drop("_text")


def ask(prompts: DataFrame, prompt: str, chat: Chat, column: str = "answer") -> DataFrame:
    """prompts with the model's answer to each different prompt."""

    @F.pandas_udf("string")
    def answers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(chat(part.tolist()))

    different = prompts.select(F.col(prompt).alias("_prompt")).distinct().withColumn(column, answers("_prompt"))
    return prompts.join(different, prompts[prompt] == different["_prompt"], "left").drop("_prompt")


def ask_counted(prompts: DataFrame, prompt: str, chat: CountingChat | Chat, column: str = "answer", tries: int = TRIES) -> DataFrame:
    """ask(), and call: what the answer cost: input_tokens and output_tokens as the model tells them (else its characters / CHARACTERS_A_TOKEN), milliseconds of all
    tries, tries, and failure (null if one of them was answered). A model that fails on each try gives a null answer and stops nothing."""

    @F.pandas_udf("answer string, input_tokens int, output_tokens int, milliseconds long, tries int, failure string")
    def calls(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part:
                start, said, failure, n = time.perf_counter(), None, None, 0
                while n < tries:
                    n += 1
                    try:
                        said, failure = chat([text])[0], None
                        break
                    except Exception as e:  # noqa: BLE001  a model may fail in any way
                        failure = f"{type(e).__name__}: {e}"
                told = said if isinstance(said, dict) else {"answer": said}
                guess = lambda t: -(-len(t or "") // CHARACTERS_A_TOKEN)
                rows.append((told["answer"], told.get("input_tokens", guess(text)), told.get("output_tokens", guess(told["answer"])), round(1000 * (time.perf_counter() - start)), n, failure))
            yield pd.DataFrame(rows, columns=["answer", "input_tokens", "output_tokens", "milliseconds", "tries", "failure"])

    different = prompts.select(F.col(prompt).alias("_prompt")).distinct().withColumn("call", calls("_prompt"))
    return prompts.join(different, prompts[prompt] == different["_prompt"], "left").drop("_prompt").withColumn(column, F.col("call.answer"))


def payload_facts(answers: DataFrame) -> DataFrame:
    """A model's answers (episode_id, occurred_at, answer) as extracted facts. What can't be read gives none; a fact of unknown type is left
    out, an unknown status is PROPOSED; quotes without place or words go."""
    parsed = answers.withColumn("_p", F.from_json(unwrap_fence(F.col("answer")), schemas.PAYLOAD)).select("episode_id", F.col("occurred_at").alias("_at"), F.explode("_p.facts").alias("f"))
    kind, status = F.upper(blank_to_null(F.col("f.type"))), F.upper(blank_to_null(F.col("f.status")))
    quotes = F.filter(F.coalesce("f.evidence", F.array().cast("array<struct<utterance:int,quote:string>>")), lambda e: (e["utterance"] >= 0) & ~is_blank(e["quote"]))
    empty = F.array().cast("array<string>")
    people = F.filter(F.transform(F.coalesce("f.participants", empty), clean_mention), lambda p: p.isNotNull())
    return parsed.where(kind.isin(list(schemas.REQUIRED_FIELDS))).select(
        "episode_id",
        kind.alias("type"),
        blank_to_null(F.col("f.statement")).alias("statement"),
        clean_mention(F.col("f.owner")).alias("owner_mention"),
        people.alias("participant_mentions"),
        F.coalesce(instant_of(F.col("f.occurredAt")), "_at").alias("occurred_at"),
        date_of(F.col("f.dueDate")).alias("due_date"),
        F.when(status.isin(schemas.STATUSES), status).otherwise("PROPOSED").alias("status"),
        F.coalesce("f.topics", empty).alias("topics"),
        F.transform(quotes, lambda e: F.struct(F.col("episode_id").alias("episode_id"), e["utterance"].alias("ordinal"), e["quote"].alias("span"))).alias("evidence"),
        F.coalesce("f.confidence", F.lit(0.0)).alias("confidence"),
    )


def marker_extractor(utterances: DataFrame) -> DataFrame:
    """The extractor without a model: an utterance that starts with a type's name and a colon ("Decision: ...") is that fact, quoted as it is.
    Returns extracted facts."""
    name, text = F.upper(F.regexp_replace(F.regexp_extract("text", r"(?i)^\s*(decision|action item|commitment|risk|open question)\s*:", 1), " +", "_")), F.regexp_replace("text", r"^[^:]*:\s*", "")
    empty = F.array().cast("array<string>")
    evidence = F.array(F.struct("episode_id", F.col("ordinal").alias("ordinal"), F.col("text").alias("span")))
    return utterances.withColumn("_type", name).where("_type <> ''").select(
        "episode_id", F.col("_type").alias("type"), text.alias("statement"), F.col("speaker").alias("owner_mention"), empty.alias("participant_mentions"), F.col("at").alias("occurred_at"),
        F.lit(None).cast("date").alias("due_date"), F.when(F.col("_type").isin("RISK", "OPEN_QUESTION"), "PROPOSED").otherwise("AGREED").alias("status"), F.slice(keywords(text), 1, 3).alias("topics"), evidence.alias("evidence"), F.lit(0.9).alias("confidence"),
    )
