"""Substring dedup by difference-cover anchors (operator 10).

Words are what white space separates, unchanged. A window is `window` (50) consecutive words of one document. A word goes if some window
that covers it also starts in a document with a smaller doc_id; windows are judged on the input.

Anchors: the positions p with p mod PERIOD in COVER, a difference cover: for any two positions i and j there is a shift d < PERIOD for which
i + d and j + d are both anchors. So two equal windows, wherever they start, contain an equal aligned anchor of
window - PERIOD + 1 words. Only anchors are hashed and exchanged in the first step (5 of 21 positions); the extension then looks at
the windows around shared anchors alone.

Steps, all in one plan (the exchange of the texts is made once and read three times):

 1. texts are dealt into buckets by doc_id; each bucket sends its anchors' hashes, each once, with a mark if several of its own documents
    hold it;
 2. a window over each hash finds those that several documents hold, and sends them back to the buckets that hold them;
 3. each bucket extends: for all windows that contain a shared anchor it sends the window's 128-bit hash with the least doc_id it has for it;
 4. the least doc_id over all buckets is found, a window again, and a bucket is told the numbers of its windows that a smaller doc_id has;
 5. each bucket removes the words that such windows cover, and those that a smaller doc_id of its own has.

A passage that a third of all documents share costs one row per bucket and hash, not one per document, and pairs of documents are never
made. Hashes are rows of (hash, bucket), sorted and spilled by Spark, as many as there are anchors (one for some 25 bytes of text) at any size
of the table. Python holds one bucket of documents, whose size does not grow.

Nulls and edges: null text has no words. Rows with null doc_id count as greater than all others and don't remove words of each other; rows
that share a doc_id don't either. A text of fewer than 50 words keeps all. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolore.llm.common import give_back, words_in_blocks

#: A perfect difference set modulo 21: every difference occurs.
PERIOD, COVER = 21, (0, 1, 6, 8, 18)
#: A bucket's rows and bytes of text, about, the buckets for each core at least, and the partitions that buckets are dealt over at most.
BUCKET_ROWS, BUCKET_BYTES, BUCKETS_A_CORE, PARTITIONS = 8192, 8 << 20, 4, 20_000
#: Words whose hashes a task remembers.
REMEMBERED = 100_000
NO_ID = np.iinfo(np.int64).max
B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


class Hasher:
    """Word hashes, and polynomial hashes modulo 2^64 of all runs of so many words of a text, by running sums."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, text: bytes | None) -> np.ndarray:
        parts, known, digest = [], self.words, xxhash.xxh64_intdigest
        for words in words_in_blocks(text or b""):
            if len(known) > REMEMBERED:
                known.clear()
            try:
                parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            except KeyError:
                for w in words:
                    if w not in known:
                        known[w] = digest(w)
                parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def runs(self, words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
        """Hash of words[i : i + length] for each i, the same wherever the run stands."""
        n = len(words)
        if n < length:
            return np.zeros(0, np.uint64)
        up, down = self.tables.get(int(base), (np.zeros(0, np.uint64),) * 2)
        if len(up) < n + 1:
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            up, down = self.tables[int(base)] = powers(base, 2 * n + 64), powers(inverse, 2 * n + 64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down[:n], dtype=np.uint64)])
        return mixed((sums[length:] - sums[:-length]) * up[: n - length + 1])


def anchor_places(n: int, length: int) -> np.ndarray:
    """Cover positions at which a run of so many words starts."""
    at = np.arange(max(0, n - length + 1))
    return at[np.isin(at % PERIOD, COVER)]


def ids_of(docs: pd.DataFrame) -> np.ndarray:
    return docs["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)


def send_anchors(docs: pd.DataFrame, length: int) -> pd.DataFrame:
    """bucket, h, several: each anchor hash of the bucket once; several tells whether several of its documents hold it."""
    hasher, hashes, owners = Hasher(), [], []
    for doc_id, text in zip(ids_of(docs), docs["text"], strict=True):
        words = hasher.of(text)
        found = np.unique(hasher.runs(words, length, B1)[anchor_places(len(words), length)])
        hashes.append(found)
        owners.append(np.full(len(found), doc_id))
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(h)] - 1 if len(h) else first
    return pd.DataFrame({"bucket": np.full(len(first), docs["bucket"].iloc[0], np.int32), "h": h[first].view(np.int64), "several": owner[first] != owner[last]})


def near_anchor(hasher: Hasher, words: np.ndarray, shared: np.ndarray, window: int, length: int) -> np.ndarray:
    """Starts of the windows of a text that contain a shared anchor."""
    n, at = len(words), anchor_places(len(words), length)
    if n < window or not len(shared):
        return np.zeros(0, np.int64)
    h = hasher.runs(words, length, B1)[at]
    place = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
    at = at[shared[place] == h]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.maximum(at - (window - length), 0), 1)
    np.add.at(edges, at + 1, -1)
    starts = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
    return starts[starts <= n - window]


def windows(docs: pd.DataFrame, shared: np.ndarray, window: int, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row number, doc_id, starts and two hashes of the windows of each document that contain one of the shared anchors (sorted)."""
    hasher = Hasher()
    for row, (doc_id, text) in enumerate(zip(ids_of(docs), docs["text"], strict=True)):
        words = hasher.of(text)
        starts = near_anchor(hasher, words, shared, window, length)
        if len(starts):
            yield row, doc_id, starts, hasher.runs(words, window, B1)[starts], hasher.runs(words, window, B2)[starts]


ANCHOR, WINDOW = 0, 1
SENT = "bucket int, kind int, h1 long, h2 long, owner long, number int"


def different(found: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different windows of windows(), in the order of their hashes: both hashes and the least doc_id that has it; and for each window
    found its doc_id and its number among the different ones."""
    none = np.zeros(0, np.uint64)
    own = np.concatenate([np.zeros(0, np.int64), *[np.full(len(s), doc_id) for _, doc_id, s, _, _ in found]])
    h1, h2 = (np.concatenate([none, *[f[i] for f in found]]) for i in (3, 4))
    order = np.lexsort((own, h2, h1))
    a, b = h1[order], h2[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first) - 1
    return a[first], b[first], own[order][first], own, number


def send_windows(docs: pd.DataFrame, anchors: pd.DataFrame, window: int, length: int) -> pd.DataFrame:
    """SENT: each window of the bucket with a shared anchor once (h1 and h2: its hash) with the least doc_id that has it and its number,
    and the shared anchors themselves (h1), for the last step."""
    shared = np.sort(anchors["h"].to_numpy(np.int64).view(np.uint64))
    found = list(windows(docs, shared, window, length)) if len(docs) else []
    h1, h2, owner, _, _ = different(found)
    if not found:
        shared = shared[:0]
    n, more = len(h1), len(shared)
    bucket = docs["bucket"].iloc[0] if len(docs) else 0
    columns = {
        "bucket": np.full(n + more, bucket, np.int32),
        "kind": np.repeat(np.array([WINDOW, ANCHOR], np.int32), [n, more]),
        "h1": np.r_[h1, shared].view(np.int64),
        # An anchor's second number only keeps the rows of many buckets apart.
        "h2": np.r_[h2.view(np.int64), np.full(more, bucket, np.int64)],
        "owner": np.r_[owner, np.zeros(more, np.int64)],
        "number": np.r_[np.arange(n, dtype=np.int32), np.zeros(more, np.int32)],
    }
    return pd.DataFrame(columns)


def removed_words(docs: pd.DataFrame, anchors: np.ndarray, told: np.ndarray, window: int, length: int) -> dict[int, np.ndarray]:
    """For each row of the bucket that loses words: a mark for each word, true if it goes. told: numbers of windows that another bucket has
    with a smaller doc_id than any here."""
    found = list(windows(docs, np.sort(anchors.view(np.uint64)), window, length))
    if not found:
        return {}
    _, _, owner, own, number = different(found)
    elsewhere = np.zeros(len(owner), bool)
    elsewhere[told] = True
    gone = elsewhere[number] | (own > owner[number])
    out, at = {}, 0
    for row, _, starts, _, _ in found:
        lost = starts[gone[at : at + len(starts)]]
        at += len(starts)
        if len(lost):
            n = int(starts[-1]) + window
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, lost, 1)
            np.add.at(edges, lost + window, -1)
            out[row] = np.cumsum(edges)[:-1] > 0
    return out


def finish(docs: pd.DataFrame, lost: dict[int, np.ndarray], keep_text: bool) -> pd.DataFrame:
    rows = []
    for row, (doc_id, text) in enumerate(zip(docs["doc_id"], docs["text"], strict=True)):
        mark, n, at, kept, digest, any_kept = lost.get(row), 0, 0, [], hashlib.sha256(), False
        for words in words_in_blocks(text or b""):
            at, n = n, n + len(words)
            if mark is not None:
                own = mark[at:n]
                words = [w for w, gone in zip(words, own, strict=False) if not gone] + words[len(own) :]
            if words:
                part = b" ".join(words)
                digest.update(b" " + part if any_kept else part)
                any_kept = True
                if keep_text and mark is not None:
                    kept.append(part)
        gone = int(mark[:n].sum()) if mark is not None else 0
        out = (b" ".join(kept) if mark is not None else text) if keep_text else None
        rows.append((doc_id, n, gone, digest.hexdigest(), out))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]).astype({"doc_id": "Int64", "n_words": "int64", "n_removed": "int64"})


def and_give_back(out: pd.DataFrame) -> pd.DataFrame:
    """out, once what else a bucket held is given back."""
    give_back()
    return out


def remove_repeats(docs: DataFrame, window: int = 50, keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (the text as it was, or what is left of it, joined by spaces; null
    unless keep_text), and the columns carry."""
    length = window - PERIOD + 1
    if length < 1:
        raise ValueError(f"a window has at least {PERIOD} words")
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, math.ceil(rows / BUCKET_ROWS), math.ceil(size / BUCKET_BYTES), min(BUCKETS_A_CORE * cores, rows))
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried") if carry else F.lit(None).cast("int").alias("carried")
    bucket = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(buckets)).cast("int")
    dealt = docs.select(bucket.alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), carried).repartition(min(buckets, PARTITIONS), "bucket")
    text = dealt.groupBy("bucket")
    sent = text.applyInPandas(lambda d: and_give_back(send_anchors(d, length)), "bucket int, h long, several boolean")
    same = Window.partitionBy("h")
    shared = sent.withColumn("n", F.count(F.lit(1)).over(same)).withColumn("any", F.max("several").over(same)).where("n > 1 OR any").select("bucket", "h")
    asked = text.cogroup(shared.groupBy("bucket")).applyInPandas(lambda d, a: and_give_back(send_windows(d, a, window, length)), SENT)
    smallest = F.min("owner").over(Window.partitionBy("kind", "h1", "h2"))
    answers = asked.withColumn("least", smallest).where(f"kind = {ANCHOR} OR least < owner")
    answers = answers.select("bucket", "kind", F.when(F.col("kind") == ANCHOR, F.col("h1")).otherwise(F.col("number")).alias("h"))
    out_type = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    if carry:
        out_type += f", carried {dealt.schema['carried'].dataType.simpleString()}"

    def end(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return finish(d, {}, keep_text)
        kind, h = a["kind"].to_numpy(), a["h"].to_numpy(np.int64)
        out = finish(d, removed_words(d, h[kind == ANCHOR], h[kind == WINDOW], window, length), keep_text)
        return and_give_back(out.assign(carried=d["carried"].to_numpy()) if carry else out)

    done = text.cogroup(answers.groupBy("bucket")).applyInPandas(end, out_type)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept"), *([F.col("carried")[c].alias(c) for c in carry] if carry else []))


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs without the words that remove_repeats() removes; a text that loses none stays as it is, and a row that loses all of its words
    goes. Where n_chars is a column, it is told anew for changed texts."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = remove_repeats(docs, window, keep_text=True, carry=others).where("n_removed = 0 OR n_removed < n_words")
    told = {"text": F.col("kept")} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in others else {})
    return left.select(*[told.get(c, F.col(c)).alias(c) for c in docs.columns])
