"""Best-fit packing by minimum bin slack (operator 9).

A document's ids are those of the tokenizer without special tokens, then end_id. Only documents over `capacity` ids are cut, into pieces of
that many; a piece is packed whole.

Plan: pieces are packed by length alone, so the histogram of lengths (at most `capacity` numbers, whatever the table's size) is all the
driver sees. For each sequence the longest piece left is taken, and a subset-sum dynamic programme over the lengths left, a Python integer as
its bit set, finds the fullest combination with it; the programme runs from long to short and stops as soon as the sequence is full.
The combination is taken out as often as its lengths last, so a table of any size needs a few thousand steps.

Place: pieces get ranks within their length, by buckets, so a length that a third of all pieces have is no single task; a rank
then finds its sequence and offset in the plan by binary search.

Tokens of a text are those of its white-space separated words one by one where the tokenizer's own settings say that it takes no account of
white space and of case and never joins over white space (wordwise()); a task's different words are then tokenized once, while they fit what it
remembers, so batches can be small. Any other tokenizer gets whole texts.

Nulls and edges: a null text is empty, its one piece is end_id. Repeated rows are packed as rows of their own; a null id stays. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolore.llm.common import balanced_buckets, cut, given_back, ranked, small_batches

#: Words that are tokenized as one text, and what stands between them.
TOGETHER, MARK = 512, "\x01"
#: Rows of a batch of texts; bytes of words that a task remembers with their ids.
BATCH, REMEMBERED = 2_000, 4 << 20
#: Fixed value: expressions whose matches, the only text that is kept, hold no white space; each word's matches are found without its neighbours.
SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: Ranks below 2^RANK_BITS and lengths share a 64-bit key.
RANK_BITS = 44


def wordwise(config: dict, mark_ids: list[int]) -> bool:
    """Whether a text's ids are those of its words one by one, whatever the white space between them and the case of ASCII letters: text is
    lower-cased, cut at white space by the pre-tokenizer's expression, no special token is written without "<|", and MARK is one id."""
    normalizers = (config.get("normalizer") or {}).get("normalizers", [])
    first = next(iter((config.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and str(first.get("pattern", {}).get("Regex", "")) in SPLITS
    special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in config.get("added_tokens", []))
    lower = any(n["type"] == "Lowercase" for n in normalizers) and all(n["type"] in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": "\\s+"} and n["content"] == " " for n in normalizers)
    return bool(lower and split and special and config.get("post_processor") is None and len(mark_ids) == 1)


class WordTokens:
    """ids of texts, by their words if the tokenizer is wordwise(), else of whole texts. The words of a batch are made a dictionary by Arrow, each word that isn't remembered from the
    batches before is tokenized once, and the texts' ids are gathered by number."""

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark, self.wordwise = mark[0] if mark else None, wordwise(json.loads(tokenizer), mark)
        self.known: pa.Array | None = None
        self.found = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the words, and where those of each word start and how many they are. Many words make one text for the tokenizer, with a
        control character between them, which is one id and no part of any word's ids."""
        lengths = np.zeros(len(words), np.int64)
        alone = pc.or_(pc.match_substring(words, MARK), pc.equal(words, "")).to_numpy(zero_copy_only=False)
        plain, ids = np.flatnonzero(~alone), []
        for i in range(0, len(plain), TOGETHER * 64):
            at = plain[i : i + TOGETHER * 64]
            own = words.take(pa.array(at)).to_pylist()
            for n, found in enumerate(self.encode([f" {MARK} ".join(own[j : j + TOGETHER]) for j in range(0, len(own), TOGETHER)])):
                cuts = np.flatnonzero(found == self.mark)
                lengths[at[n * TOGETHER : (n + 1) * TOGETHER]] = np.diff(np.r_[-1, cuts, len(found)]) - 1
                ids.append(np.delete(found, cuts))
        marked = np.flatnonzero(alone)
        for n, found in zip(marked, self.encode(words.take(pa.array(marked)).to_pylist()), strict=True):
            lengths[n] = len(found)
            ids.append(found)
        order = np.r_[plain, marked]
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), starts, lengths

    def remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """look_up() of different words, with those of the calls before taken from what is remembered; beyond REMEMBERED bytes all is forgotten."""
        if self.known is None or self.known.nbytes > REMEMBERED:
            self.known, self.found = words.slice(0, 0), tuple(x[:0] for x in self.found)
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        ids, starts, lengths = self.look_up(new)
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.found = tuple(np.concatenate(x) for x in zip(self.found, (ids, starts + len(self.found[0]), lengths), strict=True))
        ids, starts, lengths = self.found
        return ids, starts[place], lengths[place]

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """ids of each text (strings without null)."""
        if not self.wordwise:
            for at in range(0, len(texts), TOGETHER):
                yield from self.encode(texts.slice(at, TOGETHER).to_pylist())
            return
        # The tokenizer takes no account of case, but for special tokens, which are spelt with "<|".
        folded = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(folded)
        words = split.flatten().dictionary_encode()
        ids, starts, lengths = self.remembered(words.dictionary)
        number, ends = words.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
        for a, b in itertools.pairwise(ends):
            own = number[a:b]
            n = lengths[own]
            stops = np.cumsum(n)
            yield ids[np.repeat(starts[own] - stops + n, n) + np.arange(stops[-1] if len(stops) else 0)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary)."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(shared.value)
        for batch in batches:
            out = []
            for doc_id, found in zip(batch.column(0).to_pylist(), tokens.ids(batch.column(1)), strict=True):
                ids = np.append(found, np.asarray(end_id, "<u4")).tobytes()
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of the longest length left with others that leaves least slack: length to number."""
    longest = max(counts)
    room, chosen = capacity - longest, {longest: 1}
    reach, steps = 1, []
    full, mask = 1 << room, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        most = min(counts[length] - (length == longest), room // length)
        if most <= 0:
            continue
        steps.append((length, most, reach))
        step = 1
        while most:
            step = min(step, most)
            reach |= reach << (step * length) & mask
            most -= step
            step *= 2
        if reach & full:
            break
    left = reach.bit_length() - 1
    for length, most, before in reversed(steps):
        n = next(n for n in range(most + 1) if left >= n * length and before >> (left - n * length) & 1)
        if n:
            chosen[length] = chosen.get(length, 0) + n
            left -= n * length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How often to make which sequence: (times, {length: number})."""
    left, made = dict(counts), []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[length] // n for length, n in chosen.items())
        made.append((times, chosen))
        for length, n in chosen.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return made


def table_of(made: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """The plan by length and rank: rows (key of length and first rank, first rank, first sequence, number in a sequence, offset)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, chosen in made:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            rank = used.get(length, 0)
            rows.append((length << RANK_BITS | rank, rank, sequence, n, offset))
            used[length] = rank + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with small_batches(docs.sparkSession, BATCH):
        cutted = cut(pieces(docs, Path(tokenizer_path).read_text(), capacity, end_id).drop("ids"))
    counts = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(table_of(plan(counts, capacity)))

    @given_back
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, number, offset = shared.value.T
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(key, length << RANK_BITS | rank, side="right") - 1
            more, place_in = np.divmod(rank - first[at], number[at])
            placed = [pa.array(sequence[at] + more), pa.array(offset[at] + place_in * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *placed], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    numbered = ranked(cutted, ["length"], order, order, balanced_buckets(sum(counts.values())), "rank")
    rows = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
