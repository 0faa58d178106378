"""Token counts by a count-only Viterbi search (operator 7).

A unigram tokenizer picks, for each word, the pieces of its vocabulary with the greatest sum of scores. Only the number of pieces and the sum
are kept: an Aho-Corasick automaton gives all vocabulary matches by the place where they end, longest first, and for each place the best
sum and its number of pieces are carried on. Rules of the tokenizers library's Unigram model hold exactly: sums are double precision in the
same order; a later match replaces an earlier one only if its sum is greater, so of equal sums the one whose last piece starts first
stays; a character without a piece of its own may be unknown at 10 below the least score; unknown characters count as their UTF-8
bytes with byte fallback, else a run of them counts once.

Words: split at Unicode white space, each given a leading U+2581, and split before every further U+2581 (WhitespaceSplit, then Metaspace).
The vocabulary (tens of thousands of pieces; its size is checked) is broadcast. Counts of words are remembered per task, up to
REMEMBERED words. One pass, no shuffle.

Nulls and edges: a null or empty text has 0 tokens; a null id stays. Rows stay rows. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED, MOST_PIECES = 300_000, 1 << 20
SPACE = "▁"
WORDS = re.compile("[^\t-\r \x85\xa0  -     　]+")
#: str.split() also cuts at these, which are no white space in Unicode.
SEPARATORS = re.compile("[\x1c-\x1f]")
UNKNOWN_PENALTY = 10.0

Vocabulary = list[tuple[str, float]]


def sentencepiece_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: Vocabulary, byte_fallback: bool, unknown_id: int = 0) -> None:
        self.automaton, self.known = ahocorasick.Automaton(), {}
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown_id))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.automaton for b in range(256))

    def piece_count(self, word: str) -> tuple[int, float]:
        """Number of pieces and sum of scores of the best path over one word."""
        n = len(word)
        score, count, reached = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        run, before = [0] * (n + 1), [0] * (n + 1)  # bytes of the unknown run that ends here, and pieces before it
        reached[0] = True

        def offer(start: int, end: int, own: float, unknown: bool) -> None:
            s = own + score[start]
            if reached[end] and s <= score[end]:
                return
            score[end], reached[end], run[end] = s, True, 0
            if not unknown:
                count[end] = count[start] + 1
                return
            before[end] = before[start] if run[start] else count[start]
            run[end] = run[start] + len(word[start:end].encode())
            whole = not self.bytes or (end - start > 1 and not run[start])  # the unknown piece itself, spelt out
            count[end] = before[end] + (1 if whole else run[end])

        at, single = 0, False  # places up to at are final; single: at + 1 is the end of a one-character piece
        for last, (length, own, unknown) in self.automaton.iter(word):
            while at < last:
                if not single:
                    offer(at, at + 1, self.unknown, True)
                at, single = at + 1, False
            offer(last + 1 - length, last + 1, own, unknown)
            single |= length == 1
        while at < n:
            if not single:
                offer(at, at + 1, self.unknown, True)
            at, single = at + 1, False
        return count[n], score[n]

    def word(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            parts = [self.piece_count(p) for p in re.findall(f"{SPACE}[^{SPACE}]*", word if word[0] == SPACE else SPACE + word)]
            found = self.known[word] = sum(p[0] for p in parts), sum(p[1] for p in parts)
        return found

    def text(self, text: str) -> tuple[int, int, float]:
        """Words, tokens and sum of scores."""
        words, tokens, score, n = 0, 0, 0.0, len(text)
        start = 0
        while start < n:
            stop = min(start + (1 << 20), n)
            while stop < n and WORDS.match(text, stop):
                stop += 1
            part = text[start:stop] if start or stop < n else text
            for w in WORDS.findall(part) if SEPARATORS.search(part) else part.split():
                found = self.known.get(w) or self.word(w)
                words, tokens, score = words + 1, tokens + found[0], score + found[1]
            start = stop
        return words, tokens, score


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_tokens, score) for each row of docs."""
    if len(vocabulary) > MOST_PIECES:
        raise ValueError(f"the vocabulary has {len(vocabulary)} pieces; {MOST_PIECES} at most are broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, byte_fallback)
        for batch in batches:
            found = [counter.text(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_words", "n_tokens", "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, n_words long, n_tokens long, score double")
