"""The pipeline's stages, each on its own input, against plain versions."""

import re
from collections import Counter

import corpus_pipeline
from conftest import SF
from test_operators import NEAR, plain_repeats, plain_targets

from chronolore.llm import toxicity


def stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame(stage(spark, out[-1], SF).collect(), stage(spark, out[-1], SF).schema))
    return out


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def joined(n, linked):
    """For each of n the least that a chain of links joins it to."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, traps):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in (documents, traps):
        raw, clean, single, cut, mixed, packed = stages(spark, docs)
        model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        assert Counter(texts(clean)) == Counter(x for x in texts(raw) if model.score((x[1] or "").encode()) < 0.5)

        # The stage links at a five-word similarity of 0.8 or more, counted exactly: as one plain pass over all pairs does.
        rows = texts(clean)
        sets = [shingles(t) for _, t in rows]
        roots = joined(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
        groups = {}
        for row, root in zip(rows, roots, strict=True):
            groups.setdefault(root, []).append(row)
        kept = texts(single)
        assert len(kept) == len(groups)
        ids = lambda x: [i for i, _ in x if i is not None]
        assert Counter(ids(kept)) == Counter(min(ids(g)) for g in groups.values() if ids(g))
        assert not Counter(kept) - Counter(rows)

        after = dict(texts(cut))
        for doc_id, n, gone, _ in plain_repeats(kept, 50):
            if gone == n and n:
                assert doc_id not in after
            else:
                assert len((after[doc_id] or "").encode().split()) == n - gone

        # Each document is in the mix at most twice, from its first word on; sources come near their targets, but for whole copies' ends.
        words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
        given, source, got = Counter(), Counter(), Counter()
        for r in cut.collect():
            given[r["doc_id"], r["source"], " ".join(words(r["text"]))] += 1
            source[r["source"]] += len(words(r["text"]))
        for r in mixed.collect():
            got[r["source"]] += len(words(r["text"]))
            whole = [g for g in given if g[:2] == (r["doc_id"], r["source"]) and g[2].startswith(" ".join(words(r["text"])))]
            assert whole
        assert max(Counter((r["doc_id"], r["text"]) for r in mixed.collect()).values(), default=0) <= 2 * max(given.values(), default=1)
        for s, target in plain_targets(dict(source)).items():
            assert abs(got[s] - target) <= NEAR or not source[s]
        # All ids of the mix are packed, in sequences of at most 2048.
        rows = packed.collect()
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
        room = Counter()
        for r in rows:
            room[r["sequence_id"]] += r["length"]
        assert max(room.values(), default=0) <= 2048 and len(room) <= sum(room.values()) / 2048 * 1.02 + 2
        for before, later in ((raw, clean), (clean, single), (single, cut), (cut, mixed)):
            assert later.columns == before.columns


def test_empty(spark, traps):
    assert all(d.count() == 0 for d in stages(spark, traps.limit(0)))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
