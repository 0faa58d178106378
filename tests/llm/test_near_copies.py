"""Near copies by exact Jaccard similarity: pairs just below 0.8 stay, pairs at it or above go."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from test_operators import plain_similarity

from chronolore.llm import simhash
from chronolore.llm.common import given_back


def test_pairs_at_the_edge(spark):
    rng, texts, want = random.Random(5), [], set()
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for i in range(240):
        shared = rng.choice([70, 74, 76, 80, 82])
        base = [word() for _ in range(94)]
        # 90 shingles each, shared - 4 in common at the end of one and the start of the other.
        copy = base[94 - shared - 4 :] + [word() for _ in range(90 - shared)]
        texts += [" ".join(base), " ".join(copy)]
        if plain_similarity(*texts[-2:]) < 0.8:
            want.add(2 * i + 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert kept == want | set(range(0, 480, 2)) and 50 < len(want) < 190


def test_repeats_do_not_count(spark):
    """Sets of shingles are compared: repeated shingles don't hide what differs, nor tell apart what is equal."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line, tails = [word() for _ in range(12)], [[word() for _ in range(40)] for _ in range(2)]
    texts = [" ".join(line * 60 + tail) for tail in tails] + [" ".join(line * 3 + tails[0])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(df).collect()} == {0, 1}


def test_documents_against_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    root = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if root[i] != root[j] and plain_similarity(a, b) >= 0.8:
                old, new = sorted((root[i], root[j]), reverse=True)
                root = {x: new if r == old else r for x, r in root.items()}
    assert {r["doc_id"] for r in simhash.one_of_each(df).collect()} == set(root.values())


def test_large_groups_give_few_pairs(spark, monkeypatch):
    """Many texts alike by some 0.6 and many by 0.7 to 0.9, all of one passage: not each of their pairs is counted, and none is lost."""
    rng, seen = random.Random(8), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for own in (35, 9):
        base = [word() for _ in range(150)]
        texts += [" ".join(base[: 150 - own] + [word() for _ in range(max(1, own + rng.randint(-4, 4)))]) for _ in range(130)]
    count = simhash.alike

    def counted(edges, *more):
        seen.append(edges.count())
        return count(edges, *more)

    monkeypatch.setattr(simhash, "alike", counted)
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and plain_similarity(texts[i], texts[j]) >= 0.8:
                new, old = sorted((root[i], root[j]))
                root = [new if r == old else r for r in root]
    assert kept == set(root) and sum(seen) < 3 * len(texts)


def test_parity_is_a_lower_bound():
    """Maps differ in no more bits than their sets in hashes, whatever sizes meet, and tell unlike sets apart."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 15, 17, 100, 500, 520, 30_000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, 1 + len(s) // 9).astype(np.uint64)])) for s in sets]
    maps = simhash.ParityMaps(np.array([simhash.parity(s) for s in sets], object))
    everyone = np.arange(len(sets))
    for i in range(len(sets)):
        told, true = maps.differ(i, everyone), np.array([len(np.setxor1d(sets[i], s)) for s in sets])
        assert (told <= true).all() and (told == maps.differ(i, everyone[::-1])[::-1]).all()
        copy = (i + 8) % 16  # of nine tenths: at SPREAD bits a hash little is hidden
        assert told[copy] >= 0.8 * true[copy] - 2 or len(sets[i]) * simhash.SPREAD > simhash.MOST_BITS
    for size in np.unique(maps.size):
        place, words = maps.at[int(size)]
        for i in np.flatnonzero(maps.size >= size):
            odd = np.bincount((sets[i] % np.uint64(8 * size)).astype(int), minlength=8 * size) & 1
            assert words[place[i]].tobytes() == np.packbits(odd.astype(np.uint8)).tobytes()


def test_candidates_hold_one_matrix():
    """A tile within itself takes one mark a pair, and one more for a forest, whichever way its pairs are told."""
    n = 6000
    fixed = {"block": np.zeros(n), "side": np.zeros(n), "fp": np.arange(n), "n": np.full(n, 100), "label": np.arange(n), "bits0": np.zeros(n)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v.astype(np.int64)) for k, v in fixed.items()})
    for every, matrices in ((False, 2.2), (True, 1.2)):
        few = [p for b in simhash.candidates(iter([batch.slice(0, 70)]), 0.8, every) for p in zip(*b.to_pydict().values(), strict=True)]
        assert {x for p in few for x in p} == set(range(70)) and (not every or sorted(few) == [(i, j) for i in range(70) for j in range(i + 1, 70)])
        tracemalloc.start()
        next(simhash.candidates(iter([batch]), 0.8, every))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < matrices * n * n + 30_000_000


def test_kernels_give_memory_back():
    """What a kernel has freed is not kept by the worker when its batches end."""

    def anonymous():
        return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon"))

    def kernel(batches):
        for batch in batches:
            many = [np.ones(12_500) for _ in range(2000)]  # 200 MB
            pins.append(np.ones(12_500))  # keeps the C library from trimming what lies below
            yield len(many)

    pins, before = [], anonymous()
    assert list(given_back(kernel)(iter([1]))) == [2000]
    assert anonymous() - before < 50_000


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8])
def test_no_link_is_lost_at_any_similarity(spark, similarity):
    """Pairs on both sides of the threshold, of long and of very short texts: exactly those at it or above are linked."""
    rng, texts, want = random.Random(int(similarity * 10)), [], set()
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    middle = 2 * similarity / (1 + similarity)  # the share that two texts of one length have in common there
    for i in range(220):
        n = rng.choice([6, 9, 30, 90])
        shared = min(n, max(0, round(n * middle + rng.uniform(-0.08, 0.08) * n)))
        base = [word() for _ in range(n + 4)]
        texts += [" ".join(base), " ".join(base[n - shared :] + [word() for _ in range(n - shared)])]
        if plain_similarity(*texts[-2:]) < similarity:
            want.add(2 * i + 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df, similarity=similarity).collect()}
    assert kept == want | set(range(0, 440, 2)) and 40 < len(want) < 200


def test_bound_grows_as_similarity_falls():
    assert simhash.furthest(0.8, 256) == 96
    told = [simhash.furthest(s / 10, 256) for s in range(11)]
    assert told == sorted(told, reverse=True) and told[0] > 200 and simhash.furthest(1.0, 256) >= 0
