"""SimHash near-duplicates by tiled exact comparison (operator 3).

Fingerprints: A-Z lower-cased, words cut at white space, shingles of shingle_words words joined by one space (repeats count; a shorter text
is one shingle; no word gives fingerprint 0). Bit b is 1 if set in over half of the shingles' XXH64 values, seed 42. A wide fingerprint
has further 64-bit parts, made in the same way of the hash values mixed once more for each part.

Links: two fingerprints link if they differ in at most radius bits. Equal fingerprints are joined first, so only different ones are
compared.

Blocks of 64-bit fingerprints lose no link: the bits are cut into segments, fingerprints within the radius agree in at least
segments - radius of them, so each fingerprint is dealt to one block per choice of that many segments and every link lies in some block.
The number of segments grows with the table (5 give 13-bit keys, 8 give 32-bit keys), which keeps blocks within a few tiles at any size.
Wide fingerprints of links(), for similarities far below 1, are dealt by the values of BAND-bit bands drawn over all bits, as many as give a pair at the
radius a chance of MISSED or less to share none; longer and more bands as the table grows. A pair that shares no block may still
be joined through others. one_of_each() does not use these: near_copies() finds and counts its pairs by their shingles.

Tiles: a block over tile rows is cut into tiles by population count (and by a hash within one count); two tiles are compared only if
their population counts differ by no more than the radius, as that difference is a lower bound of the distance. A pair of tiles is one
numpy exclusive-or and bit count of at most tile x tile values. From each pair only the edges of a spanning forest leave, so a group of
n copies gives about n rows, not n * n; components() joins them. Nothing is capped, sampled or collected.

Nulls and edges: a null text has no words; a null id links like another but is never a component's id (null if no member has one).
Repeated rows stay rows. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolore.llm.common import components, cut, delete, free_shuffles, given_back, shared_folder, small_batches, words_in_blocks

SEED, BAND, MISSED = 42, 12, 0.05
#: Rows of a few numbers that may be sent to every executor: some tens of MB.
BROADCAST = 500_000
#: near_copies(): documents sampled for shingles that are frequent, the documents among them that such a shingle is in, and how many
#: shingles are taken at most; sets that a task remembers; pairs of texts, and parity maps, of a batch.
SAMPLED, COMMON, MOST_FREQUENT, REMEMBERED, TEXTS_AT_ONCE, MAPS_AT_ONCE = 8000, 4, 100_000, 500, 500, 2000
#: Standard deviations that fingerprints of alike sets are given room for: see furthest().
DEVIATIONS = 10
#: parity(): bits for each hash of a set at least, and bits at most.
SPREAD, MOST_BITS = 4, 1 << 13
#: A different part of a wide fingerprint for each.
PARTS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(h: np.ndarray, part: int) -> np.ndarray:
    """The hash values of one part; those of part 0 are the hashes themselves."""
    if not part:
        return h
    h = (h ^ np.uint64(PARTS[part])) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: bytes | None, shingle_words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of one text in order, repeats included, in arrays."""
    n, digest = 0, xxhash.xxh64_intdigest
    kept: list[bytes] = []
    for words in words_in_blocks((text or b"").lower()):
        words = kept + words
        m = len(words) - shingle_words + 1
        if m > 0:
            yield np.fromiter((digest(b" ".join(words[i : i + shingle_words]), SEED) for i in range(m)), np.uint64, m)
            n += m
            words = words[m:]
        kept = words
    if not n and kept:
        yield np.array([digest(b" ".join(kept), SEED)], np.uint64)


def majority(arrays: Iterable[np.ndarray], parts: int) -> np.ndarray:
    """The fingerprint of hash values, 64 bits per part."""
    ones, n = np.zeros((parts, 64), np.int64), 0
    for hashes in arrays:
        n += len(hashes)
        for part in range(parts):
            ones[part] += np.unpackbits(mixed(hashes, part).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1).view(">u8")[:, 0].astype(np.uint64)


def fingerprint(text: bytes | None, shingle_words: int, parts: int = 1) -> np.ndarray:
    """The fingerprint of one text, 64 bits per part."""
    return majority(shingle_hashes(text, shingle_words), parts)


def shingle_set(text: bytes | None, shingle_words: int) -> np.ndarray:
    """The different shingle hashes of one text, in rising order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle_words)]))


def fingerprints(docs: DataFrame, shingle_words: int = 4, parts: int = 1) -> DataFrame:
    """Rows doc_id, key (a hash of the text), bits (array of longs, a part each) and fp: a long that stands for the fingerprint, of one part
    the 64 bits themselves."""

    @F.pandas_udf("array<long>")
    @given_back
    def bits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series([fingerprint(t, shingle_words, parts).view(np.int64) for t in text])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), bits(F.col("text").cast("binary")).alias("bits"))
    return rows.withColumn("fp", F.col("bits")[0] if parts == 1 else F.xxhash64("bits"))


def segments_for(rows: int, radius: int) -> int:
    """As many segments as make keys of about log2(rows) - 12 bits or more: blocks hold up to a tile of unrelated rows, as comparing them
    costs less than dealing each row to the blocks of more choices."""
    s = radius + 1
    while (s - radius) * (64 // s) < max(rows, 2).bit_length() - 12 and s < 2 * radius:
        s += 1
    return s


def segment_masks(segments: int, radius: int) -> list[int]:
    """A mask for each choice of segments - radius of the segments."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(parts, segments - radius)]


def band_masks(parts: int, radius: int, rows: int) -> list[list[int]]:
    """A mask per part for each band. Bands are drawn without repeating a bit as long as there are bits left."""
    width = 64 * parts
    length = max(BAND, max(rows, 2).bit_length() - 8)
    number = math.ceil(math.log(MISSED) / math.log1p(-((1 - radius / width) ** length)))
    rng = np.random.default_rng(SEED)
    drawn = np.concatenate([rng.permutation(width) for _ in range(math.ceil(number * length / width) + 1)])
    out = []
    for i in range(number):
        mask = [0] * parts
        for bit in drawn[i * length : (i + 1) * length].tolist():
            mask[bit // 64] |= 1 << (bit % 64)
        out.append(mask)
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that join what near (left x right, true for a link) joins. Breadth first over whole rows and columns of the matrix."""
    rows, cols = near.any(axis=1), near.any(axis=0)
    while rows.any():
        root = int(np.argmax(rows))
        rows[root] = False
        fresh = np.array([root])
        while len(fresh):
            to = near[fresh].any(axis=0) & cols
            cols &= ~to
            yield from ((int(left[root]), int(x)) for x in right[to])
            back = near[:, to].any(axis=1) & rows if to.any() else np.zeros_like(rows)
            rows &= ~back
            yield from ((int(left[root]), int(x)) for x in left[back])
            fresh = np.flatnonzero(back)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """All columns but the first of each block; a block may go on in the next batch."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        block, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        starts = np.flatnonzero(np.diff(block)) + 1
        for first, *parts in zip(np.r_[0, starts] if len(block) else [], *(np.split(c, starts) for c in columns), strict=False):
            if held and block[first] != last:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            last = block[first]
            held.append(parts)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def compare(batches: Iterator[pa.RecordBatch], radius: int, tile: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, fp, bits 0, bits 1, ...) sorted by block: edges (u, v) of fp of each block's pair of tiles. side 0 and 1 are the
    tiles; a block of side 0 alone is compared within itself."""

    def linked(side: np.ndarray, fp: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int]]:
        def tile_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ones = np.bitwise_count(bits[rows]).sum(axis=1, dtype=np.int64)
            order = np.argsort(ones, kind="stable")
            return ones[order], fp[rows][order], bits[rows][order]

        alone = not (side == 1).any()
        ones_a, a, x = tile_of(side == 0)
        ones_b, b, y = (ones_a, a, x) if alone else tile_of(side == 1)
        # Again in strips: rows of one strip meet only the columns whose population count is near enough.
        near = np.zeros((len(a), len(b)), bool)
        for i in range(0, len(a), 64):
            lo, hi = np.searchsorted(ones_b, [ones_a[i] - radius, ones_a[min(i + 64, len(a)) - 1] + radius + 1])
            far = np.zeros((len(a[i : i + 64]), hi - lo), np.uint16)
            for part in range(bits.shape[1]):
                far += np.bitwise_count(x[i : i + 64, part, None] ^ y[None, lo:hi, part])
            near[i : i + 64, lo:hi] = far <= radius
        if alone:
            np.fill_diagonal(near, False)
        if near.any():
            yield from forest(near, a, b)

    found: list[tuple[int, int]] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["u", "v"])
    for side, fp, *bits in blocks(batches):
        if len(fp) > 1:
            found += linked(side, fp, np.stack(bits, axis=1).view(np.uint64))
        if len(found) > 50_000:
            yield made()
            found = []
    yield made()


def links(distinct: DataFrame, rows: int, radius: int = 4, tile: int = 4096, parts: int = 1) -> DataFrame:
    """Edges (u, v) that join the different fingerprints (fp, bits) within the radius; rows is their number."""
    masks = [[m] for m in segment_masks(segments_for(rows, radius), radius)] if parts == 1 else band_masks(parts, radius, rows)
    masked: list[list[Column]] = [[F.col("bits")[part].bitwiseAND(F.lit(signed(m))) for part, m in enumerate(mask) if m] for mask in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), *columns) for i, columns in enumerate(masked)])
    ones = sum((F.bit_count(F.col("bits")[part]) for part in range(parts)), F.lit(0))
    dealt = distinct.select("fp", "bits", ones.cast("int").alias("ones"), F.explode(keys).alias("key"))
    flat = tiles(dealt, radius, tile).select("block", "side", "fp", *[F.col("bits")[part].alias(f"bits{part}") for part in range(parts)])
    laid = flat.repartition("block").sortWithinPartitions("block")
    return laid.mapInArrow(given_back(lambda batches: compare(batches, radius, tile)), "u long, v long")


def tiles(dealt: DataFrame, radius: int, tile: int) -> DataFrame:
    """dealt: key, fp, ones and others. Rows block, side and all but key and ones: blocks over a tile are cut into pairs of tiles."""
    rest = [c for c in dealt.columns if c not in ("key", "ones")]
    counts = dealt.groupBy("key", "ones").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array_sort(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))))
    # Blocks over a tile, with their population counts (at most one more than there are bits) and the tiles of each.
    large = counts.groupBy("key").agg(F.sum("n").alias("n"), cells.alias("cells")).where(F.col("n") > tile).select("key", "cells")
    met = dealt.join(large, "key", "left")
    own = F.filter("cells", lambda c: c["ones"] == F.col("ones"))[0]["tiles"]
    tile_no = F.pmod(F.xxhash64("fp", F.lit(1)), own)
    others = F.flatten(F.transform(F.filter("cells", lambda c: F.abs(c["ones"] - F.col("ones")) <= radius), lambda c: F.transform(F.sequence(F.lit(0), c["tiles"] - 1), lambda t: F.struct(c["ones"].alias("ones"), t.cast("long").alias("no")))))
    here = F.struct(F.col("ones").alias("ones"), F.col("no").alias("no"))
    tiled = met.where("cells IS NOT NULL").withColumn("no", tile_no).withColumn("other", F.explode(others))
    pair = F.xxhash64("key", F.least(here, F.col("other"))["ones"], F.least(here, F.col("other"))["no"], F.greatest(here, F.col("other"))["ones"], F.greatest(here, F.col("other"))["no"])
    tiled = tiled.select(pair.alias("block"), F.when(F.col("other") < here, 1).otherwise(0).alias("side"), *rest)
    plain = met.where("cells IS NULL").select(F.col("key").alias("block"), F.lit(0).alias("side"), *rest)
    return plain.unionByName(tiled)


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4, tile: int = 4096, parts: int = 1) -> DataFrame:
    """One row per document: doc_id, key, fp, label (a number of its component) and component_id, the least doc_id reachable over links."""
    marked = cut(fingerprints(docs, shingle_words, parts))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits")))
    label = components(links(distinct.select("fp", "bits"), distinct.count(), radius, tile, parts))
    rooted = distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    return marked.drop("bits").join(named(rooted), "fp").select("doc_id", "key", "fp", "label", "component_id")


def named(rooted: DataFrame) -> DataFrame:
    """fp, label, component_id of rows fp, least, label: the least of each label. Least values are merged before their shuffle and kept, so
    the join with a label of very many rows reads two plain exchanges, and adaptive execution splits the uneven one."""
    least = cut(rooted.groupBy("label").agg(F.min("least").alias("component_id")))
    return rooted.join(least, "label").select("fp", "label", "component_id")


def radius_of(similarity: float, bits: int) -> int:
    """The distance at which two sets of this Jaccard similarity lie on average, and one standard deviation more."""
    common = 2 * similarity / (1 + similarity)
    share = math.acos(common) / math.pi
    return round(bits * share + math.sqrt(bits * share * (1 - share)))


def parity(found: np.ndarray) -> bytes:
    """For each of a power of two of bits whether an odd number of a set's hashes end in its number. Two sets differ in as many hashes as
    their bits differ in, or in more. A half laid over the other (exclusive-or) is the map of half as many bits."""
    size = max(64, min(MOST_BITS, 1 << (SPREAD * len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class ParityMaps:
    """The parity() of several sets; two maps are compared at the smaller one's size."""

    def __init__(self, maps: np.ndarray):
        self.size = np.array([len(m) for m in maps])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.unique(self.size).tolist()
        for i, size in enumerate(sizes):
            groups = [np.flatnonzero(self.size == x) for x in sizes[i:]]
            place = np.full(len(maps), -1)
            place[np.concatenate(groups)] = np.arange(sum(map(len, groups)))
            self.at[size] = place, np.concatenate([np.bitwise_xor.reduce(np.frombuffer(b"".join(maps[g]), np.uint64).reshape(len(g), -1, size // 8), axis=1) for g in groups])

    def differ(self, one: int, others: np.ndarray) -> np.ndarray:
        """In how many bits the map of one differs from those of others."""
        out, shared = np.zeros(len(others), np.int64), np.minimum(self.size[others], self.size[one])
        for size in np.unique(shared).tolist():
            at, (place, words) = shared == size, self.at[size]
            out[at] = np.bitwise_count(words[place[one]] ^ words[place[others[at]]]).sum(axis=1, dtype=np.int64)
        return out


def furthest(similarity: float, bits: int) -> int:
    """How many bits the fingerprints of sets of at least this Jaccard similarity differ in at most, but for a chance of DEVIATIONS standard deviations. The
    vectors of two such sets are at an angle of arccos(2 s / (1 + s)) at most, and each bit differs with the chance of that angle over pi."""
    chance = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi if similarity > 0 else 0.5
    return min(bits, int(bits * chance + DEVIATIONS * math.sqrt(bits * chance * (1 - chance)) + (DEVIATIONS if similarity > 0.999 else 0)))


def candidates(batches: Iterator[pa.RecordBatch], similarity: float, every: bool) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, fp, n, label, bits 0, ..., and, if it is there, parity) sorted by block: pairs (u, v) of fp of different labels
    that may be alike by their set sizes n, their bits and their parity maps, which leave out no pair that is alike. With every all of them,
    without it a forest that joins what they join, of the pairs that differ least. What is held grows with the rows of a block only."""
    found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    made = lambda: pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(found, axis=1))), names=["u", "v"])
    pairs = 0
    for side, fp, n, label, *bits in blocks(batches):
        if len(fp) < 2 or (label == label[0]).all():
            continue
        maps = ParityMaps(bits.pop()) if bits[-1].dtype == object else None
        parts = np.stack(bits, axis=1).view(np.uint64)
        alone, bound = not (side == 1).any(), furthest(similarity, 64 * parts.shape[1])

        def near(one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Those of the others that may be alike, and the share of hashes that they seem to differ in."""
            small, large = np.minimum(n[others], n[one]), np.maximum(n[others], n[one])  # noqa: B023
            others = others[(label[others] != label[one]) & (small >= similarity * large - 1e-9)]  # noqa: B023
            far = np.bitwise_count(parts[others] ^ parts[one]).sum(axis=1, dtype=np.int64)  # noqa: B023
            others, far = others[far <= bound], far[far <= bound]  # noqa: B023
            both = n[others] + n[one]  # noqa: B023
            if maps is not None:  # noqa: B023
                far = maps.differ(one, others)  # noqa: B023
                at = far <= both * (1 - similarity) / (1 + similarity) + 1e-9
                others, far, both = others[at], far[at], both[at]
            return others, far / np.maximum(both, 1)

        if every:
            for one in np.flatnonzero(side == 0):
                others, _ = near(one, np.arange(one + 1, len(fp)) if alone else np.flatnonzero(side == 1))
                if len(others):
                    found.append(np.stack([np.full(len(others), fp[one]), fp[others]]))
                    pairs += len(others)
                if pairs > 50_000:
                    yield made()
                    found, pairs = found[:1], 0
        else:
            # Prim's way: what is least from all that is joined comes next; rows of one label are joined from the start.
            left, least, via, u, v = np.ones(len(fp), bool), np.full(len(fp), np.inf), np.full(len(fp), -1), [], []
            for _ in range(len(fp)):
                one = int(np.argmin(least))
                if np.isinf(least[one]):
                    one = int(np.argmax(left))
                elif via[one] >= 0:
                    u.append(fp[via[one]])
                    v.append(fp[one])
                left[one], least[one] = False, np.inf
                same = left & (label == label[one])
                least[same], via[same] = -1, -1
                others, share = near(one, np.flatnonzero(left if alone else left & (side != side[one])))
                at = share < least[others]
                least[others[at]], via[others[at]] = share[at], one
            found.append(np.array([u, v], np.int64))
            pairs += len(u)
            if pairs > 50_000:
                yield made()
                found, pairs = found[:1], 0
    yield made()


def if_small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are at most BROADCAST (rows of one or two longs; counted here)."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def frequent_shingles(docs: DataFrame, shingle_words: int) -> np.ndarray:
    """Hashes of shingles that are in COMMON or more of a sample of about SAMPLED documents (those of certain hashes of doc_id), in rising
    order; if they are over MOST_FREQUENT, the most frequent ones. They change the work of near_copies(), not what it finds."""
    rows = docs.count()
    share = min(1.0, SAMPLED / max(rows, 1))

    @given_back
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle_words) for t in batch.column(0)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col("text").cast("binary").alias("text"))
    counts = picked.mapInArrow(shingles, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").collect()], np.int64).view(np.uint64))


def prefix(found: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n hashes in one order for all sets: those that aren't frequent, then the others, by value."""
    n = len(found)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
        found = np.concatenate([found[~often], found[often]])
    return found[: n - math.ceil(similarity * n - 1e-9) + 1] if n else found


def alike(edges: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The edges (u, v) and alike: whether their texts (fp, text) have sets of shingles of this similarity, counted."""

    @given_back
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(fp: int, text: pa.Scalar) -> np.ndarray:
            if fp not in sets:
                if len(sets) >= REMEMBERED:
                    sets.clear()
                sets[fp] = shingle_set(text.as_py(), shingle_words)
            return sets[fp]

        for batch in batches:
            keep = []
            for u, v, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = of(u, a), of(v, b)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["u", "v", "alike"])

    rows = edges.join(texts.select(F.col("fp").alias("v"), F.col("text").alias("tv")), "v").join(texts.select(F.col("fp").alias("u"), F.col("text").alias("tu")), "u")
    return rows.select("u", "v", "tu", "tv").mapInArrow(similar, "u long, v long, alike boolean")


def near_copies(docs: DataFrame, shingle_words: int, similarity: float, parts: int = 4, tile: int = 4096) -> DataFrame:
    """One row per document: doc_id, key, label, component_id, as near_duplicates, of links between texts whose sets of shingles have a
    Jaccard similarity of at least similarity, counted exactly. Texts of one set are one class (fp).

    Two sets so alike share one of their prefix() hashes, so classes meet by these: of groups
    of the same classes, told by their number and 128 bits of their hashes, one stays. First a forest of the pairs of each group that seem
    most alike is counted, and components are found. Last, every pair of
    these groups that is still of different components and was not counted is, unless it can't be alike: bits made of the different shingles
    are more than furthest() apart, ten standard deviations off, or parity() proves that the sets differ in too many hashes. So a
    large group of copies gives about a pair for each class, and texts like each other, but less than similarity, few. Groups over
    tile are cut into pairs of tiles; only these meet in a task."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle_words))

    @F.pandas_udf("struct<fp: binary, n: int, bits: array<long>, parity: binary, first: array<long>>")
    @given_back
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            rows = []
            for t in text:
                found = shingle_set(t, shingle_words)
                rows.append((xxhash.xxh64_digest(found.tobytes(), SEED), len(found), majority([found], parts).view(np.int64), parity(found), prefix(found, frequent.value, similarity).view(np.int64)))
            yield pd.DataFrame(rows, columns=["fp", "n", "bits", "parity", "first"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    made = keyed.select("doc_id", "key", sketch("text").alias("s")).select("doc_id", "key", F.xxhash64("s.fp").alias("fp"), "s.n", "s.bits", "s.parity", "s.first")
    # What is long is kept for each class only: the rows as read go when classes and the short columns are written.
    folder = shared_folder(docs.sparkSession, "sketches")
    made.write.parquet(folder)
    sketches = docs.sparkSession.read.parquet(folder)
    marked = cut(sketches.select("doc_id", "key", "fp"))
    classes = cut(sketches.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("key").alias("text_key"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("parity").alias("parity"), F.first("first").alias("first")))
    ones = sum((F.bit_count(F.col("bits")[part]) for part in range(parts)), F.lit(0)).cast("int").alias("ones")

    delete(docs.sparkSession, folder)
    free_shuffles(docs.sparkSession)

    def groups() -> DataFrame:
        """Rows key, fp of the groups by hashes that have several classes, each set of classes once. Most have two: the least and the
        greatest, so that only the others are looked up again."""
        dealt = classes.select("fp", F.explode("first").alias("key"))
        found = cut(dealt.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1"))
        two = found.where("size = 2").groupBy("a", "b").agg(F.min("key").alias("key")).select("key", F.explode(F.array("a", "b")).alias("fp"))
        shared = cut(dealt.join(if_small(found.where("size > 2").select("key")), "key").select("key", "fp"))
        xor = lambda seed: F.bit_xor(F.xxhash64("fp", F.lit(seed)))
        signed_groups = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"), xor(1).alias("s1"), xor(2).alias("s2"))
        one = cut(signed_groups.groupBy("size", "s1", "s2").agg(F.min("key").alias("key")).select("key"))
        return cut(shared.join(if_small(one), "key").select("key", "fp").unionByName(two))

    def mixed_groups(members: DataFrame, label: DataFrame) -> DataFrame:
        """Rows key, fp, label of the groups that have classes of several labels."""
        relabelled = cut(members.join(if_small(label), F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("label", "fp").alias("label")))
        keys = cut(relabelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key"))
        return relabelled.join(if_small(keys), "key")

    def pairs(members: DataFrame, every: bool, counted: DataFrame | None = None) -> DataFrame:
        """Rows u, v, alike of pairs that members may be alike by, but those counted before."""
        present = cut(classes.join(if_small(members.select("fp").distinct()), "fp", "left_semi").select("fp", "n", "bits", "parity", ones))
        flat = tiles(members.join(present.select("fp", "ones"), "fp"), furthest(similarity, 64 * parts), tile).join(present.select("fp", "n", "bits", "parity"), "fp")
        flat = flat.select("block", "side", "fp", "n", "label", *[F.col("bits")[part].alias(f"bits{part}") for part in range(parts)], "parity")
        laid = flat.repartition("block").sortWithinPartitions("block")
        found = laid.mapInArrow(given_back(lambda batches: candidates(batches, similarity, every)), "u long, v long")
        edges = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        with small_batches(docs.sparkSession, MAPS_AT_ONCE):
            edges = cut(edges if counted is None else edges.join(counted, ["u", "v"], "left_anti"))
        needed = cut(edges.select(F.explode(F.array("u", "v")).alias("fp")).distinct().join(classes.select("fp", "text_key"), "fp"))
        texts = cut(keyed.join(if_small(needed), F.col("key") == F.col("text_key")).groupBy("fp").agg(F.first("text").alias("text")))
        with small_batches(docs.sparkSession, TEXTS_AT_ONCE):
            return cut(alike(edges, texts, shingle_words, similarity))

    members = groups()
    free_shuffles(docs.sparkSession)
    counted = pairs(members.withColumn("label", F.col("fp")), False)
    free_shuffles(docs.sparkSession)
    label = cut(components(counted.where("alike").select("u", "v")))
    counted = counted.unionByName(pairs(mixed_groups(members, label), True, counted.select("u", "v")))
    free_shuffles(docs.sparkSession)
    label = components(counted.where("alike").select("u", "v"))
    small = classes.select("fp", "least")
    rooted = small.join(label, small["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    return marked.select("doc_id", "key", "fp").join(named(rooted), "fp").select("doc_id", "key", "label", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, parts: int = 4) -> DataFrame:
    """docs with one row of each component of texts whose sets of shingles have at least this Jaccard similarity: that of the least doc_id. The texts are shuffled once, by doc_id and key; rows of one component that share the least doc_id (repeated rows, null
    ids) are found first, and only if there are any is a second pass made."""
    found = cut(near_copies(docs, shingle_words, similarity, parts))
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.where(~least).select(F.struct("doc_id").alias("id"), "key").distinct()
    # Whole rows travel as a struct, so no column of docs meets a name used here; a struct of an id equals another with the same null.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = rows.select("row", F.struct(F.col("row.doc_id").cast("long").alias("doc_id")).alias("id"), F.xxhash64("row.text").alias("key"))
    kept = keyed.join(gone, ["id", "key"], "left_anti")
    if not found.where(least).groupBy("doc_id", "label").count().where("count > 1").isEmpty():
        label = found.where(least).select(F.struct("doc_id").alias("id"), "key", "label").distinct()
        kept = kept.join(label, ["id", "key"]).dropDuplicates(["id", "label"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
