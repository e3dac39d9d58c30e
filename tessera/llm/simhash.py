"""SimHash near-duplicates, with pivot distance tables.

Words of the text, A-Z made small, form shingles; a fingerprint bit is 1 if it is set in over half of the shingles'
XXH64 digests. Distinct fingerprints link at MAX_BITS differing bits or fewer. Candidates come from buckets of
fingerprints that agree in all but MAX_BITS of some bit groups, which any linked pair does in at least one way, so no
link is lost. Within a bucket a table holds each fingerprint's Hamming distances to reference fingerprints (pivots); a
pair whose distances to any pivot differ by more than MAX_BITS can't link (triangle inequality), and only pairs
that the table leaves are compared bit by bit. A bucket emits a spanning forest, never its pairs: in a large bucket
members are pivots, each takes all within MAX_BITS at once, and only members of different trees are compared then.

Nulls and texts without words: fingerprint zero, linked like any other; a null doc_id is kept and never names a
component unless all its ids are null. Repeated rows and equal texts: one fingerprint, whose rows all get its
component. Fewer words than a shingle: one shingle of all. Very long texts: linear. No rows: none. Extra columns: ignored by
near_duplicates, kept by without_copies, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, partitions, released, stored, stored_by, table
from tessera.operators.components import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
PIVOTS, SMALL = 16, 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def masks(n: int, bits: int) -> list[int]:
    """Bit masks of which one at least is equal in any two fingerprints that differ in `bits` bits or fewer: all ways to
    choose all but `bits` of some groups of bits. There are as many groups as give keys about as many values as
    there are fingerprints, so that buckets stay small at any size."""
    groups = next(g for g in range(bits + 1, 65) if 64 * (g - bits) / g >= np.log2(max(n, 2)) - 1)
    ends = [64 * i // groups for i in range(groups + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:])]
    return [sum(chosen) for chosen in combinations(each, groups - bits)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(size, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of the digests' bits."""
    if not len(hashes):
        return 0
    rows = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
    set_bits = np.bincount(rows.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * set_bits > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(shingle_hashes(t.as_py(), size)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ pivots[None, :]).astype(np.int8)


def survivors(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs (x[i], y[i]) link: first by their pivot tables, then by themselves."""
    live = np.flatnonzero(np.abs(dx - dy).max(axis=1) <= bits)
    return live[np.bitwise_count(x[live] ^ y[live]) <= bits]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def large_bucket(x: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among many fingerprints, as index pairs.

    Leaders take all within `bits`. Two stars can link only if their leaders lie within 3 * bits, and then only
    members within 2 * bits of the other's leader can; trees already joined aren't compared again.
    """
    free, stars, edges = np.arange(len(x)), [], []
    while len(free):
        near = np.bitwise_count(x[free] ^ x[free[0]]) <= bits
        stars.append(free[near])
        edges += [(int(free[0]), int(i)) for i in free[near][1:]]
        free = free[~near]
    trees, leaders = Forest(len(stars)), x[[s[0] for s in stars]]
    for a in range(len(stars)):
        gap = np.bitwise_count(leaders[a + 1 :] ^ leaders[a])
        for b in (np.flatnonzero(gap <= 3 * bits) + a + 1).tolist():
            if trees.find(a) == trees.find(b):
                continue
            left = stars[a][np.bitwise_count(x[stars[a]] ^ leaders[b]) <= 2 * bits]
            right = stars[b][np.bitwise_count(x[stars[b]] ^ leaders[a]) <= 2 * bits]
            # the two leaders are pivots: coordinates of a linked pair differ by at most `bits`
            for i in left.tolist():
                ok = right[np.abs(np.bitwise_count(x[right] ^ leaders[a]).astype(int) - int(np.bitwise_count(x[i] ^ leaders[a]))) <= bits]
                ok = ok[np.bitwise_count(x[ok] ^ x[i]) <= bits]
                if len(ok):
                    trees.join(a, b)
                    edges.append((i, int(ok[0])))
                    break
    return edges


def linked(bits: int):
    """For mapInArrow over (bucket, key, fp) in order: links u, v of each bucket, a forest in large ones."""
    pivots = np.random.default_rng(SEED).integers(0, 2**63, PIVOTS, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)

    def pairs(x: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of complete buckets that start at `first`."""
        u, v = [], []
        small = sizes <= SMALL
        place = np.arange(len(x)) - np.repeat(first, sizes)
        left = np.repeat(sizes, sizes) - place  # rows of its bucket from each row on
        left[~np.repeat(small, sizes)] = 0
        table_ = distances(x, pivots)
        for step in range(1, int(sizes[small].max(initial=0))):
            a = np.flatnonzero(left > step)
            ok = a[survivors(x[a], x[a + step], table_[a], table_[a + step], bits)]
            u.append(ok)
            v.append(ok + step)
        u, v = [x[i] for i in u], [x[i] for i in v]
        for s, n in zip(first[~small].tolist(), sizes[~small].tolist()):
            e = np.array(large_bucket(x[s : s + n], bits), dtype=np.int64).reshape(-1, 2)
            u.append(x[s + e[:, 0]])
            v.append(x[s + e[:, 1]])
        return (np.concatenate(u) if u else x[:0]), (np.concatenate(v) if v else x[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]

        def emit(b, k, x):
            start = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (k[1:] != k[:-1])))) if len(x) else np.empty(0, np.int64)
            u, v = pairs(x, start, np.diff(np.append(start, len(x)))) if len(x) else (x, x)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            b, k, x = (np.concatenate((h, n.astype(h.dtype) if h.dtype != np.uint64 else n.view(np.uint64))) for h, n in zip(held, new))
            if not len(x):
                continue
            cut = len(x) - int(np.argmax(((b != b[-1]) | (k != k[-1]))[::-1])) if ((b != b[-1]) | (k != k[-1])).any() else 0
            yield emit(b[:cut], k[:cut], x[:cut])
            held = [b[cut:], k[cut:], x[cut:]]  # the last bucket may go on
        yield emit(*held)

    return run


def links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """u, v: fingerprints, such that all linked ones are joined by these links."""
    own = prints.select("fp").distinct()
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(prints.count(), bits)))).alias("bucket", "key")
    dealt = own.select(keys, "fp").repartition(partitions(prints.sparkSession), "bucket", "key").sortWithinPartitions("bucket", "key")
    return dealt.select(F.col("bucket").cast("long"), "key", "fp").mapInArrow(linked(bits), "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    prints = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(fingerprints(size), "doc_id long, fp long"), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(components(links(prints, bits)).toDF("fp", "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(first, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


COPY_WORDS, SIMILARITY = 5, 0.8
#: Texts whose shingles are counted to find common ones; from how many of them on a shingle is common; most of those kept.
SAMPLE, OFTEN, COMMON = 8_000, 4, 100_000
#: Most rounds of stars in crowded buckets before all pairs that are left are compared; how many of these a text needs no
#: stars; which share of a turn's pairs must link for another one; pairs that one text is held for.
ROUNDS, PLENTY, FEW, SLOT = 8, 4, 10, 256
#: Least and most bits of a sketch, powers of two; pairs of sketches that are compared at once.
SKETCH_LEAST, SKETCH_MOST, PAIRS = 512, 2048, 1 << 16


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def each_shingle(size: int):
    """For mapInArrow over (text): the distinct shingles of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), size).view(np.int64))], names=["h"])

    return run


def sketch(h: np.ndarray) -> bytes:
    """A bit for each value of the shingles' last bits: whether an odd number of them has it. Two texts' sketches differ in no more
    bits than there are shingles in one of both only. The halves of a sketch, one xor the other, are that of half the bits."""
    bits = min(max(1 << (2 * len(h) - 1 | 1).bit_length(), SKETCH_LEAST), SKETCH_MOST)
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of some rows, side by side for each width."""

    def __init__(self, raw: np.ndarray):
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        wide = None
        for size in sorted(set(self.size.tolist()), reverse=True):
            while wide is not None and wide.shape[1] * 8 > size:
                half = wide.shape[1] // 2
                wide = wide[:, :half] ^ wide[:, half:]
            own = np.flatnonzero(self.size == size)
            new = np.frombuffer(b"".join(raw[own]), np.uint64).reshape(len(own), size // 8)
            of = own if wide is None else np.concatenate((of, own))
            wide = new if wide is None else np.concatenate((wide, new))
            place = np.full(len(raw), -1)
            place[of] = np.arange(len(of))
            self.rows[size] = place, wide

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of rows a and b differ, at the lesser width of both."""
        out, least = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        for size in np.unique(least).tolist():
            place, wide = self.rows[size]
            for at in np.array_split(live := np.flatnonzero(least == size), 1 + len(live) // PAIRS):
                out[at] = np.bitwise_count(wide[place[a[at]]] ^ wide[place[b[at]]]).sum(axis=1)
        return out


def prefixes(size: int, similarity: float, common: np.ndarray, counts: np.ndarray):
    """For mapInArrow over (k1, k2, owner, text): these keys, the fingerprint, n, the number of distinct shingles, as many
    of them from the front of one order as two texts of this similarity must share one of, and their sketch. Any order does;
    here the common ones come last. A text without words has one shingle, zero."""

    def prefix(h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(1, np.uint64)
        if len(common):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
        return h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shingle_hashes(t.as_py(), size) for t in batch.column(3)]
            sets = [np.unique(h) for h in every]
            made = [np.array([fingerprint(h) for h in every], np.uint64).view(np.int64), [len(h) for h in sets]]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], *(pa.array(m, pa.int64()) for m in made),
                    pa.array([prefix(h).view(np.int64) for h in sets], pa.list_(pa.int64())), pa.array([sketch(h) for h in sets], pa.binary()),
                ],
                names=["k1", "k2", "owner", "fp", "n", "prefix", "sketch"],
            )

    return run


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of rows sorted by the first one, cut where it changes, with the sizes of the buckets."""
    held: list[list[np.ndarray]] = []

    def cut(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
        cols = [np.concatenate(c) for c in zip(*parts)]
        starts = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
        return cols, np.diff(np.append(starts, len(cols[0])))

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(new[0]):
            continue
        last = int(np.argmax((new[0] != new[0][-1])[::-1])) if new[0][0] != new[0][-1] else len(new[0])
        at = len(new[0]) - last
        if at or (held and held[-1][0][-1] != new[0][0]):
            yield cut([*held, [c[:at] for c in new]])
            held = []
        held.append([c[at:] for c in new])
    if held:
        yield cut(held)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (h, id, n, rest) in order of h: the rows of shingles in two texts or more, and whether these are
    over SMALL."""
    for cols, sizes in whole_buckets(batches):
        of = np.repeat(sizes, sizes)
        yield pa.RecordBatch.from_arrays([*(pa.array(c[of > 1]) for c in cols), pa.array((of > SMALL)[of > 1])], names=["h", "id", "n", "rest", "crowd"])


def candidates(similarity: float, turn: int | None):
    """For mapInArrow over (h, id, n, rest, c, sketch) in order of h: pairs u < v of different components c that can have this
    similarity. rest is how many shingles of a text are left from the bucket's on, which bounds what is common to two
    texts that share none before; their sketches bound what isn't common.

    If turn is null, all pairs of a bucket. Else stars, so that there are no more pairs than rows: those of a member drawn for this
    turn, in a bucket of over SMALL texts of two, one of them of the largest component.
    """
    share = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ids, n, rest, c, raw), sizes in whole_buckets(batches):
            first, small, sketches = np.cumsum(sizes) - sizes, sizes <= SMALL, Sketches(raw)
            if turn is not None:
                draw = (ids.astype(np.uint64) + np.uint64(turn * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
                draw = (draw ^ (draw >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)

            def out(a, b):
                live = np.flatnonzero((c[a] != c[b]) & (np.minimum(rest[a], rest[b]) >= share * (n[a] + n[b]) - 1e-6))  # noqa: B023
                a, b = a[live], b[live]
                near = sketches.differ(a, b) <= (1 - 2 * share) * (n[a] + n[b]) + 1e-6  # noqa: B023
                a, b = ids[a[near]], ids[b[near]]  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

            if turn is None:
                left = np.repeat(first + sizes, sizes) - np.arange(len(ids))
                left[~np.repeat(small, sizes)] = 0
                for step in range(1, int(sizes[small].max(initial=0))):
                    a = np.flatnonzero(left > step)
                    yield out(a, a + step)
            elif small.any():
                least = np.repeat(np.minimum.reduceat(draw, first), sizes)
                lead = np.flatnonzero((draw == least) & np.repeat(small, sizes))
                bucket = np.repeat(np.arange(len(sizes)), sizes)
                of = np.zeros(len(sizes), np.int64)
                of[bucket[lead]] = lead
                every = np.flatnonzero(np.repeat(small, sizes))
                yield out(of[bucket[every]], every)
            for s, m in zip(first[~small].tolist(), sizes[~small].tolist()):
                every = np.arange(s, s + m)
                if turn is None:
                    for i in range(s, s + m - 1):
                        yield out(np.full(s + m - 1 - i, i), every[i + 1 - s :])
                    continue
                kinds, place, count = np.unique(c[every], return_inverse=True, return_counts=True)
                if len(kinds) == 1:
                    continue
                most = place == count.argmax()
                for group in (every[most], every[~most]):
                    i = group[draw[group].argmin()]
                    yield out(np.full(m, i), every)

    return run


def sifted(similarity: float):
    """For mapInArrow over (u, slot, v, n, prefix) in this order, u's own first with a null v: the pairs u, v that can have this
    similarity: what they share of their prefixes, and all that is beyond the prefix that ends first, must suffice."""
    share = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = np.empty(0, np.int64), 0
        for batch in batches:
            found, flat, ends = [], batch.column(4).flatten().to_numpy(), np.cumsum([0, *(len(p) for p in batch.column(4))])
            for i, (u, v, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                h = flat[ends[i] : ends[i + 1]]
                if v is None:
                    own, m = h, n
                elif len(np.intersect1d(own, h, assume_unique=True)) + max(m - len(own), n - len(h)) >= share * (m + n) - 1e-6:
                    found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return run


def overlaps(size: int, similarity: float):
    """For mapInArrow over (u, slot, v, text) in this order, u's own text first with a null v: the pairs u, v whose shingles
    have this Jaccard similarity, 1 if both have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for u, v, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                h = shingle_set(t.as_py(), size)
                if v is None:
                    own = h
                    continue
                both = len(np.intersect1d(own, h, assume_unique=True))
                if (both / (len(own) + len(h) - both) if len(own) + len(h) else 1.0) >= similarity:
                    found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return run


def beside(pairs: DataFrame, attach: Callable[[DataFrame], DataFrame], judge: Callable, name: str) -> DataFrame:
    """The pairs u, v that judge keeps. attach adds to rows (u, slot, v, id) what is to be known of an id, and drops id; it
    travels once for each pair in which the id is v, and once for each SLOT pairs in which it is u. An id in very many
    pairs is dealt to as many slots."""
    of = pairs.groupBy("u").agg(F.ceil(F.count("*") / SLOT).alias("slots"))
    slot = F.pmod(F.xxhash64("v"), F.col("slots"))
    asked = stored(pairs.join(of, "u").select("u", slot.alias("slot"), "v"), "asked")
    rows = asked.select("u", "slot", "v", F.col("v").alias("id")).union(asked.select("u", "slot", F.lit(None).cast("long"), F.col("u").alias("id")).distinct())
    dealt = attach(rows).repartition(partitions(pairs.sparkSession), "u", "slot").sortWithinPartitions("u", "slot", F.col("v").asc_nulls_first())
    out = stored(dealt.mapInArrow(judge, "u long, v long"), name)
    released(pairs.sparkSession, asked)
    return out


def verified(pairs: DataFrame, prints: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs u, v of this similarity: by their prefixes, which most others fail, then by their texts."""
    can = beside(pairs, lambda rows: rows.join(prints.select("id", "n", "prefix"), "id").select("u", "slot", "v", "n", "prefix"), sifted(similarity), "sifted")
    named = prints.select("id", "k1", "k2")
    out = beside(can, lambda rows: texts.join(rows.join(named, "id"), ["k1", "k2"]).select("u", "slot", "v", "body"), overlaps(size, similarity), "sure")
    released(pairs.sparkSession, can)
    return out


def similar(prints: DataFrame, rows: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """u, v: links that join all ids which pairs of at least this similarity join. prints: id, k1, k2, fp, n, prefix, sketch;
    rows: h, id, n, rest, crowd; texts: k1, k2, body.

    Only verified links contract. First come the links of fingerprints, which join most near copies by a pair or two each.
    Then a star of each bucket is verified and contracted, so that a group of near copies is not expanded into its pairs. Where crowded
    buckets would make over PLENTY pairs a text, more stars, drawn anew each turn, follow, while one pair in FEW links; in the
    end every pair of different components that is left is compared, so that what no star joined isn't lost.
    """
    spark = rows.sparkSession
    first = stored(prints.groupBy("fp").agg(F.min("id").alias("id")), "first")
    same = prints.join(first.toDF("fp", "u"), "fp").where("id <> u").select("u", F.col("id").alias("v"))
    near = links(prints).join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    tried = stored(same.union(near).where("u <> v").distinct(), "pairs")
    sure = verified(tried, prints, texts, size, similarity)

    crowd, parts, most = rows.where("crowd"), partitions(spark), PLENTY * prints.count()
    turn, found = 0, True
    while True:
        groups = stored(components(sure).toDF("id", "c"), "groups")
        named = prints.select("id", "sketch").join(groups, "id", "left").withColumn("c", F.coalesce("c", "id"))
        last = turn > 0 and (turn > ROUNDS or not found or pairs_left(crowd.join(named, "id")) <= most)
        now = rows if last or turn == 0 else crowd
        dealt = now.join(named, "id").select("h", "id", "n", "rest", "c", "sketch").repartition(parts, "h").sortWithinPartitions("h")
        pairs = stored(dealt.mapInArrow(candidates(similarity, None if last else turn), "u long, v long").distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        new = verified(pairs, prints, texts, size, similarity)
        sure = sure.union(new)
        released(spark, groups)
        if last:
            dropped(spark, tried, pairs, first)
            return sure
        turn, found, tried = turn + 1, turn == 0 or new.count() * FEW >= pairs.count(), tried.union(pairs)


def pairs_left(crowd: DataFrame) -> int:
    """How many pairs of different components c crowded buckets h hold; of all buckets, so some count more than once."""
    sizes = crowd.groupBy("h", "c").agg(F.count("*").cast("double").alias("n"))
    by = sizes.groupBy("h").agg(((F.sum("n") ** 2 - F.sum(F.col("n") ** 2)) / 2).alias("pairs"))
    return by.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = COPY_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs less near copies: of each group linked at this similarity of word shingles, the row of least id stays.

    SimHash links come first. But at a similarity of 0.8 a seventh of SimHash bits differ, so that fingerprints alone would
    miss pairs. The other candidates share one of the first shingles of an order in which those common in a sample come
    last (prefix filter): a pair of this similarity always does, whatever the sample. Each link is verified by the
    shingles themselves. Only exact copies are one text beforehand. Texts without words are copies of each other. Rows
    equal in id and text count as one row. Texts are stored once, in a table bucketed by text.
    """
    spark, keys = docs.sparkSession, ["k1", "k2"]
    body, others = F.coalesce(F.col(text), F.lit("")), [c for c in docs.columns if c != text]
    named = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    own = F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    keyed = docs.select(own.alias("own"), F.col(doc_id).alias("n"), named.alias("id"), F.col(text).isNull().alias("none"), body.alias("body"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"))
    owner = F.min(F.struct(F.col("n").isNull().alias("none"), "n", "id", *keys)).alias("owner")
    texts = stored_by(keyed.groupBy(*keys).agg(owner, F.first("body").alias("body")), "texts", keys, partitions(spark))
    released(spark)
    drawn = texts.where(F.pmod("k1", F.lit(max(1, texts.count() // SAMPLE))) == 0).select("body").mapInArrow(each_shingle(size), "h long")
    often = drawn.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(COMMON).collect()
    common, counts = np.array([r[0] for r in often], np.int64).view(np.uint64), np.array([r[1] for r in often], np.int64)
    order = np.argsort(common)
    schema = f"k1 long, k2 long, owner {texts.schema['owner'].dataType.simpleString()}, fp long, n long, prefix array<long>, sketch binary"
    made = texts.select(*keys, "owner", "body").mapInArrow(prefixes(size, similarity, common[order], counts[order]), schema)
    prints = stored(made.withColumn("id", F.monotonically_increasing_id()), "prints")

    posts = prints.select("id", "n", F.posexplode("prefix").alias("at", "h")).select("h", "id", "n", (F.col("n") - F.col("at")).alias("rest"))
    dealt = posts.repartition(partitions(spark), "h").sortWithinPartitions("h")
    rows = stored(dealt.mapInArrow(shared, "h long, id long, n long, rest long, crowd boolean"), "shared")
    released(spark)
    sure = similar(prints, rows, texts.select(*keys, "body"), size, similarity)
    released(spark, rows)
    group = prints.select("id", "owner").join(components(sure).toDF("id", "component"), "id", "left")
    winners = stored(group.groupBy(F.coalesce("component", "id").alias("group")).agg(F.min("owner").alias("o")).select("o.k1", "o.k2", "o.id"), "winners")
    released(spark, prints, sure)

    seen = keyed.drop("body").join(winners, [*keys, "id"], "left_semi").groupBy(*keys, "id").agg(F.first(F.struct("own", "none")).alias("r"))
    kept = texts.select(*keys, "body").join(seen, keys)
    made = {c: F.col(f"r.own.c{i}") for i, c in enumerate(others)} | {text: F.when(~F.col("r.none"), F.col("body"))}
    return kept.select(*(made[c].alias(c) for c in docs.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
