"""Exact repeats of at least `length` tokens across a corpus, shared by the two substring operators.

A text is an array of tokens (hashed words, or bytes). What a window of `length` tokens holds gives it an anchor, a
stretch in it whose hash is its seed, so equal windows have equal anchors, and each window belongs to one. An
anchor's own windows are consecutive; the text they span is its context. How anchors are found, and how contexts of
one seed are compared, is the operator's own method; the flow around it is this:

1. Equal texts are one row, in a table bucketed by text; the other steps take texts from there without a shuffle.
2. Anchors of all texts, as hashes of seed and context. Seeds that occur once can't repeat and go.
3. Contexts that occur twice repeat as a whole: all their windows do. They count once from here on.
4. Other contexts that share a seed meet in one task and are compared.
5. The windows found are marked in their texts.

A seed with over CROWD different contexts isn't gathered. If the operator can part contexts, they are parted by what else their
windows hold, again and again, until no seed is crowded (see in_parts); else the windows are hashed and counted one by one.
Counts are combined before each shuffle. No step holds more than one text, or CROWD contexts, at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import partitions, released, stored, stored_by

BATCH, CROWD = 8_000, 50_000
#: Bytes of texts whose anchors are found at once, if the plan can; a longer text is taken by itself.
TOGETHER = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
#: Low bits of a hash that give way to a position, so that a least value is the leftmost of equals.
POSITION = np.uint64((1 << 34) - 1)


class Powers:
    """Powers of the hash's base and of its inverse, as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 12)
            chain = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
            cls.up, cls.down = chain(_BASE), chain(pow(_BASE, -1, 1 << 64))
        return cls.up[:n], cls.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any stretch of a token array."""

    def __init__(self, values: np.ndarray):
        up, self.down = Powers.to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


@dataclass(frozen=True)
class Plan:
    """What a corpus is made of. tokens: of a text's bytes, as an array; values: their 64-bit hashes."""

    name: str
    length: int
    tokens: Callable[[bytes], np.ndarray]
    values: Callable[[np.ndarray], np.ndarray]
    #: tokens of a text, at least `length` of them, to its anchors: see contexts_of()
    anchors: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: seeds, reversed tokens before and tokens from the anchor on of contexts to the windows, each by how many of its
    #: tokens stand before the anchor, that are in another context too; context after context, in ascending order
    shared: Callable[[np.ndarray, list[bytes], list[bytes]], list[np.ndarray]]
    #: contexts that are compared at once; those of one seed always are
    batch: int = 8_000
    #: how to part a crowded seed's context: of its tokens, how many stand before the anchor, and the floor of its last parting, the
    #: parts' keys, floors, first and last windows; equal windows get equal keys. Without it a crowded seed's windows are counted.
    part: Callable[[np.ndarray, int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None
    #: anchors of several texts of any length, and the number of each one's text
    many: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None


def contexts_of(h: Hashes, length: int, seed: np.ndarray, t: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, context hash and packed place of anchors at t with windows first..last; a place holds the anchor's
    start, how many tokens its context has before it, and how many windows the context has less one."""
    context = mix(h.of(first, last + length) ^ ((t - first).astype(np.uint64) << np.uint64(8)) ^ (last - first).astype(np.uint64))
    return seed.view(np.int64), context.view(np.int64), t << 16 | (t - first) << 8 | (last - first)


def batch_of(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def one_by_one(plan: Plan):
    """Plan.many for a plan without it."""

    def many(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        got = [plan.anchors(tokens) if len(tokens) >= plan.length else [np.empty(0, np.int64)] * 3 for tokens in texts]
        return *(np.concatenate(c) for c in zip(*got)), np.repeat(np.arange(len(got)), [len(g[0]) for g in got])

    return many


def row_sizes(lists: pa.ListArray) -> np.ndarray:
    """How many values each row has in flatten(); a null row has none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def find_anchors(plan: Plan):
    many = plan.many or one_by_one(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, copies = (batch.column(i).to_numpy() for i in range(3))
            got, held, at, size = [], [], 0, 0
            for i, t in enumerate(batch.column(3)):
                held.append(plan.tokens(t.as_buffer().to_pybytes()))
                size += held[-1].nbytes
                if size >= TOGETHER or i + 1 == len(batch):
                    *made, of = many(held)
                    got.append((*made, of + at))
                    held, at, size = [], i + 1, 0
            if got:
                seed, context, place, of = (np.concatenate(c) for c in zip(*got))
                yield batch_of(["seed", "context", "k1", "k2", "place", "weight"], *(pa.array(c) for c in (seed, context, k1[of], k2[of], place, np.minimum(copies, 2)[of])))

    return run


def cut_contexts(plan: Plan):
    """Per text and its wanted anchors: each context, what precedes its anchor backwards and what follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seed", "context", "total", "crowd", "before", "after"]
        for batch in batches:
            all_ = batch.column(1).flatten()
            n, (place, *own) = row_sizes(batch.column(1)), (pc.struct_field(all_, c) for c in ("place", *names[:4]))
            place = place.to_numpy()
            t = place >> 16
            first = t - (place >> 8 & 255)
            stop = first + (place & 255) + plan.length
            at, before, after = 0, [], []
            for text, low, high in zip(batch.column(0), (np.cumsum(n) - n).tolist(), np.cumsum(n).tolist()):
                tokens = plan.tokens(text.as_buffer().to_pybytes())
                for a, b, z in zip(first[low:high].tolist(), t[low:high].tolist(), stop[low:high].tolist()):
                    before.append(tokens[a:b][::-1].tobytes())
                    after.append(tokens[b:z].tobytes())
                if len(after) >= BATCH or (after and high == len(t)):
                    yield batch_of(names, *(c.slice(at, len(after)) for c in own), pa.array(before), pa.array(after))
                    at, before, after = high, [], []

    return run


def runs(plan: Plan, hits: np.ndarray) -> list[int]:
    """Stretches, from the anchor's start on, that windows with these numbers of tokens before it cover."""
    cuts = np.flatnonzero(np.diff(hits) > 1)
    low, high = hits[np.append(0, cuts + 1)], hits[np.append(cuts, len(hits) - 1)]
    return np.stack((-high, plan.length - low), axis=1).ravel().tolist()


def compare_contexts(plan: Plan):
    """For mapInArrow over contexts in order of seed: those that share windows with others, and which stretches."""
    names = ["seed", "context", "runs"]

    def judge(rows: dict) -> pa.RecordBatch:
        seed = np.array(rows["seed"], np.int64)
        hits = plan.shared(seed, rows["before"], rows["after"])
        live = [i for i, total in enumerate(rows["total"]) if total == 1 and len(hits[i])]
        made = [runs(plan, hits[i]) for i in live]
        return batch_of(names, pa.array(seed[live]), pa.array(np.array(rows["context"], np.int64)[live]), pa.array(made, pa.list_(pa.int32())))

    def judged(rows: dict, end: int) -> Iterator[pa.RecordBatch]:
        """The rows before `end`, plan.batch of them at once or one seed, cut between seeds; an Arrow batch can hold many more."""
        seed = np.array(rows["seed"][:end], np.int64)
        edges = np.append(np.flatnonzero(seed[1:] != seed[:-1]) + 1, end)
        at = 0
        while at < end:
            fits = int(np.searchsorted(edges, at + plan.batch, "right")) - 1
            cut = int(edges[fits]) if fits >= 0 and edges[fits] > at else int(edges[fits + 1])
            yield judge({c: v[at:cut] for c, v in rows.items()})
            at = cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: [] for c in ("seed", "context", "total", "before", "after")}
        for batch in batches:
            for c in held:
                held[c] += batch.column(c).to_pylist()
            n = len(held["seed"])
            if n >= plan.batch and held["seed"][0] != held["seed"][-1]:
                cut = next(i for i in range(n - 1, 0, -1) if held["seed"][i - 1] != held["seed"][-1])
                yield from judged(held, cut)
                held = {c: v[cut:] for c, v in held.items()}  # the last seed may go on
        if held["seed"]:
            yield from judged(held, len(held["seed"]))

    return run


PARTS = "seed long, context long, floor long, total long, root_seed long, root_context long, before binary, after binary"


def part_contexts(plan: Plan):
    """For mapInArrow over contexts of crowded seeds (columns of PARTS): the parts of each, around the same anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = [c.split()[0] for c in PARTS.split(", ")], plan.tokens(b"a").dtype
        for batch in batches:
            out: list[tuple] = []
            for seed, _, floor, total, root_seed, root_context, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                b = np.frombuffer(before, kind)[::-1]
                tokens = np.concatenate((b, np.frombuffer(after, kind)))
                keys, floors, first, last = plan.part(tokens, len(b), floor)
                h, at = Hashes(plan.values(tokens)), np.full(len(first), len(b))
                own = mix(np.array([seed]).view(np.uint64) ^ mix(keys))
                seeds, contexts, _ = contexts_of(h, plan.length, own, at, first, last)
                for s, c, f, a, z in zip(seeds.tolist(), contexts.tolist(), floors.tolist(), first.tolist(), last.tolist()):
                    out.append((s, c, f, total, root_seed, root_context, tokens[a : len(b)][::-1].tobytes(), tokens[len(b) : z + plan.length].tobytes()))
                if len(out) >= BATCH:
                    yield batch_of(names, *(pa.array(c) for c in zip(*out)))
                    out = []
            if out:
                yield batch_of(names, *(pa.array(c) for c in zip(*out)))

    return run


def compared(plan: Plan, contexts: DataFrame) -> DataFrame:
    """seed, context, runs of those that share windows with others of their seed."""
    dealt = contexts.repartition(partitions(contexts.sparkSession), "seed").sortWithinPartitions("seed")
    return dealt.mapInArrow(compare_contexts(plan), "seed long, context long, runs array<int>")


def in_parts(plan: Plan, hot: DataFrame, crowd: int) -> list[DataFrame]:
    """seed, context, runs (several rows for a context) of the windows of crowded seeds that repeat. Parts that occur twice
    repeat as a whole; parts of one seed are compared where they are few, and parted again by the next key where they aren't."""
    out = []
    level = hot.select("seed", "context", F.col("seed").alias("floor"), "total", F.col("seed").alias("root_seed"), F.col("context").alias("root_context"), "before", "after")
    while True:
        parts = stored(level.mapInArrow(part_contexts(plan), PARTS), "parts")
        one = F.first(F.struct("floor", "root_seed", "root_context", "before", "after")).alias("one")
        each = stored(parts.groupBy("seed", "context").agg(F.sum("total").alias("total"), one).select("seed", "context", "total", "one.*"), "each")
        seeds = stored(each.groupBy("seed").agg(F.count("*").alias("n"), F.min("total").alias("least")).where("n > 1 AND least = 1").select("seed", "n"), "part_seeds")
        twice = stored(each.where("total > 1").select("seed", "context"), "twice")
        whole = parts.where("total = 1").join(twice, ["seed", "context"], "left_semi")
        stretch = F.array(-F.length("before"), F.length("after")).alias("runs")
        out.append(stored(whole.select(F.col("root_seed").alias("seed"), F.col("root_context").alias("context"), stretch), "repeats"))
        some = stored(compared(plan, each.join(seeds.where(F.col("n") <= crowd), "seed").select("seed", "context", "total", "before", "after")), "compared")
        roots = each.where("total = 1").select("seed", "context", "root_seed", "root_context")
        out.append(stored(some.join(roots, ["seed", "context"]).select(F.col("root_seed").alias("seed"), F.col("root_context").alias("context"), "runs"), "repeats"))
        crowded = seeds.where(F.col("n") > crowd)
        left = None if crowded.isEmpty() else stored(each.join(crowded, "seed").select(level.columns), "crowded")
        released(hot.sparkSession, parts, each, seeds, twice, some, level)
        if left is None:
            return out
        level = left


def hash_windows(plan: Plan):
    """For crowded seeds: two hashes of each window of each context."""
    names = ["w1", "w2", "seed", "context", "total", "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = plan.tokens(b"a").dtype
        for batch in batches:
            out = []
            for seed, context, total, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(np.frombuffer(before, kind)[::-1].tobytes() + after, kind)
                values, n = plan.values(tokens), len(before) // kind.itemsize
                a = n - np.arange(len(tokens) - plan.length + 1)
                w1, w2 = Hashes(values).grams(plan.length), Hashes(mix(values ^ np.uint64(_BASE))).grams(plan.length)
                out.append((w1.view(np.int64), w2.view(np.int64), *(np.full(len(a), x, np.int64) for x in (seed, context, total)), a.astype(np.int32)))
            if out:
                yield batch_of(names, *(pa.array(np.concatenate(c)) for c in zip(*out)))

    return run


def gather_windows(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [runs(plan, np.array(sorted(set(a)))) for a in batch.column(2).to_pylist()]
            yield batch_of(["seed", "context", "runs"], batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int32())))

    return run


def stretches(plan: Plan, marks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches that the marks of each row cover, and the row of each; in order."""
    flat = marks.flatten()
    place, lists = pc.struct_field(flat, "place").to_numpy(), pc.struct_field(flat, "runs")
    row = np.repeat(np.arange(len(marks), dtype=np.int64), row_sizes(marks))
    whole = np.flatnonzero(lists.is_null().to_numpy(zero_copy_only=False))
    part = np.repeat(np.arange(len(flat)), row_sizes(lists) // 2)
    ends = lists.flatten().to_numpy().reshape(-1, 2)
    t = place >> 16
    first = t - (place >> 8 & 255)
    base = row << 40  # rows lie apart: no text is that long
    low = np.concatenate(((base + first)[whole], (base + t)[part] + ends[:, 0]))
    high = np.concatenate(((base + first + (place & 255))[whole] + plan.length, (base + t)[part] + ends[:, 1]))
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(low[1:] > high[:-1]) + 1
    if len(low):
        low, high = low[np.append(0, new)], high[np.append(new - 1, len(high) - 1)]
    row = low >> 40
    return low - (row << 40), high - (row << 40), row


@dataclass(frozen=True)
class Gone:
    """What is to go of a text: all of it if it has copies and is long enough, else the stretches that its marks cover."""

    plan: Plan
    copies: int
    low: np.ndarray
    high: np.ndarray

    def spans(self, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest stretches that go."""
        if self.copies > 1 and tokens >= self.plan.length:
            return np.array([0]), np.array([tokens])
        return self.low, self.high

    def mask(self, tokens: int) -> np.ndarray:
        low, high = self.spans(tokens)
        depth = np.zeros(tokens + 1, np.int8)
        depth[low], depth[high] = 1, -1
        return np.cumsum(depth[:-1], dtype=np.int8) > 0


def removed(plan: Plan, docs: DataFrame, own: Column, text: str, digest: Callable, schema: str, crowd: int = CROWD) -> DataFrame:
    """own (a column of docs) and the columns of digest(raw bytes, Gone) for each row of docs."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(own.alias("own"), body.alias("text"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"))
    keys = ["k1", "k2"]
    distinct = keyed.groupBy(*keys).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = stored_by(distinct, "texts", keys, partitions(spark))
    released(spark)

    found = stored(texts.select(*keys, "copies", "text").mapInArrow(find_anchors(plan), "seed long, context long, k1 long, k2 long, place long, weight long"), "anchors")
    # stored apart: the join then has an exchange of its own on both sides, and a hot seed's rows can be split
    often = stored(found.groupBy("seed").agg(F.sum("weight").alias("n")).where("n > 1").select("seed"), "often")
    live = stored(found.join(often, "seed", "left_semi"), "live")
    released(spark, found)

    contexts = stored(live.groupBy("seed", "context").agg(F.sum("weight").alias("total"), F.min(F.struct(*keys, "place")).alias("at")), "contexts")
    seeds = stored(contexts.groupBy("seed").agg(F.count("*").alias("n"), F.min("total").alias("least")).where("n > 1 AND least = 1").select("seed", "n"), "seeds")
    wanted = contexts.join(seeds, "seed").select("at.k1", "at.k2", F.struct("at.place", "seed", "context", "total", (F.col("n") > crowd).alias("crowd")).alias("w"))
    listed = wanted.groupBy(*keys).agg(F.collect_list("w").alias("wanted"))
    cut = stored(texts.join(listed.hint("shuffle_hash"), keys).select("text", "wanted").mapInArrow(cut_contexts(plan), "seed long, context long, total long, crowd boolean, before binary, after binary"), "cut")
    released(spark)

    hot = not seeds.where(F.col("n") > crowd).isEmpty()
    calm, hot_cut = cut.where("NOT crowd").drop("crowd"), cut.where("crowd").drop("crowd")
    partly = compared(plan, calm)
    done = []
    if hot and plan.part:
        done = in_parts(plan, stored(hot_cut, "hot"), crowd)
        for some in done:
            partly = partly.union(some)
    elif hot:
        windows = stored(hot_cut.mapInArrow(hash_windows(plan), "w1 long, w2 long, seed long, context long, total long, a int"), "windows")
        twice = stored(windows.groupBy("w1", "w2").agg(F.sum("total").alias("n")).where("n > 1").select("w1", "w2"), "twice")
        done = [windows, twice]
        offsets = windows.where("total = 1").join(twice, ["w1", "w2"], "left_semi").groupBy("seed", "context").agg(F.collect_list("a").alias("a"))
        partly = partly.union(offsets.mapInArrow(gather_windows(plan), "seed long, context long, runs array<int>"))
    whole = contexts.where("total > 1").select("seed", "context", F.lit(None).cast("array<int>").alias("runs"))
    repeats = stored(partly.union(whole), "repeats")
    marks = live.where("weight = 1").join(repeats, ["seed", "context"]).select(*keys, F.struct("place", "runs").alias("m"))
    of_text = stored(marks.groupBy(*keys).agg(F.collect_list("m").alias("marks")), "marks")
    released(spark, cut, live, often, contexts, seeds, repeats, *done)

    names = [c.split()[0] for c in schema.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            low, high, row = stretches(plan, batch.column(4))
            cuts = np.searchsorted(row, np.arange(len(batch) + 1)).tolist()
            for k1, k2, copies, t, a, z in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), cuts, cuts[1:]):
                out.append((k1, k2, *digest(t.as_buffer().to_pybytes(), Gone(plan, copies, low[a:z], high[a:z]))))
            if out:
                yield batch_of([*keys, *names], *(pa.array(c) for c in zip(*out)))

    judged = texts.join(of_text.hint("shuffle_hash"), keys, "left").select(*keys, "copies", "text", "marks").mapInArrow(finish, f"k1 long, k2 long, {schema}")
    out = stored(judged, "judged")
    released(spark, texts, of_text)
    return keyed.select("own", *keys).join(out, keys).drop(*keys)
