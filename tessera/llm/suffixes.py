"""Substring dedup over bytes: prefix-free parsing, and the suffix arrays of dictionary and parse put together.

A rolling hash over TRIGGER bytes marks triggers (a fixed residue, RESIDUE in 2**64 of all hashes). A phrase runs from the start
of a trigger to the end of the next one, so phrases overlap by a trigger, and no phrase, nor the rest of one, is a
prefix of another. What a window of LENGTH bytes holds alone decides its phrases.

The corpus order (of all suffixes that start a window, as far as LENGTH bytes reach) is made in blocks: of the phrases that a
window holds whole, the one of least hash names its block, so that equal windows meet. A phrase or context that occurs
once can't repeat and goes before; so does a context that agrees with no other far enough around its phrase to share a
window, see may_share(). For the rest of a block, see ordered_windows():

- the dictionary is its distinct phrases, in order; its suffix array gives each rest of a phrase a rank,
- the parse is its texts as phrase ranks; its suffix array orders what follows a trigger,
- a window is the rest of a phrase up to its first trigger, and the parse from that trigger on. The pair of both ranks
  is its place in corpus order (windows that start on a trigger come first), and the longest common stretch with its
  neighbour comes from the two arrays' levels.

Every byte under a window whose neighbour shares all LENGTH bytes goes. Blocks of over CROWD texts, which would not fit a task at
some size, are parted: by the phrase of next least hash that a window holds whole and its place, as equal windows hold the same, and
so on until no block is crowded. A window without a (further) whole phrase is its own block (one in some 10,000 of
ordinary text; runs and the like have more); such blocks hold equal texts only, which count as one.

Nulls: empty; a null doc_id is kept. Texts under LENGTH bytes are kept. Repeated rows and equal texts: removed as a
whole if long enough. Overlaps count, also within one text; matches end at a document's ends. Very long texts: linear.
No rows: none. Extra columns: ignored by dedup_bytes, kept by cut_repeats, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.repeats import POSITION, Gone, Hashes, Plan, contexts_of, removed

LENGTH, TRIGGER = 200, 8
#: Of this many rolling hashes (a power of two) one is a trigger's.
EVERY = 16
#: From more texts than this on a block is parted before it is ordered.
CROWD = 2_000
#: How finely may_share() tells apart how much of a window stands before its anchor.
STEP = 50
_LETTER = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.int64).view(np.uint64)


def triggers(h: Hashes) -> np.ndarray:
    return np.flatnonzero(h.grams(TRIGGER) & np.uint64(EVERY - 1) == 0)


class Least:
    """The place of the least value in any stretch, by a table of doubling widths."""

    def __init__(self, values: np.ndarray, widest: int):
        self.rows = [(values & ~POSITION) | np.arange(len(values), dtype=np.uint64)]
        while 2 << len(self.rows) - 1 <= widest:
            above, half = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(above[:-half], above[half:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        level, out = np.frexp((end - start).astype(np.float64))[1] - 1, np.empty(len(start), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = (np.minimum(self.rows[k][start[at]], self.rows[k][end[at] - (1 << k)]) & POSITION).astype(np.int64)
        return out


def parsed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A window's anchor is the phrase of least hash (leftmost of equals) that it holds whole, or if none the window.

    The texts are laid end to end; a phrase that reaches over a text's end is in no window.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    long = np.flatnonzero(size >= LENGTH)
    if not len(long):
        return (np.empty(0, np.int64),) * 4
    data = np.concatenate([texts[i] for i in long])
    stop = np.cumsum(size[long])
    begin, over = stop - size[long], stop - LENGTH + 1
    h = Hashes(_LETTER[data])
    at = triggers(h)
    phrases = h.of(at[:-1], at[1:] + TRIGGER) if len(at) > 1 else np.empty(0, np.uint64)
    inside = LENGTH - TRIGGER
    # the phrases that a window holds change only where a trigger leaves or enters it
    edge = np.zeros(len(data) + 1, bool)
    for places in (begin, over, at + 1, at[np.searchsorted(at, inside) :] - inside):
        edge[places] = True
    start = np.flatnonzero(edge)
    text = np.searchsorted(begin, start, "right") - 1
    has = np.flatnonzero(start < over[text])
    start, end, text = start[has], start[has + 1], text[has]
    low, high = np.searchsorted(at, start), np.searchsorted(at, start + inside, "right") - 1
    held = high > low
    n = (end - start)[~held]
    bare, owner = np.repeat(start[~held] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(text[~held], n)
    out = [(*contexts_of(h, LENGTH, h.of(bare, bare + LENGTH), bare, bare, bare), owner)]
    if held.any():
        start, end, text = start[held], end[held], text[held]
        best = Least(phrases, int((high - low)[held].max())).of(low[held], high[held])
        new = np.flatnonzero((best != np.concatenate(([-1], best[:-1]))) | (start != np.concatenate(([-1], end[:-1]))))
        out.append((*contexts_of(h, LENGTH, phrases[best[new]], at[best[new]], start[new], end[np.append(new[1:], len(end)) - 1] - 1), text[new]))
    seed, context, place, owner = (np.concatenate(c) for c in zip(*out))
    return seed, context, place - (begin[owner] << 16), long[owner]


def parted(tokens: np.ndarray, before: int, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A context's stretches of windows with the same phrase of least hash over `floor` (leftmost of equals) and place of it; see Plan.part."""
    h, windows = Hashes(_LETTER[tokens]), np.arange(len(tokens) - LENGTH + 1)
    at = triggers(h)
    none = np.uint64(2**64 - 1)
    best = np.full(len(windows), -1)
    hashes = np.empty(0, np.uint64)
    if len(at) > 1:
        hashes = h.of(at[:-1], at[1:] + TRIGGER)
        fits = (at[:-1] >= windows[:, None]) & (at[1:] + TRIGGER <= windows[:, None] + LENGTH) & (hashes > np.array([floor]).view(np.uint64))
        found = np.where(fits, hashes, none)
        best = np.where(fits.any(axis=1), found.argmin(axis=1), -1)
    first = np.flatnonzero((best != np.concatenate(([-2], best[:-1]))) | (best < 0))
    last = np.append(first[1:], len(windows)) - 1
    phrase = best[first]
    bare = phrase < 0
    keys, floors = h.of(first, first + LENGTH), np.full(len(first), -1)
    held = phrase[~bare]
    keys[~bare] = hashes[held] + (at[held] - before).astype(np.uint64)
    floors[~bare] = hashes[held].view(np.int64)
    return keys, floors, first, last


class SuffixArray:
    """Ranks of all suffixes of many strings, laid end to end, by prefix doubling.

    levels[k] ranks suffixes by their first `width` * 2**k values; a suffix ends with its string, and an end comes before any
    value. A rank is the place at which its class starts, so that only classes of several suffixes are sorted again. Values
    below 255 can be taken eight at once.
    """

    def __init__(self, values: np.ndarray, left: np.ndarray, width: int = 1):
        self.left, self.width = left, width  # values from each place to its string's end
        if width == 8:
            padded, self.head = np.concatenate((values.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64))), np.zeros(len(values), np.uint64)
            for j in range(8):
                self.head |= np.where(left > j, padded[j : j + len(values)], np.uint64(0)) << np.uint64(56 - 8 * j)
            values = self.head
        _, of, counts = np.unique(values, return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - counts + 1).astype(np.int32)[of]
        self.levels, step, longest = [rank], width, int(left.max(initial=0))
        live = np.flatnonzero(counts[of] > 1)
        while step < longest and len(live):
            key = rank[live].astype(np.int64) * (len(rank) + 2)
            on = np.flatnonzero(left[live] > step)
            key[on] += rank[live[on] + step]
            order = np.argsort(key)
            live, key = live[order], key[order]
            old, place = rank[live], np.arange(len(live))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            was = np.concatenate(([True], old[1:] != old[:-1]))
            first = np.maximum.accumulate(np.where(new, place, 0))
            rank = rank.copy()
            rank[live] = old + first - np.maximum.accumulate(np.where(was, place, 0))
            self.levels.append(rank)
            if new.sum() == was.sum():  # as many classes as before: longer prefixes tell no more apart
                break
            starts = np.flatnonzero(new)
            live = live[np.repeat(np.diff(np.append(starts, len(live))) > 1, np.diff(np.append(starts, len(live))))]
            step *= 2

    @property
    def rank(self) -> np.ndarray:
        return self.levels[-1]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many values the suffixes at x and at y share from their start."""
        n, whole = np.zeros(len(x), np.int64), self.rank[x] == self.rank[y]
        n[whole] = self.left[x[whole]]
        live = np.flatnonzero(~whole)
        for k in range(len(self.levels) - 2, -1, -1):
            live = live[n[live] < np.minimum(self.left[x[live]], self.left[y[live]])]  # others have ended
            a, b = x[live] + n[live], y[live] + n[live]
            same = self.levels[k][a] == self.levels[k][b]
            n[live[same]] += np.minimum(self.width << k, self.left[a[same]])
        if self.width == 8:
            live = live[n[live] < np.minimum(self.left[x[live]], self.left[y[live]])]
            differ = self.head[x[live] + n[live]] ^ self.head[y[live] + n[live]]
            for j in range(56, 0, -8):
                n[live] += differ >> np.uint64(j) == 0
        return n


def may_share(before: list[bytes], after: list[bytes]) -> np.ndarray:
    """Places of the contexts that can share a window; the windows of all others occur once.

    Equal windows hold the same bytes on both sides of where their anchor begins. With at least `low` of them before it and fewer
    than `low` + STEP, they agree in `low` bytes before it and in over LENGTH - `low` - STEP from it on.
    """
    live = np.zeros(len(before), bool)
    for low in range(0, LENGTH, STEP):
        high = LENGTH - low - STEP + 1
        held = [b[:low] + a[:high] if len(b) >= low and len(a) >= high else None for b, a in zip(before, after)]
        often = Counter(held)
        often[None] = 0
        live |= np.fromiter(map(often.__getitem__, held), np.int64, len(held)) > 1
    return np.flatnonzero(live)


def shared_windows(seed: np.ndarray, before: list[bytes], after: list[bytes]) -> list[np.ndarray]:
    """Of some blocks' contexts, the windows that share LENGTH bytes with another; those that can't are not ordered."""
    out = [np.empty(0, np.int64)] * len(before)
    live = may_share(before, after).tolist()
    if live:
        for i, hits in zip(live, ordered_windows([before[i] for i in live], [after[i] for i in live])):
            out[i] = hits
    return out


def ordered_windows(before: list[bytes], after: list[bytes]) -> list[np.ndarray]:
    """The corpus order of the windows of some blocks, and which of them share LENGTH bytes with a neighbour in it.

    Blocks need not be told apart: windows of different ones differ.
    """
    texts = [b[::-1] + a for b, a in zip(before, after)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(size)
    of = np.repeat(np.arange(len(texts)), size)
    at = triggers(Hashes(_LETTER[data])) if len(data) >= TRIGGER else np.empty(0, np.int64)
    at = at[at + TRIGGER <= stop[of[at]]]

    # the parse: phrases from each trigger (a text's first one from its start) to the end of the next, or of the text
    start = np.unique(np.concatenate((stop - size, at)))
    text = of[start]
    end = np.where(np.append(text[1:], -1) == text, np.minimum(np.append(start[1:], 0) + TRIGGER, stop[text]), stop[text])
    raw, names = data.tobytes(), {}
    word = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(start.tolist(), end.tolist())], np.int64)

    entries = np.frombuffer(b"".join(names), np.uint8).astype(np.int64)
    lengths = np.array([len(n) for n in names], np.int64)
    first = np.cumsum(lengths) - lengths
    dictionary = SuffixArray(entries, np.repeat(first + lengths, lengths) - np.arange(len(entries)), 8)
    count = np.bincount(text, minlength=len(texts))
    parse = SuffixArray(dictionary.rank[first[word]], np.repeat(np.cumsum(count), count) - np.arange(len(text)))

    # windows: the rest of a phrase up to the window's first trigger, and the parse from there
    most, small = size - LENGTH + 1, np.int32  # a block's bytes are far fewer
    owner = np.repeat(np.arange(len(texts), dtype=small), most)
    local = np.arange(len(owner), dtype=small) - np.repeat((np.cumsum(most) - most).astype(small), most)
    place = (stop - size).astype(small)[owner] + local
    next_ = np.searchsorted(at, place).astype(small)
    known = np.append(at, len(data))[next_] + TRIGGER <= np.minimum(place + LENGTH, stop[owner])
    owner, local, place, next_ = owner[known], local[known], place[known], next_[known]
    tail = np.searchsorted(start, at[next_]).astype(small)  # the parse from the first trigger on
    inner = np.maximum(tail - 1, 0)
    rest = np.where(at[next_] > place, dictionary.rank[np.minimum(first[word[inner]] + place - start[inner], len(entries) - 1)], small(0))
    del known, next_, inner

    order = np.lexsort((parse.rank[tail], rest)).astype(small)
    near = rest[order[:-1]] == rest[order[1:]]
    x, y = order[:-1][near], order[1:][near]
    del order, near, rest
    phrases = parse.common(tail[x], tail[y])
    bytes_ = np.empty(len(x), small)
    ended = phrases >= np.minimum(parse.left[tail[x]], parse.left[tail[y]])
    short = np.where(parse.left[tail[x]] <= parse.left[tail[y]], x, y)
    bytes_[ended] = (stop[owner[short]] - place[short])[ended]
    a, b = (tail[x] + phrases)[~ended], (tail[y] + phrases)[~ended]
    bytes_[~ended] = start[a] - place[x[~ended]] + dictionary.common(first[word[a]], first[word[b]])
    found = np.zeros(len(place), bool)
    good = bytes_ >= LENGTH
    found[x[good]] = found[y[good]] = True

    of, hits = owner[found], np.array([len(b) for b in before], np.int64)[owner[found]] - local[found]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return [hits[a:b][::-1] for a, b in zip(cuts[:-1], cuts[1:])]


BYTES = Plan("bytes", LENGTH, lambda raw: np.frombuffer(raw, np.uint8), lambda tokens: _LETTER[tokens], lambda tokens: parsed([tokens])[:3], shared_windows, 2_000, parted, parsed)
OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_bytes(raw: bytes, low: np.ndarray, high: np.ndarray) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(raw)])) if len(low) else raw


def digest(raw: bytes, gone: Gone) -> tuple:
    low, high = gone.spans(len(raw))
    return len(raw), int((high - low).sum()), len(low), hashlib.sha256(kept_bytes(raw, low, high)).hexdigest()


def dedup_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    return removed(BYTES, docs, F.col(doc_id), text, digest, OUT, crowd).withColumnRenamed("own", "doc_id")


def cut_repeats(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", crowd: int = CROWD) -> DataFrame:
    """docs with their repeated bytes cut out of the text; what is left of a character cut in two goes with it."""

    def left(raw: bytes, gone: Gone) -> tuple:
        kept = kept_bytes(raw, *gone.spans(len(raw))).decode("utf-8", "ignore")
        return kept, len(kept)

    cut = removed(BYTES, docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)), text, left, "kept string, kept_chars long", crowd)
    made = {text: F.col("kept"), n_chars: F.col("kept_chars")}
    return cut.select(*(made.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"))
