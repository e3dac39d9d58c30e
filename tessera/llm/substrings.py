"""Substring dedup over words: seed and extend.

Documents are joined on winnowed anchors (seeds of SEED words, at least one in each window), matches are extended
both ways from the anchor, and what repeats over LENGTH words or more is removed from every document that holds it.
See repeats for the steps and their bounds.

Nulls and texts without words: nothing to remove; a null doc_id is kept. Texts shorter than LENGTH words are kept.
Repeated rows and equal texts: removed as a whole if they have a window. Overlaps count, also within one text. Very
long texts: linear. No rows: none. Extra columns: ignored, whatever their names. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.repeats import CROWD, POSITION, Gone, Hashes, Plan, contexts_of, mix, removed

LENGTH, SEED = 35, 8
SPREAD = LENGTH - SEED + 1
_LETTER = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.int64).view(np.uint64)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_tokens(raw: bytes) -> np.ndarray:
    """A hash of each word."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([True], _BLANK[data], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return mix(Hashes(_LETTER[data]).of(start, end) ^ (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def winnowed(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A window's anchor is the seed of least hash in it, leftmost of equals."""
    h = Hashes(tokens)
    grams = h.grams(SEED)
    keyed = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(keyed, SPREAD) & POSITION).astype(np.int64)  # window -> its anchor
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return contexts_of(h, LENGTH, grams[at[first]], at[first], first, np.append(first[1:], len(at)) - 1)


def matrix(parts: list[bytes], kind: np.dtype, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Token rows padded with zeros, and their lengths."""
    length = np.fromiter(map(len, parts), np.int64, len(parts)) // kind.itemsize
    rows = np.frombuffer(b"".join(p.ljust(width * kind.itemsize, b"\0") for p in parts), kind).reshape(len(parts), width)
    return rows, length


def extended(seed: np.ndarray, before: list[bytes], after: list[bytes]) -> list[np.ndarray]:
    """Matches extended both ways: contexts are sorted by what follows the anchor, so that a row's longest common
    continuation is with a neighbour, and split step by step by what precedes it. A window with `a` words before its
    anchor repeats if a neighbour in the same class continues alike for the other LENGTH - a words."""
    kind, n = np.dtype(np.uint64), len(seed)
    left, left_n = matrix(before, kind, SPREAD - 1)
    right, right_n = matrix(after, kind, LENGTH)
    wide = LENGTH * kind.itemsize
    order = np.argsort(np.ascontiguousarray(right.astype(kind.newbyteorder(">"))).view(f"S{wide}").ravel(), kind="stable")
    order = order[np.argsort(seed[order], kind="stable")]
    left, left_n, right, right_n, group = left[order], left_n[order], right[order], right_n[order], seed[order]
    # common continuation with the row above, and of any two rows: the least in between
    differs = np.concatenate((right[1:] != right[:-1], np.ones((n - 1, 1), bool)), axis=1)
    common = np.minimum(differs.argmax(axis=1), np.minimum(right_n[1:], right_n[:-1]))
    levels = [np.append(0, np.where(group[1:] == group[:-1], common, 0)).astype(np.int32)]
    while 1 << len(levels) < n:
        prev, step = levels[-1], 1 << len(levels) - 1
        levels.append(np.minimum(prev[:-step], prev[step:]))
    table = np.zeros((len(levels), n), np.int32)
    for i, level in enumerate(levels):
        table[i, : len(level)] = level

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = np.frexp((j - i + 1).astype(np.float64))[1] - 1
        return np.minimum(table[size, i], table[size, j - (1 << size) + 1])

    found = np.zeros((n, SPREAD), bool)
    rows, cls = np.arange(n), np.unique(group, return_inverse=True)[1]
    for a in range(SPREAD):
        if a:
            long = left_n[rows] >= a
            rows, cls = rows[long], cls[long]
            token = np.unique(left[rows, a - 1], return_inverse=True)[1]
            cls = np.unique(cls * (int(token.max(initial=0)) + 1) + token, return_inverse=True)[1]
        shared = np.bincount(cls)[cls] > 1 if len(cls) else np.empty(0, bool)
        rows, cls = rows[shared], cls[shared]
        if not len(rows):
            break
        together = np.argsort(cls, kind="stable")
        i, c = rows[together], cls[together]
        same = np.flatnonzero(c[1:] == c[:-1])
        upper, lower = i[same], i[same + 1]
        good = least(upper + 1, lower) >= LENGTH - a
        found[upper[good], a] = found[lower[good], a] = True
    out = np.empty_like(found)
    out[order] = found
    return [np.flatnonzero(row) for row in out]


WORDS = Plan("words", LENGTH, word_tokens, lambda tokens: tokens, winnowed, extended)
OUT = "n_words long, n_removed long, kept_sha256 string"


def digest(raw: bytes, found: Gone) -> tuple:
    words = raw.split()
    gone = found.mask(len(words))
    kept = compress(words, ~gone) if gone.any() else words
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def dedup_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    return removed(WORDS, docs, F.col(doc_id), text, digest, OUT, crowd).withColumnRenamed("own", "doc_id")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents"))


ORACLE_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH}),
h AS (SELECT rid, i, md5(array_to_string(list_slice(w, i, i + {LENGTH - 1}), ' ')) AS k FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM h) WHERE c > 1),
p AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
m AS (SELECT p.rid, p.p, word, coalesce(p.p - r.i < {LENGTH}, false) AS gone FROM p ASOF LEFT JOIN r ON p.rid = r.rid AND p.p >= r.i),
k AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM m GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
