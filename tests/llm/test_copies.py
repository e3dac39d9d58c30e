"""Near copies against the Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest

from tessera.llm import simhash

SCHEMA = "doc_id long, text string"


def shingles(text: str, size: int = 5) -> set:
    w = text.encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a: set, b: set) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(docs: list[tuple]) -> list[int]:
    sets, groups = [shingles(t) for _, t in docs], simhash.Forest(len(docs))
    for i in range(len(docs)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                groups.join(i, j)
    return [docs[i][0] for i in range(len(docs)) if groups.find(i) == i]


def kept(spark, docs: list[tuple]) -> list[int]:
    return sorted(r.doc_id for r in simhash.without_copies(spark.createDataFrame(docs, SCHEMA)).collect())


def edited(r: random.Random, words: list[str], n: int) -> str:
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"e{r.randrange(10**6)}"
    return " ".join(out)


def family(seed: int, n: int, length: int, edits: tuple[int, int]) -> list[tuple]:
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(length)]
    return [(i, edited(r, base, r.randint(*edits))) for i in range(n)]


def test_template_family(spark):
    docs = family(1, 400, 200, (3, 6))
    want = brute_kept(docs)
    assert 1 < len(want) < 400
    assert kept(spark, docs) == want


def test_no_copy_near_the_limit_is_missed(spark):
    r = random.Random(7)
    bases = [[f"w{r.randrange(10**6)}" for _ in range(100)] for _ in range(500)]
    docs = [(i, " ".join(b)) for i, b in enumerate(bases)] + [(1000 + i, edited(r, b, 2)) for i, b in enumerate(bases)]
    assert all(alike(shingles(a[1]), shingles(b[1])) for a, b in zip(docs[:500], docs[500:]))
    assert kept(spark, docs) == list(range(500))


def test_equal_fingerprints_are_no_proof(spark):
    made = family(1, 600, 200, (4, 4))
    docs = [made[566], made[595]]  # similarity 0.75, but equal in the first 64 bits of a SimHash over several words
    assert kept(spark, docs) == brute_kept(docs) == [566, 595]


@pytest.mark.parametrize(("small", "rounds", "plenty", "slot"), [(64, 8, 4, 256), (3, 2, 0, 4)])
def test_dense_groups_at_any_bucket_size(spark, monkeypatch, small, rounds, plenty, slot):
    """Groups of variants around the limit: refused pairs must not part what other pairs join, whole buckets or stars."""
    for name, value in (("SMALL", small), ("ROUNDS", rounds), ("PLENTY", plenty), ("SLOT", slot)):
        monkeypatch.setattr(simhash, name, value)
    docs = family(11, 120, 150, (2, 5))
    for g in range(12):
        docs += [(1000 + 8 * g + i, t) for i, t in family(100 + g, 8, 100, (1, 3))]
    assert kept(spark, docs) == brute_kept(docs)


def test_odd_rows_and_clashing_columns(spark):
    names = ["k1", "k2", "_id", "id", "own", "none", "n", "body", "r", "u", "v", "owner", "fp", "c0", "slot", "a.b"]
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b c d e f"), (2, None), (3, ""), (None, " \t"), (4, "A b c d e f"), (4, "A b c d e f"), (5, long), (6, long + " more"), (None, "x y z"), (7, "x y z"), (8, "x y")]
    df = spark.createDataFrame([(*r, *("x",) * len(names)) for r in rows], f"{SCHEMA}, " + ", ".join(f"`{n}` string" for n in names))
    out = simhash.without_copies(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted((r.doc_id, (r.text or "")[:11]) for r in got) == [(1, "a b c d e f"), (2, ""), (5, "w0 w1 w2 w3"), (7, "x y z"), (8, "x y")]
    assert all(r["a.b"] == r.k1 == "x" for r in got) and [r.text for r in got if r.doc_id == 2] == [None]
    assert simhash.without_copies(df.limit(0)).count() == 0


def test_sketches_differ_no_more_than_the_sets(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 7)
    r = np.random.default_rng(3)
    pool = r.integers(0, 2**63, 6000).astype(np.uint64)
    sets = [np.unique(r.choice(pool[: max(2 * n, 1)], n)) for n in [0, 1, 3, 200, 300, 600, 900, 1500, 3000, 5000] for _ in range(3)]
    sketches = simhash.Sketches(np.array([simhash.sketch(s) for s in sets], object))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    got = sketches.differ(a, b)
    assert (got <= apart).all() and len({len(simhash.sketch(s)) for s in sets}) == 3
    assert (got[(apart > 0) & (apart < 20)] > 0).any() and not got[a == b].any()


@pytest.mark.parametrize("edits", [(12, 12), (1, 2)])
def test_pairs_tried_do_not_grow_with_the_square_of_a_group(spark, monkeypatch, edits):
    """A group of 300 texts whose pairs all share shingles, far under the limit and over it: 44,850 pairs."""
    tried, real = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *a: (tried.append(pairs.count()), real(pairs, *a))[1])
    docs = family(5, 300, 150, edits)
    assert kept(spark, docs) == brute_kept(docs)
    assert sum(tried) <= 4 * len(docs)
