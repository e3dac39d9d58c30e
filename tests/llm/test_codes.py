"""Vector codes against plain loops over whole numbers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import codes


def by_hand(rows, parts=16, entries=64, rounds=2):
    kept = []
    for vec_id, x, label in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [max(-(1 << 24), min(1 << 24, math.floor(256 * c))) for c in x], label))
    if not kept:
        return []
    d = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    cut = lambda v: [(v + [0] * (parts * d))[p * d : (p + 1) * d] for p in range(parts)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    all_parts = [cut(v) for _, v, _ in kept]
    books = [[list(x[p]) for x in all_parts[:entries]] for p in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for x in all_parts:
                own[near(x[p], books[p])[1]].append(x[p])
            for i, members in own.items():
                books[p][i] = [sum(c) // len(members) for c in zip(*members)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    best = [[near(x[p], books[p]) for p in range(parts)] for x in all_parts]
    total = defaultdict(int)
    for (_, _, label), b in zip(kept, best):
        total[label] += sum(e for e, _ in b)
    return [(r[0], "".join(f"{i:02x}" for _, i in b), sum(e for e, _ in b), total[r[2]], sha) for r, b in zip(kept, best)]


def vectors(seed, n, dim, ties):
    r = random.Random(seed)
    draw = (lambda: r.choice([-0.01, 0.0, 0.004, 0.01])) if ties else (lambda: r.gauss(0, 0.1))
    rows = [(r.randrange(n * 3), [draw() for _ in range(dim)], r.choice([1, 2, 2, 2, None])) for _ in range(n)]
    rows += rows[:5] + [(None, [draw() for _ in range(dim)], 9), (None, None, 1), (-1, [float("nan")] * dim, 1), (-2, [None] + [0.0] * (dim - 1), 1)]
    return [*rows, (-3, [float("-inf")] * dim, 2), (-4, [3e38] * dim, 3), (-5, [0.0] * dim, None), (-6, [], 4), (7, [0.5] * (dim - 1), 5)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(b, c, a, 1, "x") for a, b, c in rows], "embedding array<double>, label int, vec_id long, part int, n string").repartition(3)
    coded, books = codes.compressed(df, **more)
    sha = codes.digest(books)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, sha) for r in codes.with_label_errors(coded).collect()), key=repr)


@pytest.mark.parametrize("n,dim,ties,entries,parts", [(220, 64, False, 64, 16), (200, 32, True, 64, 16), (12, 16, True, 64, 16), (90, 10, False, 5, 4), (60, 150, False, 8, 2)])
def test_codes(spark, n, dim, ties, entries, parts):
    rows = vectors(n, n, dim, ties)
    assert run(spark, rows, entries=entries, parts=parts) == sorted(by_hand(rows, parts, entries), key=repr)


def test_none(spark):
    assert run(spark, []) == run(spark, [(1, None, 2)]) == []


@pytest.mark.parametrize("bits", [0, 1, 4, 8])
def test_bounds_are_sure(bits):
    r = np.random.default_rng(bits)
    entries, q = r.integers(-40, 40, (64, 4)), r.integers(-60, 60, (500, 4))
    f = codes.VaFile(entries, bits)
    lower, upper = f.bounds(q)
    true = ((q[:, None] - entries) ** 2).sum(2)
    assert (lower <= true).all() and (true <= upper).all()
    entry, least = f.nearest(q)
    assert (entry == true.argmin(1)).all() and (least == true.min(1)).all()
    if bits == 4:
        assert (lower <= upper.min(1)[:, None]).mean() < 0.3  # most entries are out before their distance is computed


def test_same_as_sql(spark, agree):
    agree(codes.op13_codes, codes.ORACLE_OP13)
