"""The cache's budget and its copy against plain loops."""

import random

import pytest

from tessera.sources import cache


@pytest.mark.parametrize("entries, budget", [(500, 10**9), (3, 10**9), (500, 40), (4, 25), (0, 10)])
def test_kept(spark, entries, budget):
    r = random.Random(entries + budget)
    log = [(r.choice(["a", "a", "a", None]), r.choice("klmnopqr"), i) for i in range(60)]
    sizes = {k: r.choice([0, 5, 9, 30]) for k in "klmnopqr"}
    want = {}
    for scope, key, _ in log:  # one write after the other
        held = want.setdefault(scope, {})
        held.pop(key, None)
        held[key] = sizes[key]
        while held and (len(held) > entries or sum(held.values()) > budget):
            held.pop(next(iter(held)))
    got = cache.kept(spark.createDataFrame([(s, k, at, sizes[k]) for s, k, at in log], "scope string, key string, at int, size int").repartition(3), entries, budget)
    assert {(t.scope, t.key) for t in got.collect()} == {(s, k) for s, held in want.items() for k in held}


def test_copy_round_trip(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), f"p{i:03}", f"k{i}" if i % 11 else None, "ü" * r.randrange(12)) for i in range(120)]
    want, used = set(), {}
    for scope, path, key, payload in sorted(rows, key=lambda t: t[:2]):
        n, b = used.get(scope, (0, 0))
        if key and n < 20 and b + len(payload.encode()) <= 150:
            used[scope] = n + 1, b + len(payload.encode())
            want.add((scope, path, key, payload))
    copy = cache.copied(spark.createDataFrame(rows, "scope string, path string, key string, payload string").repartition(5), "v1", 20, 150).cache()
    assert {(t.scope, t.path, t.key, t.payload) for t in copy.where("saved").collect()} == want and copy.count() == sum(t[2] is not None for t in rows)
    files = spark.createDataFrame([(s, p, k if n % 3 else "changed") for n, (s, p, k, _) in enumerate(rows)], "scope string, path string, key string")
    back = {(t.scope, t.path, t.key, t.payload) for t in cache.restored(copy, files, "v1").collect()}
    assert back == want & {(s, p, k, c) for n, (s, p, k, c) in enumerate(rows) if n % 3} and back
    assert cache.restored(copy, files, "v2").count() == 0
