"""Innermost spans against a search by hand."""

import random

import pytest

from tessera.operators import linkage


@pytest.mark.parametrize("seed", range(3))
def test_innermost(spark, seed):
    r = random.Random(seed)
    keys = ["a", "a", "a", "b", None]
    spans = [(r.choice(keys), f"s{i % 40}", a := r.randrange(60), a + r.randrange(-2, 25)) for i in range(120)]
    spans += [(k, s, a, b) for k, s, a, b in spans[:5]] + [("a", None, 0, 99)]
    points = [(r.choice([*keys, "none"]), i, r.choice([r.randrange(70), None if i % 9 == 0 else 7])) for i in range(200)]
    want = []
    for k, i, at in points:
        held = [(b - a, s) for q, s, a, b in spans if k is not None and q == k and s is not None and at is not None and a <= at <= b]
        want.append((i, min(held)[1] if held else None))
    p = spark.createDataFrame(points, "file string, point long, at int").repartition(3)
    s = spark.createDataFrame(spans, "file string, span string, start int, end int").repartition(3)
    got = linkage.innermost(p, s, "file")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_no_rows(spark):
    p, s = spark.createDataFrame([], "f string, point string, at int"), spark.createDataFrame([], "f string, span long, start int, end int")
    assert linkage.innermost(p, s, "f").count() == 0
