"""Queries over the whole graph against plain Python."""

from collections import defaultdict

from conftest import DATA

from tessera.operators import contracts
from tessera.plans import catalog
from tessera.sources import views


def test_components_of_all_edges(spark):
    up: dict[str, str] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in views.edges(spark, DATA).select("source", "target").collect():
        a, b = sorted((find(r.source), find(r.target)))
        up[b] = a
    want = {n: find(n) for n in list(up)}
    assert any(n.startswith("part/") for n in want)
    assert {r.node: r.component for r in catalog.QUERIES["connected_components"](spark, DATA).collect()} == want


def test_rerank_by_hops_along_all_edges(spark):
    sf = DATA.replace("0.001", "0.01")
    near, hops, front = defaultdict(set), {"nation/3": 0}, {"nation/3"}
    for r in views.edges(spark, sf).select("source", "target").collect():
        near[r.source].add(r.target)
        near[r.target].add(r.source)
    for d in (1, 2, 3):
        front = {b for a in front for b in near[a]} - set(hops)
        hops |= dict.fromkeys(front, d)
    s = sorted(((r.s_acctbal / 10000, f"supplier/{r.s_suppkey}") for r in views.table(spark, sf, "supplier").collect()), key=lambda x: (-x[0], x[1]))[:48]
    want = sorted(((v + (0.15 / (1 + hops[p]) if p in hops else 0), v, p) for v, p in s), key=lambda x: (-x[0], -x[1], x[2]))[:8]
    got = catalog.QUERIES["graph_rerank"](spark, sf).collect()
    assert sorted((r.path, r.score) for r in got) == sorted((p, round(x, 6)) for x, _, p in want)


def test_impact_keeps_all_that_depends_on_a_change(spark):
    n, changed = 1_200, spark.createDataFrame([("a",)], "node string")
    edges = spark.createDataFrame([(f"n{i}", "a", "resolved") for i in range(n)], "source string, target string, resolution string")
    got = contracts.engineering_impact(edges, changed, spark.createDataFrame([("n7", "r")], "node string, rule string")).collect()
    assert sorted((r.node, r.hops, tuple(r.rules), r.status) for r in got) == sorted([("a", 0, (), "complete"), *((f"n{i}", 1, ("r",) if i == 7 else (), "complete") for i in range(n))])


def test_all_callers_of_a_changed_function_are_kept(spark):
    n = 2_100
    calls = spark.createDataFrame([(f"n{i}", "a", "resolved") for i in range(n)] + [("far", "n3", "resolved")], "caller string, target string, resolution string")
    got = contracts.caller_impact(calls, spark.createDataFrame([("a",)], "function string")).collect()
    want = [*((f"n{i}", 1, "direct-caller", ("a", f"n{i}"), "complete") for i in range(n)), ("far", 2, "transitive-caller", ("a", "n3", "far"), "complete")]
    assert sorted((r.function, r.hops, r.relationship, tuple(r.via), r.status) for r in got) == sorted(want)
