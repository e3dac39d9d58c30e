"""Traversals against plain implementations and cases with known answers."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import graph
from tessera.operators.components import components


def frame(spark, pairs, cols="source string, target string"):
    return spark.createDataFrame([tuple(p) for p in pairs], cols)


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_neighbourhood_with_cycle(spark):
    e = frame(spark, ["ab", "bc", "ca", "cd", "xx"])
    one = {r.node: r.distance for r in graph.bounded_bfs(e, nodes(spark, "a"), 1, "both").collect()}
    two = {r.node: r.distance for r in graph.bounded_bfs(e, nodes(spark, "a"), 2, "both").collect()}
    assert one == {"a": 0, "b": 1, "c": 1} and two == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_change_impact_confidence(spark):
    rows = [("service", "core", "resolved"), ("ui", "service", "inferred"), ("service", "ui", "resolved"), ("x", "core", "ambiguous")]
    e = spark.createDataFrame(rows, "source string, target string, resolution string")
    got = {r.node: (r.distance, r.confidence) for r in graph.change_impact(e, nodes(spark, "core")).collect()}
    assert got == {"service": (1, "high"), "ui": (2, "medium")}
    assert [r.node for r in graph.possible_direct(e, nodes(spark, "core")).collect()] == ["x"]


def test_migration_order_marks_cycles(spark):
    e = frame(spark, ["ab", "bc", "de", "ed", "ef"])
    got = {r.node: (r.batch, r.in_cycle) for r in graph.migration_order(nodes(spark, *"abcdef"), e).collect()}
    assert got == {"a": (1, False), "b": (2, False), "c": (3, False), "d": (4, True), "e": (4, True), "f": (4, True)}


pairs = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=18)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(pairs)
def test_components_and_cycles(spark, edges):
    reach = defaultdict(set)
    for a in range(10):
        todo = [a]
        while todo:
            n = todo.pop()
            for s, t in edges:
                if s == n and t not in reach[a]:
                    reach[a].add(t)
                    todo.append(t)
    scc = {a: min(b for b in range(10) if (b in reach[a] and a in reach[b]) or b == a) for a in range(10)}
    want = {a: c for a, c in scc.items() if a in reach[a]}  # an edge to itself is a cycle too
    got = graph.strongly_connected(frame(spark, edges, "source int, target int"))
    assert {r.node: r.component for r in got.collect()} == want
    up = list(range(10))
    for _ in range(10):
        for s, t in edges:
            up[s] = up[t] = min(up[s], up[t])
    live = {x for s, t in edges if s != t for x in (s, t)}
    got = components(frame(spark, edges, "u int, v int"))
    assert {r.node: r.component for r in got.collect()} == {n: up[n] for n in live}


def test_greedy_trace_does_not_return(spark):
    e = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "a", 9), ("b", "c", 1)], "source string, target string, weight int")
    got = sorted((r.hop, r.node) for r in graph.greedy_trace(e, nodes(spark, "a")).collect())
    assert got == [(0, "a"), (1, "b"), (2, "c")]


def test_loops_condensation_and_layers(spark):
    edges = [(1, 2), (2, 1), (3, 3), (2, 3), (2, 3), (3, 4), (1, 4), (4, 5), (5, 6), (6, 4), (6, 7), (8, 7), (9, 9)]
    e = frame(spark, edges, "source int, target int")
    assert {tuple(r) for r in graph.strongly_connected(e).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4), (9, 9)}
    nodes, links = graph.condensation(e)
    assert {(r.node, r.component, r.layer) for r in nodes.collect()} == {(1, 1, 0), (2, 1, 0), (3, 3, 1), (4, 4, 2), (5, 4, 2), (6, 4, 2), (7, 7, 3), (8, 8, 0), (9, 9, 0)}
    assert {tuple(r) for r in links.collect()} == {(1, 3, 2), (3, 4, 1), (1, 4, 1), (4, 7, 1), (8, 7, 1)}
    got = {tuple(r[:5]): r.members for r in graph.cycle_summaries(e, 2).collect()}
    assert got == {(1, 2, 2, 0, 2): [1, 2], (3, 1, 1, 1, 1): [3], (4, 3, 3, 2, 1): [4, 5], (9, 1, 1, 0, 0): [9]}


def test_unreachable_in_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(25)] + [(40, 41)]
    nodes = spark.createDataFrame([(i,) for i in [*range(26), 40, 41]], "node int")
    e, roots = frame(spark, chain, "source int, target int"), nodes.where("node = 0")
    assert {r.node for r in graph.unreachable(nodes, e, roots).collect()} == {40, 41}
    assert {r.node for r in graph.unreachable(nodes, e, roots, 3).collect()} == {*range(4, 26), 40, 41}


def walked(edges, start, depth, most, visits):
    """The same search one state after the other."""
    after = {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)
    if start not in {n for e in edges for n in e}:
        return [], "not-found"
    queue, paths, cut, at = [[start]], [], False, 0
    while at < len(queue) and len(paths) < most:
        path, at = queue[at], at + 1
        more = [b for b in after.get(path[-1], []) if b not in path]
        if not more or len(path) > depth:
            paths += [path] if len(path) > 1 else []
            cut |= bool(more)
            continue
        for b in more:
            if len(queue) >= visits:
                cut = True
                break
            queue.append([*path, b])
    return paths, "partial" if cut or at < len(queue) else "complete"


@pytest.mark.parametrize("depth, most, visits", [(6, 30, 12_000), (3, 4, 12_000), (4, 30, 25), (1, 2, 3), (5, 1, 10)])
def test_first_paths(spark, depth, most, visits):
    r = random.Random(depth * 100 + most)
    nodes = [f"n{i:02}" for i in range(16)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(26)] + [("hub", n) for n in nodes] + [("a", "b"), ("b", "a"), ("loop", "loop")]
    starts = [*nodes, "hub", "a", "loop", "gone"]
    got = graph.first_paths(spark.createDataFrame(edges * 2, "source string, target string"), spark.createDataFrame([(s,) for s in starts], "node string"), depth, most, visits).collect()
    for s in starts:
        paths, status = walked(edges, s, depth, most, visits)
        mine = [t for t in got if t.start == s]
        assert sorted(t.path for t in mine if t.path) == sorted(paths), s
        assert {t.status for t in mine} == {status}, s
