"""What only shows on more rows than the small tables have."""

import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import nearest
from tessera.operators import extract, flows, graph, model
from tessera.plans import catalog, storage
from tessera.sources import views
from conftest import DATA

MEASURED_QUERIES = [
    "code_calls",
    "code_caller_impact",
    "code_dead_functions",
    "code_duplicate_calls",
    "code_endpoint_flows",
    "code_engineering_impact",
    "code_error_handling",
    "code_imports",
    "code_inheritance",
    "code_issues",
    "code_test_functions",
    "entry_points",
    "normalized_findings",
    "code_parameter_flows",
]


def test_signals_beyond_the_limit_are_marked_not_cut(spark):
    files = [(f"srv/c{i}.js", "router.post('/a', f);\nrouter.get('/b', f);\n") for i in range(5)]
    got = model.framework_signals(spark.createDataFrame(files, "path string, content string"), 3).collect()
    assert sorted((r.framework, r.path, r.line) for r in got) == sorted(("express", p, n) for p, _ in files for n in (1, 2))
    assert {r.status for r in got} == {"partial"}


def test_joins_follow_what_shuffles_measured_not_files(spark):
    @storage.measured
    def query(spark, sf_dir):
        k, big = F.col("id"), F.repeat(F.lit("text made from a template "), 40)
        many = storage.stored(spark.range(40_000).select(k, big.alias("content")), "many")  # 40 MB in a small file
        plans.append(joined := many.join(many.withColumnRenamed("content", "other"), "id"))
        joined.collect()
        return joined

    plans = []
    before = spark.conf.get(storage.STATIC)
    out = query(spark, DATA)
    assert out.count() == 40_000 and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(storage.STATIC) == before


@pytest.mark.parametrize("name", MEASURED_QUERIES)
def test_query_is_planned_by_measured_sizes(spark, monkeypatch, name):
    class Reached(Exception):
        pass

    def first_store(session):
        raise Reached(session.conf.get(storage.STATIC))

    monkeypatch.setattr(storage, "shared_dir", first_store)
    with pytest.raises(Reached, match="^-1$"):
        catalog.QUERIES[name](spark, DATA)


def test_a_full_block_of_queries_is_searched_in_slices():
    rng = np.random.default_rng(3)
    frame = lambda n, at: pd.DataFrame({"vec_id": range(at, at + n), "v": list(rng.standard_normal((n, 8)))})
    q, c = frame(4_096, 0), frame(2_048, 10_000)
    tracemalloc.start()
    got = nearest.search(q, c, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # one table of all pairs is 67 MB, and there are several
    scores = np.stack(q["v"].to_list()) @ np.stack(c["v"].to_list()).T
    want = {(i, 10_000 + int(j)) for i, row in enumerate(scores) for j in np.argsort(-row)[:5]}
    assert set(zip(got["query_id"], got["vec_id"])) == want


def test_no_pattern_is_compiled_for_each_function(monkeypatch):
    names = ["first", "a$b", "_x", "second", "né", "f1"]
    for code in ("function NAME(a, b = 1, ...c) {", "xNAME(z) NAME = async function k (a, b) {", "const NAME = (a) => 1", "const NAME = a => 1", "NAME.x(q); NAME: function (a) {", "none(a)", "#NAME (a)"):
        for name in names:
            text = code.replace("NAME", name)
            m = re.search(rf"\b{re.escape(name)}\b\s*(?:[:=]\s*(?:async\s*)?(?:function\s*\w*\s*)?)?(\(|\w+\s*=>)", text)
            ends = [end for end in flows.whole_words(text, name) if flows.DECLARED.match(text, end)]
            assert (m.start(1), m[1]) == (flows.DECLARED.match(text, ends[0]).start(1), flows.DECLARED.match(text, ends[0])[1]) if m else not ends
    compiled = []
    monkeypatch.setattr(flows.re, "_compile", lambda pattern, flags, f=re._compile: (compiled.append(pattern), f(pattern, flags))[1])
    for name in names:
        flows.parameters(f"function {name}(a, b) {{", name, "javascript")
    assert not any(re.escape(n) in str(p) for p in compiled for n in names)


def test_flows_without_traces_are_the_same_and_sort_nothing(spark, monkeypatch):
    calls = spark.range(3_000).select((F.col("id") % 60).alias("caller"), (F.col("id") * 7 % 53).alias("callee"))
    f = lambda *n: spark.createDataFrame([(x,) for x in n], "function long")
    written, store = [], storage.stored
    for module in (model, graph):
        monkeypatch.setattr(module, "stored", lambda df, name: (written.append(df), store(df, name))[1])
    bare = model.flows_across_calls(f(1, 2, 59, 99), calls, f(3, 5, 99), traces=False)
    assert not any("array" in t for df in written for _, t in df.dtypes)
    assert {tuple(r) for r in bare.collect()} == {tuple(r)[:2] for r in model.flows_across_calls(f(1, 2, 59, 99), calls, f(3, 5, 99)).collect()}


def test_files_made_from_one_row_group_are_dealt_out(spark, monkeypatch):
    for made in (views.code, views.flow_code):
        whole = sorted(map(tuple, made(spark, DATA).collect()))
        with monkeypatch.context() as m:
            m.setattr(views, "KEYS_A_PARTITION", 40)
            files = made(spark, DATA)
            sizes = files.groupBy(F.spark_partition_id()).count().collect()
            assert len(sizes) > 3 and max(r["count"] for r in sizes) < len(whole) / 2
            assert sorted(map(tuple, files.collect())) == whole


@pytest.mark.parametrize("kinds", [{"function", "class"}, {"client", "endpoint"}, extract.FOR_IMPORTS, extract.FOR_CALLS | extract.FOR_HANDLERS, {"diagnostic", "flow"}])
def test_facts_of_some_kinds_are_those_of_all(kinds, monkeypatch):
    files = [("a.py", "import b\n@app.get('/x')\ndef f(:\n  pass\n"), ("b.js", "import { f } from './a';\nfunction g(x) {\n  return fetch(`/n/${x}`);\n}}\n"), ("package.json", "{"), ("q/package.json", '{"name": "q", "dependencies": {"x": "1"}}'), ("C.java", "package p;\n@Entity\npublic class C extends D {\n  private int x;\n}\n")]
    ran = []
    for name in ("shared_facts", "flow_facts", "manifest_facts"):
        monkeypatch.setattr(extract, name, lambda *a, name=name, f=getattr(extract, name): (ran.append(name), f(*a))[1])
    every = {p: extract.file_facts(p, c) for p, c in files}
    assert len(ran) == 3 * len(files)
    ran.clear()
    for p, c in files:
        assert extract.file_facts(p, c, frozenset(kinds)) == [f for f in every[p] if f[0] in kinds]
    if kinds == {"function", "class"}:
        assert not ran


def test_pairs_of_flows_are_made_at_the_end_alone(spark, monkeypatch):
    n, hops, near = 2_500, 3, {}
    calls = [(i, (i * 7 + j * 31) % n) for i in range(n) for j in range(4)] + [(n + 1, 5), (None, 1), (2, None)]
    for a, b in calls:
        if None not in (a, b) and a != b:
            near.setdefault(a, set()).add(b)
    sources, sinks = [*range(0, n, 2), n + 1, n + 2], [*range(0, n, 3), *range(1, n, 3), n + 2, None]
    want = set()
    for s in sources:
        seen = front = {s}
        for _ in range(hops):
            front = {b for a in front for b in near.get(a, ())} - seen
            seen = seen | front
        want |= {(s, t) for t in seen.intersection(sinks)}
    counts, store = [], storage.stored
    for module in (model, graph):
        monkeypatch.setattr(module, "stored", lambda df, name: (out := store(df, name), counts.append(out.count()))[0])
    monkeypatch.setattr(model, "NUMBERED", 600, raising=False)  # several groups
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "function long")
    got = model.flows_across_calls(frame(sources), spark.createDataFrame(calls, "caller long, callee long"), frame(sinks), hops, traces=False).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert max(counts) < len(want) / 3
