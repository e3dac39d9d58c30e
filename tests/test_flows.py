"""Flows by parameters: bindings, hops, clean arguments, status."""

import pytest

from tessera.operators import extract, flows

FILES = {
    "a/tainted.js": "function handle(req, db) {\n  const q = req.query.name;\n  const safe = 'x';\n  return first(safe, q, db);\n}\nfunction first(a, b, db) {\n  const c = b + a;\n  return second(c, db);\n}\nfunction second(sql, db) {\n  db.query(sql);\n}\n",
    "b/clean.js": "function handle2(req, db) {\n  const q = req.query.name;\n  return one(q, 'x', db);\n}\nfunction one(a, b, db) {\n  const c = b;\n  return two(c, db);\n}\nfunction two(sql, db) {\n  db.query(sql);\n}\n",
    "c/far.js": "function h3(req) {\n  g1(req.body.x);\n}\nfunction g1(a) {\n  g2(`${a}`);\n}\nfunction g2(a) {\n  g3(\n    a,\n    1);\n}\nfunction g3(a, n) {\n  g4(a);\n}\nfunction g4(a) {\n  eval(a);\n}\n",
    "d/loop.py": "def start():\n    x = input()\n    loop(x, 0)\n\ndef loop(v, n):\n    loop(n, v)\n    run(n)\n\ndef run(code):\n    text = f'do {code}'\n    eval(text)\n    again = 'code'\n    eval(again)\n",
    "e/own.py": "def own():\n    def inner(y):\n        eval(y)\n    x = input()\n    x = 'fixed'\n    inner(x)\n    z = request.args['z']\n    eval(z)\n",
    "f/html.js": "function page(node, req) {\n  show(node, req.body.html);\n}\nfunction show(node, text) {\n  node.innerHTML = text;\n}\n",
}


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    found = extract.facts(files).cache()
    return files, extract.resolve_calls(found, extract.resolve_imports(files, found)).cache()


def short(rows):
    name = lambda k: k.split("|")[-1]
    return {(name(r.source), r.source_line, name(r.sink), r.sink_line, r.operation, r.hops, tuple(map(name, r.trace)), r.status) for r in rows}


def test_flows(repo):
    near = {
        ("handle", 2, "second", 11, "query", 2, ("handle", "first", "second"), "complete"),
        ("start", 2, "run", 11, "eval", 3, ("start", "loop", "loop", "run"), "complete"),
        ("own", 7, "own", 8, "eval", 0, ("own",), "complete"),
        ("page", 2, "show", 5, "innerHTML", 1, ("page", "show"), "complete"),
    }
    assert short(flows.parameter_flows(*repo).collect()) == near
    far = ("h3", 2, "g4", 16, "eval", 4, ("h3", "g1", "g2", "g3", "g4"), "complete")
    assert short(flows.parameter_flows(*repo, hops=6).collect()) == near | {far}
    some = flows.parameter_flows(*repo, most=2).collect()
    assert len(some) == 2 and {r.status for r in some} == {"partial"}


def test_parameters():
    assert flows.parameters("public String f(@P(\"a, b\") final List<X> a, int... b) {", "f", "java")[-1] == "b"
    assert flows.parameters("def f(a, *args, b: int = g(1, 2), **kw):", "f", "python") == ["a", "args", "b", "kw"]
    assert flows.parameters("const f = async (a, b = [1, 2]) => {", "f", "javascript") == ["a", "b"]
    assert flows.parameters("const f = x => g(x);", "f", "javascript") == ["x"]


def test_odd_files(spark):
    files = spark.createDataFrame([("a.py", "def broken(:"), ("b.js", None), ("c.js", "function f(a { g(a"), ("d.py", "x = " + "-" * 3000 + "1")], "path string, content string")
    assert flows.parts(files).count() >= 0
