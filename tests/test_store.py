"""Stored tables, budgets and security rules on small cases."""

import random

import pytest

from tessera.operators import contracts, extract, findings, graph, security
from tessera.sources import repository as R
from tessera.streaming import jobs

LIMIT = 100


def simulated(events: list[tuple]) -> list[tuple]:
    """A budget as one would run it by hand: (limiter, seq, at, op, ticket, tokens) in order."""
    out, logs = [], {}
    for limiter, seq, at, op, ticket, tokens in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        log = logs[limiter] = [e for e in logs.get(limiter, []) if at - e[0] < 60]
        granted = wait = None
        if op == "reserve":
            fits = lambda left: sum(e[1] for e in left) + tokens <= LIMIT  # noqa: B023, E731
            if tokens > LIMIT:
                wait = float("inf")
            elif fits(log):
                wait = 0.0
            else:
                wait = next(max(log[i][0] + 60 - at, 0.001) for i in range(len(log)) if fits(log[i + 1 :]))
            granted = wait == 0
            if granted:
                log.append([at, tokens, ticket])
        elif op == "record":
            log.append([at, tokens, None])
        else:
            held = [e for e in log if e[2] == ticket]
            if held and op == "finish":
                held[0][1:] = [tokens, None]
            elif held:
                log.remove(held[0])
        out.append((limiter, seq, granted, wait))
    return out


def test_budget_log(spark):
    r, events, at = random.Random(3), [], 0.0
    for i in range(600):
        at += r.choice([0, 0.5, 3, 20])
        op = r.choice(["reserve", "reserve", "reserve", "record", "finish", "cancel"])
        events.append((r.choice("ab"), i, at, op, str(i if op == "reserve" else r.randrange(max(0, i - 8), i + 1)), r.choice([0, 10, 30, 60, 101])))
    got = jobs.budget_log(spark.createDataFrame(events, "limiter string, seq long, at double, op string, ticket string, tokens long"), LIMIT)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, simulated(events)))


def test_index_and_delete(spark, tmp_path):
    out = str(tmp_path / "chunks")
    rows = lambda repo, n: spark.createDataFrame([(repo, f"f{i}", "text" if i else " ") for i in range(n)], "repository string, path string, content string")
    R.write_index(rows("one", 3), out)
    R.write_index(rows("two", 4), out)
    R.write_index(rows("one", 2), out)
    count = lambda: {r.repository: r["count"] for r in spark.read.parquet(out).groupBy("repository").count().collect()}
    assert count() == {"one": 1, "two": 3}
    assert R.remove(spark, out, "one") and not R.remove(spark, out, "one")
    assert count() == {"two": 3}


CASES = [
    ("src/configExample.js", "const help = 'password: \"correct # password=admin\"';\nconst ok = true;", set()),
    ("src/config.js", "const ready = true;\nconst password = 'real-looking-secret-value';", {("Hardcoded Secret", 2)}),
    ("src/decoy.js", '// eval(userInput)\nconst example = "eval(userInput)";', set()),
    ("src/scanner.js", "if (code.includes('eval(')) { return 'eval('; }", set()),
    ("src/unsafe.js", "function run(input) {\n  return eval(input);\n}", {("Dynamic Code Execution", 2)}),
    ("src/App.java", 'class App { String note = "Application.Run(macro)"; }', set()),
    ("src/Panel.jsx", "function Panel({ html }) {\n  return <div dangerouslySetInnerHTML={{ __html: html }} />;\n}", {("Potential XSS Sink", 2)}),
    ("src/Fixed.jsx", "const x = <div dangerouslySetInnerHTML={{ __html: '<b>' }} />;", set()),
    ("src/Names.js", 'const docs = "dangerouslySetInnerHTML";', set()),
    ("src/docsExample.js", "const sample = \"db.query('SELECT * FROM users WHERE id=' + input)\";", set()),
    ("src/repository.js", "function load(id) {\n  return db.query('SELECT * FROM users WHERE id=' + id);\n}", {("Potential SQL Injection Risk", 2)}),
    ("src/template.js", "const r = await db.query(`SELECT ${x} FROM t`);", {("Potential SQL Injection Risk", 1)}),
    ("src/help.js", 'const docs = "On Error Resume Next; Shell(cmd.exe)";', set()),
    ("a.bas", "x = Shell(cmd)\nSet o = CreateObject(\"WScript.Shell\")", {("Shell Command Execution", 1), ("WScript.Shell Creation", 2)}),
    ("a.py", "import os\nos.system(x)\n__import__(name)\n__import__('json')\nDEBUG = True\n", {("OS Command Execution", 2), ("Dynamic Import", 3), ("Debug Mode Enabled", 0)}),
    ("b.py", "try:\n  pass\nexcept:\n  pass\n" * 3 + "pickle.loads(x)\neval(x)\n", {("Bare Except Clauses", 0), ("Pickle Deserialization", 0), ("Python eval()", 14)}),
    ("tests/c.py", "subprocess.run(x, shell=True)\nassert 1\n" * 6, set()),
    ("src/d.py", "assert 1\n" * 6 + "subprocess.run(x, shell=True)\npassword = 'changeme'\ntoken = 'abcd' + x\n", {("Assert in Production", 0), ("Shell Injection Risk", 0)}),
    ("src/e.js", "console.log(1);\n" * 4 + "child_process.exec(x);\nnew Function(y)", {("Debug Statements", 0), ("Command Execution", 5), ("Function Constructor", 6)}),
]


def test_security_rules(spark):
    df = spark.createDataFrame([(p, c) for p, c, _ in CASES] + [("none.js", None)], "path string, content string")
    got = {}
    for r in security.security_scan(df).collect():
        got.setdefault(r.path, set()).add((r.title, r.line))
    assert got == {p: want for p, _, want in CASES if want}


def test_named_and_containing_handlers(spark):
    files = spark.createDataFrame([
        ("s.js", "function login(req, res) {\n  return 1;\n}\nrouter.post('/login', auth, login);\nrouter.get('/x', missing);\n"),
        ("a.py", "def routes(app):\n    @app.get('/in')\n    def inner():\n        pass\n    return app\n"),
        ("b.py", "@app.get('/far')\nx = 1\ndef later():\n    pass\n"),
    ], "path string, content string")
    found = extract.facts(files).cache()
    got = {(r.route, r.handler, r.basis) for r in contracts.handlers(files, found).collect()}
    assert got == {("/login", "s.js|1|login", "named-argument"), ("/x", None, "unresolved"), ("/in", "a.py|1|routes", "around"), ("/far", None, "unresolved")}


def test_caller_impact_is_bounded_and_says_so(spark):
    calls = spark.createDataFrame([("b", "a", "resolved"), ("c", "b", "resolved"), ("d", "b", "ambiguous"), ("a", "c", "resolved"), (None, "a", "resolved")], "caller string, target string, resolution string")
    changed = spark.createDataFrame([("a",)], "function string")
    assert [(r.function, r.hops, r.via, r.status) for r in contracts.caller_impact(calls, changed).collect()] == [("b", 1, ["a", "b"], "complete"), ("c", 2, ["a", "b", "c"], "complete")]
    assert [(r.function, r.status) for r in contracts.caller_impact(calls, changed, 1).collect()] == [("b", "partial")]


def test_paths_and_order_say_what_they_leave(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "source string, target string")
    start = spark.createDataFrame([("a",)], "node string")
    got = graph.simple_paths(e, start, 4, 3).collect()
    assert [r.path for r in got] == [["a", "b"], ["a", "c"], ["a", "b", "c"]] and {r.status for r in got} == {"partial"}


def test_suppressions_by_prefix_path_and_line(spark):
    f = spark.createDataFrame([(1, "a.b.c", "x", 1), (2, "a.b.c", "y", 2), (3, "d", "x", None), (4, None, None, 3), (5, "a", "z", 9)], "id int, ruleId string, path string, line int")
    rules = spark.createDataFrame([(7, "a.b.*", "x", None), (3, "a.*", None, 2), (9, "*", "x", None), (8, "d", "x", 5), (2, "*", None, 9)], "no int, rule string, path string, line int")
    assert {r.id: r.suppressed_by for r in findings.suppressed(f, rules).collect()} == {1: 7, 2: 3, 3: 9, 4: None, 5: 2}


@pytest.mark.parametrize("columns", ["file string, line int, type string", "path string, startLine int, endLine int, category string, title string"])
def test_findings_of_any_layout(spark, columns):
    values = ("b.py", 2, "Odd Thing") if "type" in columns else ("b.py", 2, 3, "Style", "Odd Thing")
    files = spark.createDataFrame([("src/b.py", "one\ntwo\n"), ("src/c.py", "")], "path string, content string")
    r = findings.normalized(spark.createDataFrame([values], columns), files).first()
    assert (r.ruleId, r.severity, r.evidence, r.source) == (("quality" if "type" in columns else "style") + ".odd-thing", "info", "two", "src/b.py") and r.id.startswith("finding:")


def test_sarif_document(spark):
    import json

    f = spark.createDataFrame([(f"r{i % 2}", "a.py", i, "high", f"t{i}") for i in range(5)], "ruleId string, path string, line int, severity string, title string")
    for df, n in ((f.repartition(3), 5), (f.limit(0), 0)):
        doc = json.loads("".join(r.line for r in R.sarif_log(df).orderBy("seq").collect()))
        assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == n and len(doc["runs"][0]["tool"]["driver"]["rules"]) == min(n, 2)


def test_context_and_neighbours(spark):
    from tessera.operators import evolution, retrieval

    rows = [("a.ts", "x"), ("tsconfig.json", "{}")]
    key = lambda r: evolution.context_key(spark.createDataFrame(r, "path string, content string"))
    assert key(rows) == key(rows[::-1]) == key([("a.ts", "other"), rows[1]]) != key([rows[0], ("tsconfig.json", "{ }")]) and key(rows) != key(rows[:1])
    e = spark.createDataFrame([("a", "b", "import"), ("c", "a", "import"), ("c", "b", "call")], "source string, target string, type string")
    assert [(r.direction, r.path, r.status) for r in retrieval.dependencies_of(e, "a").collect()] == [("imported-by", "c", "complete"), ("imports", "b", "complete")]
    assert [r.status for r in retrieval.dependencies_of(e, "a", 1).collect()] == ["partial"]


def test_orphans_that_no_text_names(spark):
    from tessera.operators import linkage

    t = spark.createDataFrame([("users", "a.sql"), ("odd", "b.sql"), ("own", "c.sql")], "name string, path string")
    files = spark.createDataFrame([("x.py", "select * from users;"), ("c.sql", "create table own"), ("y.py", "odder")], "path string, content string")
    assert {r.name for r in linkage.unnamed(t, files).collect()} == {"odd", "own"}


def test_impact_via_and_cap(spark):
    e = spark.createDataFrame([("m", "core", "inferred"), ("n", "core", "resolved"), ("top", "m", "resolved"), ("top", "n", "resolved"), ("z", "top", "resolved")], "source string, target string, resolution string")
    changed = spark.createDataFrame([("core",)], "node string")
    got = {r.node: (r.via, r.confidence, r.status) for r in graph.change_impact(e, changed).collect()}
    assert got["top"] == (["core", "n", "top"], "high", "complete") and got["z"][0] == ["core", "n", "top", "z"] and got["m"][1] == "medium"
    assert [(r.node, r.status) for r in graph.change_impact(e, changed, most=1).collect()] == [("m", "partial")]
