"""Modes of source text; extraction of odd files, in linear time."""

import json
import time

import pytest

from tessera.operators import extract
from tessera.operators.lexer import lex


def facts_of(path, content, kind):
    return [f for f in extract.file_facts(path, content) if f[0] == kind]


@pytest.mark.parametrize(
    "code,kind,left",
    [
        ("`x ${b()}` + `a ${c(`in ${d}`)} z`", "javascript", "b() + c( d )"),
        ("const r = /a\\/[/]\"'`(/g; x = a / b / c;", "javascript", "const r = ; x = a / b / c;"),
        ("if (y) /re(/.test(z)", "javascript", "if (y) .test(z)"),
        ("x = (a) / b / (c)", "javascript", "x = (a) / b / (c)"),
        ("f(<div a=\"x(\">it's {g(a)} <br/> don't</div>)", "javascript", "f(<div a= > {g(a)} <br/> </div>)"),
        ("x < 3 && y > 2 // it's", "typescript", "x < 3 && y > 2"),
        ('String s = """\n a "q" { ( \n"""; f();', "java", "String s = ; f();"),
        ("char c = '\"'; g('\\'');", "java", "char c = ; g( );"),
        ("fn f<'a>(x: &'a str) { 'x' }", "rust", "fn f<'a>(x: &'a str) { }"),
        ("s := `raw \" (`; /* ' */ h()", "go", "s := ; h()"),
    ],
)
def test_modes(code, kind, left):
    lexed = lex(code, kind)
    assert lexed.masked(code).split() == left.split() and len(lexed.masked(code)) == len(code) and not lexed.faults


def test_faults():
    assert [w for _, w in lex("f(a[1}; 'abc", "javascript").faults] == ["} without {", "string without an end", "( without an end", "[ without an end"]
    assert [w for _, w in lex("`a ${b", "javascript").faults] == ["template without an end", "${ without an end"]
    assert [w for _, w in lex("/* a", "java").faults] == ["comment without an end"]


def test_calls_in_templates():
    calls = {f[2] for f in facts_of("a.js", "const s = `x ${b()}`;\nconst r = /c()/;\nconst t = 'd()';\n", "call")}
    assert calls == {"b"}


def test_blocks_end_by_brackets_of_code():
    f = {x[2]: (x[3], x[4]) for x in facts_of("a.js", "function a() {\n  const s = '}';\n  const r = /}/;\n  return `${{}}}`;\n}\nfunction b() {}\n", "function")}
    assert f == {"a": (1, 5), "b": (6, 6)}


@pytest.mark.parametrize(
    "path,content",
    [
        ("package.json", "[]"), ("package.json", '{"dependencies": ["a"], "devDependencies": {"b": 1}}'), ("tsconfig.json", '{"compilerOptions": {"paths": ["x"], "baseUrl": 3}}'), ("tsconfig.json", '{"compilerOptions": []}'),
        ("pyproject.toml", '[project]\ndependencies = ["@x", "flask>=2"]\n'), ("pyproject.toml", "project = 3"), ("Cargo.toml", "[dependencies]\na = 3\n"), ("package.json", "{"), ("a.py", "x = " + " + ".join(["1"] * 5_000)),
        ("a.py", "x = " + "-" * 3_000 + "1"), ("a.py", "x = " + "(" * 300), ("a.py", "\x00"), ("a.js", "}" * 50), ("a.js", "`${" * 500), ("a.tsx", "<a" * 400), ("a.java", "class A {" * 200),
    ],
)
def test_odd_files_stop_nothing(path, content):
    rows = extract.file_facts(path, content)
    assert all(len(r) == 8 for r in rows)
    names = {r[2] for r in rows if r[0] == "dependency"}
    assert names == ({"b"} if "devDep" in content else {"flask"} if "flask" in content else {"a"} if path == "Cargo.toml" else set())


def test_linear():
    def took(n):
        js = "function f1(a) {\n  return g(`t ${h(a)}`, /x/, \"s\") / 2;\n}\n" * n
        start = time.process_time()
        rows = extract.file_facts("a.js", js)
        assert sum(r[0] == "function" for r in rows) == n
        return time.process_time() - start

    took(100)
    small, large = took(1_000), took(8_000)
    assert large < 8 * small * 3
    word = "x" * 300_000
    start = time.process_time()
    extract.file_facts("a.js", f"const a = {word};")
    assert time.process_time() - start < 20


def test_cleaning_calls_are_signals():
    body = "function render(req, node) {\n const input = req.body.value;\n const output = escapeHtml(input);\n node.innerHTML = output;\n}"
    (flow,) = facts_of("a.js", body, "flow")
    assert flow[2:6] == ("innerHTML", 3, 4, "output") and json.loads(flow[6]) == {"signals": ["escapeHtml"], "status": "complete"}
    assert not facts_of("a.js", "// req.query.name; db.query(query);\nconst message = \"req.body.x; db.query(x)\";\nfunction safe(db) { db.query(\"SELECT 1\"); }", "flow")
    assert facts_of("a.js", "function query(req, db) {\n const value = req.query.name;\n db.query(`SELECT * FROM users WHERE name = ${value}`);\n}", "flow")
    many = "x = request.args['a']\n" + "eval(x)\n" * 30
    assert len(facts_of("a.py", many, "flow")) == 20 and {json.loads(f[6])["status"] for f in facts_of("a.py", many, "flow")} == {"partial"}
