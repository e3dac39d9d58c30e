"""Calls by what their receivers are, on small repositories with known targets."""

import itertools
import random

import pytest

from tessera.operators import extract, receivers


def calls_of(spark, files: dict) -> dict:
    """(path, line, name): target or resolution."""
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    found = extract.facts(df).cache()
    rows = extract.resolve_calls(found, extract.resolve_imports(df, found)).collect()
    return {(r.path, r.line, r.name): r.target or r.resolution for r in rows}


SCRIPT = {
    "src/base.ts": "export class Base {\n  save(x) {\n    return x;\n  }\n  shared() {\n    return 1;\n  }\n}\n",
    "src/barrel.ts": "export * from './base.js';\nexport * from './work';\nexport { run as execute } from './work';\nimport { run } from './work';\nexport { run as again };\n",
    "src/work.ts": "export function run() {\n  return 1;\n}\nfunction hidden() {}\nexport { hidden as shown };\nexport default function actual() {\n}\n",
    "src/loop.ts": "export * from './loop2';\nexport function looped() {}\n",
    "src/loop2.ts": "export * from './loop';\n",
    "src/repo.ts": "import { Base } from './barrel';\nexport class Repo extends Base {\n  save(x) {\n    return super.save(x);\n  }\n  load() {\n    return this.shared() + this.save(1);\n  }\n}\n",
    "src/use.ts": (
        "import start, { shown } from './work';\nimport * as ns from './work';\nimport { Repo } from './repo';\nimport { execute, again } from './barrel';\nimport { looped } from './loop2';\n"
        "export class Service {\n  constructor(private repo: Repo, other) {\n    this.second = new Repo();\n  }\n  go() {\n    this.repo.load();\n    this.second.shared();\n    other.load();\n  }\n}\n"
        "function one() {\n  const r = new Repo();\n  r.load();\n}\nfunction two(r) {\n  r.load();\n}\n"
        "start();\nshown();\nns.run();\nexecute();\nagain();\nlooped();\nlet s = new Service();\ns.go();\nmissing().go();\n"
    ),
}


def test_script(spark):
    got = calls_of(spark, SCRIPT)
    use = {(line, name): t for (p, line, name), t in got.items() if p == "src/use.ts"}
    assert got["src/repo.ts", 4, "save"] == "src/base.ts|2|save"
    assert got["src/repo.ts", 7, "shared"] == "src/base.ts|5|shared" and got["src/repo.ts", 7, "save"] == "src/repo.ts|3|save"
    assert use[11, "load"] == "src/repo.ts|6|load" and use[12, "shared"] == "src/base.ts|5|shared" and use[13, "load"] == "unresolved"
    assert use[18, "load"] == "src/repo.ts|6|load" and use[21, "load"] == "unresolved"
    assert use[23, "start"] == "src/work.ts|6|actual" and use[24, "shown"] == "src/work.ts|4|hidden" and use[25, "run"] == "src/work.ts|1|run"
    assert use[26, "execute"] == use[27, "again"] == "src/work.ts|1|run" and use[28, "looped"] == "src/loop.ts|2|looped"
    assert use[30, "go"] == "src/use.ts|10|go" and use[31, "go"] == "unresolved"


PYTHON = {
    "p/__init__.py": "",
    "p/a.py": "class A:\n    def one(self):\n        return 1\n    def two(self):\n        return 2\n\ndef free():\n    return 0\n",
    "p/b.py": "from .a import A\nclass B(A):\n    def one(self):\n        return super().one() + self.two()\nclass C(A):\n    def two(self):\n        return 3\nclass D(B, C):\n    def three(self):\n        return self.two() + self.one() + one()\n",
    "p/c.py": "from . import a\nfrom .b import D as Deep\nimport p.a\ndef f(x: Deep, y):\n    x.three()\n    y.three()\n    a.free()\n    p.a.free()\n    Deep().one()\nclass H:\n    def __init__(self):\n        self.d = Deep()\n    def g(self):\n        return self.d.one()\nz = Deep()\nz = H()\nz.g()\n",
}


def test_python(spark):
    got = calls_of(spark, PYTHON)
    assert got["p/b.py", 4, "one"] == "p/a.py|2|one" and got["p/b.py", 4, "two"] == "p/a.py|4|two"
    assert got["p/b.py", 10, "two"] == "p/b.py|6|two"  # C comes before A, though B reaches A first
    c = {(line, name): t for (p, line, name), t in got.items() if p == "p/c.py"}
    assert c[5, "three"] == "p/b.py|9|three" and c[6, "three"] == "unresolved"
    assert c[7, "free"] == c[8, "free"] == "p/a.py|7|free" and c[9, "one"] == "p/b.py|3|one" and c[14, "one"] == "p/b.py|3|one"
    assert c[17, "g"] == "ambiguous"


def test_java(spark):
    got = calls_of(spark, {
        "src/app/Base.java": "package app;\npublic class Base {\n  public void log() {\n  }\n}\n",
        "src/app/svc/Pay.java": "package app.svc;\npublic class Pay {\n  public void charge() {\n  }\n}\n",
        "src/app/Shop.java": "package app;\nimport app.svc.Pay;\npublic class Shop extends Base {\n  private final Pay pay;\n  public void buy(Pay other) {\n    log();\n    pay.charge();\n    this.pay.charge();\n    other.charge();\n    unknown.charge();\n  }\n}\n",
    })
    shop = {(line, name): t for (p, line, name), t in got.items() if p.endswith("Shop.java")}
    assert shop == {(6, "log"): "src/app/Base.java|3|log", (7, "charge"): "src/app/svc/Pay.java|3|charge", (8, "charge"): "src/app/svc/Pay.java|3|charge", (9, "charge"): "src/app/svc/Pay.java|3|charge", (10, "charge"): "unresolved"}


@pytest.mark.parametrize("seed", range(2))
def test_lookup_order_as_python_has_it(spark, seed):
    """Against the method resolution order of real classes, wherever Python accepts the hierarchy."""
    r, made, rows = random.Random(seed), {}, []
    for i in range(14):
        parents = r.sample(sorted(made), min(len(made), r.randrange(3)))
        try:
            made[f"c{i:02}"] = type(f"c{i:02}", tuple(made[p] for p in parents), {})
        except TypeError:
            continue
        rows += [(f"c{i:02}", p, n) for n, p in enumerate(parents)]
    rows += [("x", "y", 0), ("y", "x", 0), ("z", "z", 0)]  # these inherit from themselves
    got = receivers.lookup_order(spark.createDataFrame(rows, "span string, base string, rank int")).collect()
    order = {k: [t.base for t in sorted(g, key=lambda t: t.order)] for k, g in itertools.groupby(sorted(got, key=lambda t: t.span), key=lambda t: t.span)}
    assert order.pop("x") == ["y"] and order.pop("y") == ["x"] and "z" not in order
    for name, bases in order.items():
        real = [c.__name__ for c in made[name].__mro__[1:-1]]
        assert set(bases) == set(real)
        assert all(bases.index(p) < bases.index(q) for p in bases for q in bases if p != q and issubclass(made[p], made[q]))
