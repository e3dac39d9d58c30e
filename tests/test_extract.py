"""Extraction and resolution on a small repository with known edges."""

import json

import pytest

from tessera.operators import extract

FILES = {
    "pkg/__init__.py": "def package_function():\n    return 1\n",
    "pkg/sibling.py": "def helper(a, b):\n    return _inner(a)\n\ndef _inner(a):\n    return a\n\ndef _unused():\n    pass\n",
    "pkg/app.py": "from . import sibling, package_function\nfrom .sibling import helper\n# from .decoy import nothing\nTEXT = '''import decoy'''\n\nclass Service(Base):\n    def run(self):\n        return helper(1, 2)\n",
    "web/a.ts": "import { b } from './b';\n// import x from './decoy'\nconst t = \"import y from './decoy2'\";\nexport function start() {\n  return b();\n}\n",
    "web/b.ts": "export const b = () => {\n  return 1;\n};\n",
    "src/main/java/app/A.java": "package app;\nimport app.dto.*;\nimport app.svc.B;\npublic class A {\n  public void go() { }\n}\n",
    "src/main/java/app/dto/X.java": "package app.dto;\npublic class X { }\n",
    "src/main/java/app/svc/B.java": "package app.svc;\npublic class B { }\n",
    "web/index.ts": "export { b as renamed } from './b';\n",
    "web/c.ts": "import { renamed as r } from './index';\nimport { b as direct } from './b';\nexport function twice() {\n  return r() + r() + direct();\n}\n",
    "src/main/java/app/C.java": "package app;\npublic class C {\n  A a;\n  // X x\n}\n",
    "bad.py": "def broken(:\n  pass\n",
    "db/schema.sql": "CREATE TABLE users (id INT, name TEXT);\nCREATE TABLE orders (id INT, user_id INT REFERENCES users, total DECIMAL(10, 2), FOREIGN KEY (user_id) REFERENCES users);\n",
    "api.py": "@app.get('/users/{id}')\ndef get(id): pass\n@bp.route('/x', methods=['POST', 'PUT'])\n@login_required\ndef x(): pass\n",
    "server.js": "router.post('/login', (req, res) => {\n  const q = req.body.q;\n  db.query(q);\n});\nbus.publish('orders.created');\ndb.run(\"SELECT * FROM users\");\n",
    "package.json": '{"dependencies": {"react": "^18"}, "devDependencies": {"vite": "5"}}',
    "requirements.txt": "flask==2.0\n# comment\nrequests>=2\n",
}


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    return files, extract.facts(files).cache()


def test_import_edges(repo):
    edges = {(r.source, r.target, r.resolution) for r in extract.resolve_imports(*repo).collect()}
    assert edges == {
        ("pkg/app.py", "pkg/sibling.py", "resolved"), ("pkg/app.py", "pkg/__init__.py", "resolved"), ("web/a.ts", "web/b.ts", "resolved"),
        ("src/main/java/app/A.java", "src/main/java/app/dto/X.java", "inferred"), ("src/main/java/app/A.java", "src/main/java/app/svc/B.java", "resolved"), ("web/index.ts", "web/b.ts", "resolved"),
        ("web/c.ts", "web/index.ts", "resolved"), ("web/c.ts", "web/b.ts", "resolved"), ("src/main/java/app/C.java", "src/main/java/app/A.java", "inferred"),
    }


def test_calls_and_dead_code(repo):
    calls = extract.resolve_calls(repo[1], extract.resolve_imports(*repo))
    got = {(r.path, r.name): (r.caller and r.caller.split("|")[-1], r.target and r.target.split("|")[0], r.resolution) for r in calls.collect()}
    assert got["pkg/app.py", "helper"] == ("run", "pkg/sibling.py", "resolved")
    assert got["pkg/sibling.py", "_inner"] == ("helper", "pkg/sibling.py", "resolved")
    assert got["web/a.ts", "b"] == ("start", "web/b.ts", "resolved")
    assert {r.name for r in extract.dead_functions(repo[1], calls).where("path LIKE 'pkg/%'").collect()} == {"_unused"}


def test_aliases_chains_and_call_sites(repo):
    calls = extract.resolve_calls(repo[1], extract.resolve_imports(*repo)).where("path = 'web/c.ts'").collect()
    got = sorted((r.name, r.target and r.target.split("|")[0], r.resolution) for r in calls)
    assert got == [("direct", "web/b.ts", "resolved"), ("r", "web/b.ts", "resolved"), ("r", "web/b.ts", "resolved")]


def test_unresolved_beside_resolved(spark):
    files = spark.createDataFrame([("p/a.py", "from . import b, gone\n"), ("p/b.py", ""), ("p/c.py", "import b, b\n")], "path string, content string")
    found = extract.facts(files).cache()
    assert sorted(tuple(r) for r in extract.unresolved_imports(files, found).select("path", "line").collect()) == [("p/a.py", 1), ("p/c.py", 1), ("p/c.py", 1)]


def test_classes_around_functions(repo):
    got = {(r.path, r.name): r["class"] for r in extract.with_class(repo[1]).collect()}
    assert got["pkg/app.py", "run"] == "Service" and got["pkg/sibling.py", "helper"] is None and got["src/main/java/app/A.java", "go"] == "A"


def test_other_facts(repo):
    rows = repo[1].collect()
    kind = lambda k: {(r.path, r.name, r.owner) for r in rows if r.kind == k}
    assert {(n, m) for _, n, m in kind("endpoint")} == {("/users/{id}", "GET"), ("/x", "POST"), ("/x", "PUT"), ("/login", "POST")}
    assert {r.name for r in rows if r.kind == "endpoint" and r.detail == "true"} >= {"/x"}
    tables = {r.name: json.loads(r.detail) for r in rows if r.kind == "table"}
    assert tables["orders"]["columns"] == ["id", "user_id", "total"] and ["user_id", "users"] in tables["orders"]["keys"]
    assert {n for _, n, _ in kind("dependency")} == {"react", "vite", "flask", "requests"}
    assert ("server.js", "query", "q") in kind("flow") and ("server.js", "orders.created", "publish") in kind("message") and ("server.js", "users", "select") in kind("sql-use")
    assert {r.path for r in rows if r.kind == "diagnostic"} == {"bad.py"}


def test_chain_and_edit(spark):
    chain = {f"m{i}.py": f"from m{i + 1} import f{i + 1}\ndef f{i}():\n    return f{i + 1}()\n" for i in range(12)} | {"m12.py": "def f12():\n    return 0\n"}

    def edges(files):
        df = spark.createDataFrame(list(files.items()), "path string, content string")
        found = extract.facts(df).cache()
        imports = extract.resolve_imports(df, found)
        return imports.count(), extract.resolve_calls(found, imports).where("resolution = 'resolved'").count()

    assert edges(chain) == (12, 12)
    assert edges(chain | {"m0.py": "x = 1\n"}) == (11, 11)
    assert edges({p: c for p, c in chain.items() if p != "m12.py"})[0] == 11


MAPPED = {
    "models.py": "from django.db import models\nclass Author(models.Model):\n    name = models.CharField(max_length=9)\n\nclass Book(models.Model):\n    title = models.TextField()\n    author = models.ForeignKey(Author, on_delete=x)\n",
    "alchemy.py": "class A(Base):\n    __tablename__ = 'accounts'\n    id = Column(Integer)\n    owner_id: Mapped[int] = mapped_column(ForeignKey('users.id'))\n",
    "src/User.java": "package a;\n@Entity\n@Table(name = \"users\")\n@Data\npublic class User {\n  private Long id;\n  @ManyToOne\n  private Team team;\n}\n",
    "src/Api.java": "@RestController\n@RequestMapping(\"/api/\")\npublic class Api {\n  @GetMapping(\"/x\")\n  public String x() {\n    return y;\n  }\n}\n",
    "routes.py": "router = APIRouter(prefix='/v1')\n@router.get('/items')\ndef items(): pass\nbp = Blueprint('b', url_prefix='/shop')\n@bp.route('/buy')\ndef buy(): pass\n@dataclass\nclass P:\n    a: int\n",
    "mix.exs": "defp deps do\n  [{:phoenix, \"~> 1.7\"}, {:credo, \"1.0\", only: :dev}]\nend\n",
    "m.rb": "class Person\n  attr_accessor :name\n  attr_reader :age\nend\n",
}


def test_mapped_tables_base_paths_and_synthetic_functions(spark):
    rows = extract.facts(spark.createDataFrame(list(MAPPED.items()), "path string, content string")).collect()
    tables = {r.name: (json.loads(r.detail)["columns"], [tuple(k) for k in json.loads(r.detail)["keys"]], r.mode) for r in rows if r.kind == "table"}
    assert tables == {
        "author": (["name"], [], "django"), "book": (["title", "author"], [("author", "author")], "django"),
        "accounts": (["id", "owner_id"], [("owner_id", "users")], "sqlalchemy"), "users": (["id", "team"], [("team", "team")], "jpa"),
    }
    assert {(r.owner, r.name) for r in rows if r.kind == "endpoint"} == {("GET", "/api/x"), ("GET", "/v1/items"), ("GET", "/shop/buy")}
    made = {(r.owner, r.name) for r in rows if r.mode == "synthetic"}
    assert {("User", "getId"), ("User", "setTeam"), ("P", "__init__"), ("Person", "name="), ("Person", "age")} <= made and ("Person", "age=") not in made
    assert {(r.owner, r.name) for r in rows if r.kind == "annotation"} >= {("User", "Entity"), ("User", "Data"), ("Api", "RestController"), ("P", "dataclass")}
    assert {(r.name, r.owner, json.loads(r.detail)["dev"]) for r in rows if r.path == "mix.exs" and r.kind == "dependency"} == {("phoenix", "hex", False), ("credo", "hex", True)}


def test_path_mappings(spark):
    files = {
        "web/tsconfig.json": '{"compilerOptions": {"baseUrl": ".", /* x */ "paths": {"@lib/*": ["./src/lib/*"], "@lib/deep/*": ["src/deep/*"], "exact": ["src/one.ts"],}, }} // end',
        "web/src/lib/a.ts": "export const a = 1;\n", "web/src/deep/b.ts": "", "web/src/one.ts": "", "web/src/lib/deep/b.ts": "", "web/src/plain/index.js": "",
        "web/src/use.ts": "import { a } from '@lib/a';\nimport '@lib/deep/b';\nimport 'exact';\nimport 'src/plain';\nimport 'react';\n", "other/use.ts": "import '@lib/a';\n",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    found = extract.facts(df).cache()
    got = {(r.source, r.line, r.target) for r in extract.resolve_imports(df, found).collect()}
    assert got == {("web/src/use.ts", 1, "web/src/lib/a.ts"), ("web/src/use.ts", 2, "web/src/deep/b.ts"), ("web/src/use.ts", 3, "web/src/one.ts"), ("web/src/use.ts", 4, "web/src/plain/index.js")}
    assert {(r.path, r.name) for r in extract.unresolved_imports(df, found).collect()} == {("web/src/use.ts", "react"), ("other/use.ts", "@lib/a")}
