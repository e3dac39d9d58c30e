"""Facts of source files: functions, types, imports, calls, endpoints, tables, packages, flows.

One Arrow pass reads each file once and gives rows of all kinds; joins between facts are DataFrame operations. Python
files are parsed; other languages are read by patterns on masked code, and say so in `mode`.
"""

from __future__ import annotations

import ast
import functools
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.lexer import BRACES, Blocks, Lines, closed, holders, lex
from tessera.operators.modules import config_facts, entries, joined, module_targets, package_facts
from tessera.operators.text import masked
from tessera.plans.storage import stored

FACT = "kind string, path string, name string, line int, end_line int, owner string, detail string, mode string, seq int"
NAMES = [c.split()[0] for c in FACT.split(", ")]
ARROW = [pa.int32() if c.endswith(" int") else pa.string() for c in FACT.split(", ")]
#: Kinds of facts by the part of file_facts that gives them. Any part may give a diagnostic.
SHARED = frozenset("endpoint client route-handler table message sql-use".split())
FLOW = frozenset({"flow"})
MANIFEST = frozenset("dependency config extends path-mapping package-root package-map".split())
SYMBOLS = frozenset("function class annotation import binding reexport export call typed reference package".split())
#: Kinds that resolve_imports and resolve_calls read, and those of a handler's function.
FOR_IMPORTS = frozenset("import class package reference config extends path-mapping package-root package-map".split())
FOR_CALLS = FOR_IMPORTS | frozenset("function call binding export reexport typed".split())
FOR_HANDLERS = frozenset("endpoint route-handler function".split())
#: Languages by file extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "kt": "kotlin", "scala": "scala", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp",
    "swift": "swift", "sql": "sql", "sh": "shell", "ps1": "powershell", "bas": "vba", "cls": "vba", "lua": "lua", "dart": "dart", "html": "html", "css": "css",
}
WORDS_NOT_CALLED = frozenset("if for while switch catch return function class new typeof await super this do else try throw import export synchronized".split())
FUNCTION = re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)\s*\(|^[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>|^[ \t]*(?:(?:public|private|protected|static|final|async|override|synchronized)\s+)+(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w, .]+)?\{|^[ \t]*(?:func|fn|fun|def)\s+(?:\([^)]*\)\s*)?(\w+)\s*[(<]")
TYPE = re.compile(r"\b(class|interface|enum|record|object|trait|struct)\s+([A-Z]\w*)(?:[^{\n]*?\b(?:extends|implements|:)\s*([\w., <>]+))?")
JS_IMPORT = re.compile(r"""(?:import|export)\s+(?:[\w*{}\s,$]+\s+from\s+)?['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)|import\(\s*['"]([^'"]+)['"]\s*\)""")
JAVA_IMPORT = re.compile(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;")
ENDPOINT = (
    (re.compile(r"@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?[\"']([^\"']*)[\"']"), "spring"),
    (re.compile(r"@(?:app|router|blueprint|bp)\.(get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)[\"']"), "fastapi"),
    (re.compile(r"(?<!@)\b(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]"), "express"),
)
FLASK = re.compile(r"@\w+\.route\s*\(\s*[\"']([^\"']+)[\"'](?:[^)]*methods\s*=\s*\[([^\]]*)\])?")
AUTH = re.compile(r"@PreAuthorize|@Secured|login_required|Depends\(\s*get_current|requireAuth|authenticate|isAuthenticated|passport\.")
CREATE = re.compile(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\((.*?)\)\s*;")
BINDINGS = re.compile(r"""\b(import|export)\s*(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*['"]([^'"]+)['"]""")
#: Names for a whole module or its default, and modules whose names are all given on.
MODULE_BINDING = re.compile(r"""\bimport\s+(?:type\s+)?(?:([\w$]+)\s*(?:,\s*(?:\{[^}]*\}|\*\s*as\s+([\w$]+))\s*)?|\*\s*as\s+([\w$]+)\s*)\s*from\s*['"]([^'"]+)['"]""")
REQUIRED = re.compile(r"""\b(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)""")
ALL_NAMES = re.compile(r"""\bexport\s*\*\s*from\s*['"]([^'"]+)['"]""")
OWN_EXPORT = re.compile(r"""\bexport\s*(?:\{([^}]*)\}(?!\s*from)|default\s+(?:(?:async\s+)?function\s*\*?\s*|(?:abstract\s+)?class\s+)?([\w$]+)(?!\s*[\w$(.,\[]*=>))""")
#: Methods in a class body of JavaScript, which need no word before their names.
MEMBER = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|static|async|override|abstract|get|set)\s+)*\*?\s*(#?[\w$]+)\s*(?:<[^<>(){};]*>)?\((?:[^;{}()]|\([^()]*\))*\)\s*(?::\s*[^{};=()]+)?\{")
CALL = re.compile(r"(?:(?<![\w$.])|(?<=[\s)\]}!?]\.))((?:[\w$]+\s*\??\.\s*)*)([A-Za-z_$][\w$]*)\s*\(")
#: Variables whose type is told: made by new, annotated, or declared type first.
MADE = re.compile(r"(?<![\w$.])((?:this\s*\.\s*)?[\w$]+)\s*[!?]?(?::\s*([A-Z][\w$.]*)[^=;\n(){}]*)?=\s*(?:await\s+)?new\s+([\w$.]+)")
ANNOTATION = re.compile(r"(?m)(?:\b(const|let|var|val|public|private|protected|readonly|static|lateinit|override)\s+|[(,]\s*|^[ \t]*)([\w$]+)\s*[!?]?:\s*([A-Z][\w$.]*)")
TYPE_FIRST = re.compile(r"(?<![\w$.])([A-Z][\w$.]*)(?:\s*<[^;={}()\n]*>)?(?:\[\])?[ \t]+([a-z_$][\w$]*)\s*(?=[=;,):])")
#: What calls a server from a client: fetch, or a verb of a usual HTTP client.
CLIENT = re.compile(r"(?:\bfetch|\b(?:axios|http|httpClient|apiClient|client|\$http|requests)\.(get|post|put|delete|patch))\s*\(\s*([`'\"])([^`'\"\n]+)\2([^;\n]{0,200})")
NAMED_HANDLER = re.compile(r"\.(?:get|post|put|delete|patch)\s*\(\s*[\"'`][^\"'`]+[\"'`]\s*,\s*(?:[\w$.]+\s*,\s*)*([A-Za-z_$][\w$]*)\s*\)")
MESSAGE = re.compile(r"\b(publish|emit|send|produce|subscribe|on|consume|listen)\s*\(\s*['\"]([\w.:/-]+)['\"]")
SQL_USE = re.compile(r"(?i)['\"`]\s*(select\b.*?\bfrom|insert\s+into|update|delete\s+from)\s+([A-Za-z_]\w*)")
SOURCE = re.compile(r"request\.(?:args|form|json|GET|POST)|req\.(?:body|query|params)|\binput\s*\(|sys\.argv|process\.argv|getParameter\s*\(")
SINK = re.compile(r"\b(eval|exec|execute|executeQuery|system|popen|Popen|innerHTML|query)\b\s*[(=]")
CLEAN = re.compile(r"(?:escape|sanitize|quote|parameterize)\w*|\bint\s*\(|parseInt\s*\(")
#: What precedes the paths of all routes of a file.
SPRING_BASE = re.compile(r"@RequestMapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?[\"']([^\"']+)[\"'][^)]*\)(?=(?:\s*@[\w.]+(?:\([^)]*\))?)*\s*(?:public\s+)?(?:class|interface)\b)")
ROUTER_BASE = re.compile(r"\b(\w+)\s*=\s*(?:APIRouter|Blueprint)\s*\([^)]*?(?:prefix|url_prefix)\s*=\s*[\"']([^\"']+)[\"']")
#: Tables of object mappers: a class body or what follows a table's name, its columns, and the tables that they refer to.
DJANGO = re.compile(r"(?m)^class\s+(\w+)\s*\([^)]*\bmodels\.Model\b[^)]*\):((?:\n[ \t]+[^\n]*|\n[ \t]*)*)")
ALCHEMY = re.compile(r"__tablename__\s*=\s*['\"](\w+)['\"]((?:\n[ \t]+[^\n]*|\n[ \t]*)*)")
JPA = re.compile(r"@Entity\b([\s\S]*?)\bclass\s+(\w+)[^{]*\{")
ANNOTATED = 5
ACCESSORS = {"Data": ("get", "set"), "Value": ("get",), "Getter": ("get",), "Setter": ("set",)}
HORIZON, FLOWS = 60, 20


def language(path: str) -> str:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "other")


def language_of(path: Column) -> Column:
    """The language of a path by its extension, as one lookup."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(F.substring_index(path, ".", -1))), F.lit("other"))


class View:
    """A file's text as its readers need it: code without comments and strings, lines, blocks. Each is made when it is first asked for."""

    def __init__(self, content: str, kind: str):
        self.content, self.kind, self.line = content, kind, Lines(content)
        self.hashes = kind in ("python", "ruby", "shell")

    @functools.cached_property
    def lexed(self):
        return lex(self.content, self.kind) if self.kind in BRACES else None

    @functools.cached_property
    def code(self) -> str:
        return self.lexed.masked(self.content) if self.lexed else masked(self.content, self.hashes)

    @functools.cached_property
    def live(self) -> str:
        return self.code if self.lexed else masked(self.content, self.hashes, strings=False)  # what a string holds may be code

    @functools.cached_property
    def blocks(self) -> Blocks:
        return Blocks(self.code, self.lexed.closes if self.lexed else closed(self.code))

    @property
    def faults(self) -> list[tuple[int, str]]:
        return self.lexed.faults if self.lexed else []


def python_facts(path: str, content: str) -> list[tuple]:
    out: list[tuple] = []
    todo: list[tuple] = [(ast.parse(content), None, None)]  # a deep tree needs no deep stack

    def written(node) -> str | None:
        try:
            return ast.unparse(node)
        except RecursionError:
            return None

    def told(node) -> str | None:
        """The class that an annotation or a call names, as classes are written."""
        name = node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else written(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""
        return name if re.fullmatch(r"(?:\w+\.)*_*[A-Z]\w*", name or "") else None

    while todo:
        n, owner, inside = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            given = [(a.arg, told(a.annotation)) for a in (*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs)]
            out.extend(("typed", path, a, n.lineno, n.lineno, kind, None, "ast") for a, kind in given if kind)
            out.append(("function", path, n.name, n.lineno, n.end_lineno, owner, json.dumps({"params": len(n.args.args), "exported": not n.name.startswith("_"), "top": inside is None and owner is None}), "ast"))
            owner, inside = None, n.name
        elif isinstance(n, ast.ClassDef):
            out.append(("class", path, n.name, n.lineno, n.end_lineno, None, ",".join(written(b) or "?" for b in n.bases), "ast"))
            marks = [(written(d) or "?").split("(")[0].rsplit(".", 1)[-1] for d in n.decorator_list]
            out.extend(("annotation", path, m, n.lineno, n.lineno, n.name, None, "ast") for m in marks)
            if "dataclass" in marks:
                detail = json.dumps({"params": 0, "exported": True, "top": False})
                out.extend(("function", path, m, n.lineno, n.lineno, n.name, detail, "synthetic") for m in ("__init__", "__repr__", "__eq__"))
            owner = n.name
        elif isinstance(n, ast.Import):
            out.extend(("import", path, a.name, n.lineno, n.lineno, None, a.asname or a.name, "ast") for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            out.extend(("import", path, "." * n.level + (n.module or ""), n.lineno, n.lineno, a.name, a.asname or a.name, "ast") for a in n.names)
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            target = n.target if isinstance(n, ast.AnnAssign) else n.targets[0] if len(n.targets) == 1 else None
            made = n.value.func if isinstance(n.value, ast.Call) else None
            kind = told(n.annotation) if isinstance(n, ast.AnnAssign) else told(made)
            if kind and isinstance(target, (ast.Name, ast.Attribute)):
                out.append(("typed", path, written(target), n.lineno, n.lineno, kind, None, "ast"))
        elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr
            receiver = None if isinstance(n.func, ast.Name) else written(n.func.value)
            out.append(("call", path, name, n.lineno, n.lineno, receiver, str(len(n.args)), "ast"))
        todo += [(child, owner, inside) for child in reversed(list(ast.iter_child_nodes(n)))]
    return out


def synthetic(path: str, kind: str, owner: str, line: int, marks: list[str], body: str) -> list[tuple]:
    """Functions that a class has without writing them: accessors of annotations and of attr_ lines, methods of data classes."""
    names: list[str] = []
    for verb in sorted({v for m in marks for v in ACCESSORS.get(m, ())}) if kind == "java" else ():
        names += [verb + f[0].upper() + f[1:] for f in re.findall(r"\bprivate\s+(?:final\s+)?[\w<>, ]+?\s+(\w+)\s*(?:=[^;]*)?;", body)]
    if kind == "kotlin" and re.search(rf"\bdata\s+class\s+{owner}\b", body):
        names += ["copy", *(f"component{i + 1}" for i in range(len(re.findall(r"\b(?:val|var)\s+\w+", body.split(")")[0]))))]
    if kind == "scala" and re.search(rf"\bcase\s+class\s+{owner}\b", body):
        names += ["apply", "copy"]
    if kind == "ruby":
        for verb, fields in re.findall(r"\battr_(accessor|reader|writer)\s+([^\n]+)", body):
            for f in re.findall(r":(\w+)", fields):
                names += [f] * (verb != "writer") + [f"{f}="] * (verb != "reader")
    return [("function", path, n, line, line, owner, json.dumps({"params": 0, "exported": True, "top": False}), "synthetic") for n in names]


def module_facts(path: str, view: View, blank: str) -> list[tuple]:
    """What a file takes from modules by which names, and gives to others. blank: the code without comments and strings."""
    content, line, out = view.content, view.line, []
    live = lambda pattern: (m for m in pattern.finditer(content) if blank[m.start() : m.start() + 3].strip())
    pairs = lambda text, word: ([x.strip() for x in re.sub(r"^\s*type\s+", "", g).partition(word)[::2]] for g in text.split(",") if g.strip())
    row = lambda kind, m, spec, given, local: out.append((kind, path, spec, line(m.start()), line(m.start()), given, local, "lexical"))
    for m in live(BINDINGS):
        for given, local in pairs(m[2], " as "):
            row("binding" if m[1] == "import" else "reexport", m, m[3], given, local or given)
    for m in live(MODULE_BINDING):
        for given, local in (("default", m[1]), ("*", m[2] or m[3])):
            if local:
                row("binding", m, m[4], given, local)
    for m in live(REQUIRED):
        for given, local in [("*", m[1])] if m[1] else pairs(m[2], ":"):
            row("binding", m, m[3], given, local or given)
    for m in live(ALL_NAMES):
        row("reexport", m, m[1], "*", "*")
    for m in live(OWN_EXPORT):
        for local, given in [(m[2], "default")] if m[2] else pairs(m[1], " as "):
            row("export", m, local, None, given or local)
    return out


def pattern_facts(path: str, view: View) -> list[tuple]:
    content, kind, code, line, out = view.content, view.kind, view.code, view.line, []
    for m in TYPE.finditer(code):
        end = view.blocks.end(m.end())
        if kind == "ruby":  # blocks end by a word at the indent they start with
            indent = m.start() - (code.rfind("\n", 0, m.start()) + 1)
            last = re.compile(rf"(?m)^[ \t]{{{indent}}}end\b").search(code, m.end())
            end = last.start() if last else end
        out.append(("class", path, m[2], line(m.start()), line(end), None, (m[3] or "").strip(), "lexical"))
    spans = [(t[3], t[4], t[2]) for t in out]
    rows = content.split("\n")
    for first, last, name in spans:
        above = "\n".join(rows[max(0, first - 1 - ANNOTATED) : first])
        marks = re.findall(r"@(\w+)", above[above.rfind("}") + 1 :])
        out += [("annotation", path, mark, first, first, name, None, "lexical") for mark in dict.fromkeys(marks)]
        out += synthetic(path, kind, name, first, marks, "\n".join(rows[first - 1 : last]))
    declared = set()
    found = [(next(g for g in m.groups() if g), m) for m in FUNCTION.finditer(code)]
    found = [(name, m, line(m.start() + len(m[0]) - len(m[0].lstrip()))) for name, m in found if name not in WORDS_NOT_CALLED]
    if kind in ("javascript", "typescript"):
        seen = {(name, first) for name, _, first in found}
        more = [(m[1], m, line(m.start(1))) for m in MEMBER.finditer(code) if m[1] not in WORDS_NOT_CALLED]
        inside = holders(spans, [first for _, _, first in more])
        found = sorted([*found, *(t for t, owner in zip(more, inside) if owner and (t[0], t[2]) not in seen)], key=lambda t: t[2])
    for (name, m, first), owner in zip(found, holders(spans, [first for _, _, first in found])):
        params = m[0].count(",") + 1 if re.search(r"\(\s*\w", m[0]) else 0
        out.append(("function", path, name, first, line(view.blocks.end(m.end() - 1)), owner, json.dumps({"params": params, "exported": "export" in m[0] or "public" in m[0], "top": owner is None}), "lexical"))
        declared.add((name, first))
    imports = JAVA_IMPORT if kind in ("java", "kotlin", "scala") else JS_IMPORT
    blank = code if kind in BRACES else masked(content, False)
    for m in imports.finditer(content):
        if blank[m.start() : m.start() + 3].strip():  # not within a comment or string
            out.append(("import", path, next(g for g in m.groups() if g), line(m.start()), line(m.start()), None, None, "lexical"))
    out += module_facts(path, view, blank)
    for m in CALL.finditer(code):
        receiver = re.sub(r"[\s?]|\.\s*$", "", m[1]) or None
        if code[m.start() - 1 : m.start()] == ".":
            receiver = "?"
        if m[2] not in WORDS_NOT_CALLED and code[m.start() - 1 : m.start()] != "@" and (receiver or (m[2], line(m.start())) not in declared):
            out.append(("call", path, m[2], line(m.start()), line(m.start()), receiver, None, "lexical"))
    typed = [(m[1], m[2] or m[3], m.start(1)) for m in MADE.finditer(code)]
    if kind in ("typescript", "kotlin", "scala"):
        told = list(ANNOTATION.finditer(code))
        typed += [(m[2], m[3], m.start(2)) for m in told]
        typed += [("this." + m[2], m[3], m.start(2)) for m in told if m[1] in ("public", "private", "protected", "readonly")]  # also as a parameter
    if kind in ("java", "csharp"):
        typed += [(m[2], m[1], m.start(2)) for m in TYPE_FIRST.finditer(code)]
    typed = dict.fromkeys((re.sub(r"\s", "", name), of, line(at)) for name, of, at in typed)
    out += [("typed", path, name, at, at, of, None, "lexical") for name, of, at in typed if of]
    if kind in ("java", "kotlin", "scala"):
        used = {m[0]: m.start() for m in reversed(list(re.finditer(r"\b[A-Z]\w*\b", code)))}
        out += [("reference", path, name, line(at), line(at), None, None, "lexical") for name, at in sorted(used.items())]
    package = re.search(r"(?m)^\s*package\s+([\w.]+)", code)
    if package:
        out.append(("package", path, package[1], line(package.start()), line(package.start()), None, None, "lexical"))
    return out


def shared_facts(path: str, view: View) -> list[tuple]:
    content, line, out = view.content, view.line, []
    protected = lambda at: str(bool(AUTH.search(content[max(0, at - 300) : at + 300]))).lower()
    spring, routers = SPRING_BASE.search(content), dict(ROUTER_BASE.findall(content))
    joined = lambda base, rest: f"{base.rstrip('/')}/{rest.lstrip('/')}".rstrip("/") if base else rest or "/"
    base_of = lambda m, framework: (spring[1] if spring else "") if framework == "spring" else routers.get(re.match(r"@?(\w+)", m[0])[1], "")
    for pattern, framework in ENDPOINT:
        out += [("endpoint", path, joined(base_of(m, framework), m[2]), line(m.start()), line(m.start()), m[1].upper(), protected(m.start()), framework) for m in pattern.finditer(content)]
    for m in CLIENT.finditer(content):
        if m[3].startswith(("/", "http://", "https://")):
            method = m[1] or next(iter(re.findall(r"method\s*:\s*['\"](\w+)", m[4])), "get")
            out.append(("client", path, m[3], line(m.start()), line(m.start()), method.upper(), None, "lexical"))
    for m in NAMED_HANDLER.finditer(content):
        out.append(("route-handler", path, m[1], line(m.start()), line(m.start()), None, None, "lexical"))
    for m in FLASK.finditer(content):
        for method in re.findall(r"\w+", m[2] or "GET"):
            out.append(("endpoint", path, joined(base_of(m, "flask"), m[1]), line(m.start()), line(m.start()), method.upper(), protected(m.start()), "flask"))
    for m in CREATE.finditer(content):
        columns = [c.strip() for c in re.split(r",(?![^(]*\))", m[2])]
        names = [c.split()[0].strip('`"[]') for c in columns if c and not re.match(r"(?i)(primary|foreign|unique|constraint|check|key)\b", c)]
        keys = re.findall(r"(?i)foreign\s+key\s*\(\s*(\w+)\s*\)\s*references\s+(\w+)", m[2]) + [(c.split()[0], r) for c in columns for r in re.findall(r"(?i)^\w+\s.*\breferences\s+(\w+)", c)]
        out.append(("table", path, m[1], line(m.start()), line(m.end()), None, json.dumps({"columns": names, "keys": keys}), "sql"))
    mapped = lambda name, at, columns, keys, source: out.append(("table", path, name, line(at), line(at), None, json.dumps({"columns": columns, "keys": keys}), source))
    for m in DJANGO.finditer(content):
        mapped(m[1].lower(), m.start(), re.findall(r"(?m)^\s+(\w+)\s*=\s*models\.\w+\(", m[2]), [(c, t.lower()) for c, t in re.findall(r"(?m)^\s+(\w+)\s*=\s*models\.(?:ForeignKey|OneToOneField)\(\s*['\"]?(\w+)", m[2])], "django")
    for m in ALCHEMY.finditer(content):
        mapped(m[1], m.start(), re.findall(r"(?m)^\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:\w+\.)?(?:Column|mapped_column)\(", m[2]), re.findall(r"(?m)^\s+(\w+)\s*(?::[^=\n]+)?=.*?ForeignKey\(\s*['\"](\w+)\.", m[2]), "sqlalchemy")
    for m in JPA.finditer(content):
        named, body = re.search(r"@Table\s*\(\s*(?:name\s*=\s*)?\"(\w+)\"", m[1]), content[m.end() : view.blocks.end(m.end() - 1)]
        fields = re.findall(r"(@(?:ManyToOne|OneToOne)\b[^;]*?)?\b(?:private|protected|public)\s+([\w<>, ]+?)\s+(\w+)\s*(?:=[^;]*)?;", body)
        mapped(named[1] if named else m[2].lower(), m.start(), [f for _, _, f in fields], [(f, t.lower()) for link, t, f in fields if link], "jpa")
    out += [("message", path, m[2], line(m.start()), line(m.start()), "publish" if m[1] in ("publish", "emit", "send", "produce") else "subscribe", None, "lexical") for m in MESSAGE.finditer(content)]
    out += [("sql-use", path, m[2], line(m.start()), line(m.start()), re.split(r"\s", m[1].lower())[0], None, "lexical") for m in SQL_USE.finditer(content)]
    return out


def manifest_facts(path: str, content: str) -> list[tuple]:
    """Packages of npm, pip, Maven, Gradle, Go, Cargo, Composer and Bundler manifests."""
    base, out = path.rsplit("/", 1)[-1], []
    if re.fullmatch(r"(?:tsconfig|jsconfig)[\w.]*\.json", base):
        return config_facts(path, content)
    add = lambda name, version, eco, dev=False: out.append(("dependency", path, name, 1, 1, eco, json.dumps({"version": version, "dev": dev}), "manifest"))
    if base in ("package.json", "composer.json"):
        body = dict(entries(json.loads(content)))
        eco = "npm" if base == "package.json" else "composer"
        out += package_facts(path, body) if eco == "npm" else []
        for part, dev in (("dependencies", False), ("devDependencies", True), ("require", False), ("require-dev", True)):
            for name, version in entries(body.get(part)):
                add(name, str(version), eco, dev)
    elif re.fullmatch(r"requirements.*\.txt", base):
        for m in re.finditer(r"(?m)^\s*([A-Za-z][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=<>~!]=?\s*([\w.*]+))?", content):
            add(m[1], m[2] or "", "pypi")
    elif base == "pom.xml":
        for m in re.finditer(r"(?s)<dependency>.*?<groupId>([^<]+)</groupId>.*?<artifactId>([^<]+)</artifactId>(?:.*?<version>([^<]+)</version>)?.*?</dependency>", content):
            add(f"{m[1].strip()}:{m[2].strip()}", (m[3] or "").strip(), "maven")
    elif base.startswith("build.gradle"):
        for m in re.finditer(r"(testImplementation|implementation|api|compileOnly)\s*\(?\s*['\"]([\w.-]+:[\w.-]+)(?::([\w.-]+))?['\"]", content):
            add(m[2], m[3] or "", "maven", m[1].startswith("test"))
    elif base == "go.mod":
        for m in re.finditer(r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v[\w.+-]+)", content):
            add(m[1], m[2], "go")
    elif base in ("Cargo.toml", "pyproject.toml"):
        import tomllib

        body = tomllib.loads(content)
        for part, dev in (("dependencies", False), ("dev-dependencies", True)):
            for name, v in entries(body.get(part)):
                add(name, v if isinstance(v, str) else str(dict(entries(v)).get("version", "")), "cargo", dev)
        listed = dict(entries(body.get("project"))).get("dependencies")
        for text in listed if isinstance(listed, list) else ():
            if m := re.match(r"([A-Za-z][\w.-]*)\s*(?:[=<>~!]=?\s*([\w.*]+))?", str(text)):
                add(m[1], m[2] or "", "pypi")
    elif base == "mix.exs":
        for m in re.finditer(r"\{\s*:(\w+)\s*,\s*\"([^\"]+)\"([^}]*)\}", content):
            add(m[1], m[2], "hex", bool(re.search(r"only:\s*(?::(?:dev|test)|\[\s*:(?:dev|test))", m[3])))
    elif base == "Gemfile":
        for m in re.finditer(r"(?m)^\s*gem\s+['\"]([\w-]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", content):
            add(m[1], m[2] or "", "rubygems")
    return out


def flow_facts(path: str, view: View) -> list[tuple]:
    """Values that run from a source to a sink within HORIZON lines; what is known is forgotten at a function's start. A cleaning
    call on the way is a signal for a reader, no proof of safety: the flow stays. detail: signals; and status, partial where a
    file has more than FLOWS flows."""
    taint: dict[str, tuple[int, tuple]] = {}
    out: list[tuple] = []
    for n, text in enumerate(view.live.split("\n"), 1):
        if re.match(r"\s*(?:async\s+)?(?:def|function|func|fn|public|private)\b", text):
            taint = {}
        taint = {v: t for v, t in taint.items() if n - t[0] <= HORIZON}
        words = set(re.findall(r"\w+", text)) if taint else ()
        used = [v for v in taint if v in words]
        direct = SOURCE.search(text)
        signals = tuple(dict.fromkeys([c for v in used for c in taint[v][1]] + [m.strip(" (") for m in CLEAN.findall(text)]))
        sink = SINK.search(text)
        if sink and (used or direct):
            out.append(("flow", path, sink[1], min([taint[v][0] for v in used], default=n), n, used[0] if used else direct[0], signals, "lexical"))
        given = re.match(r"\s*(?:const|let|var|String|final)?\s*(\w+)\s*(?::[^=]+)?=(?!=)", text)
        if given:
            if direct or used:
                taint[given[1]] = n, signals
            else:
                taint.pop(given[1], None)
    status = "partial" if len(out) > FLOWS else "complete"
    return [(*f[:6], json.dumps({"signals": list(f[6]), "status": status}), f[7]) for f in out[:FLOWS]]


def file_facts(path: str, content: str, kinds: frozenset[str] | None = None) -> list[tuple]:
    """All facts of a file, or those of some kinds. Each part is read apart: one that fails leaves a diagnostic, and the others go on;
    a Python file that can't be parsed is read by patterns. A part that gives none of the kinds is not read."""
    kind, out = language(path), []
    asked = lambda given: kinds is None or "diagnostic" in kinds or not kinds.isdisjoint(given)

    def part(read, *given) -> bool:
        try:
            out.extend(read(path, *given))
        except Exception as e:  # any file may be odd; its facts are not worth the job
            out.append(("diagnostic", path, type(e).__name__, getattr(e, "lineno", None) or 1, 1, None, str(e)[:200], "parser"))
            return False
        return True

    view = View(content, kind)
    if asked(SHARED):
        part(shared_facts, view)
    if asked(FLOW):
        part(flow_facts, view)
    if asked(MANIFEST):
        part(manifest_facts, content)
    if asked(SYMBOLS) and (kind != "python" or not part(python_facts, content)) and kind not in ("other", "sql", "html", "css"):
        part(pattern_facts, view)
    if asked(()):
        out += [("diagnostic", path, "SyntaxError", view.line(at), view.line(at), None, what, "lexical") for at, what in view.faults]
    return out if kinds is None else [f for f in out if f[0] in kinds]


def facts(files: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """Facts of all files, or those of some kinds; see FACT. seq numbers a file's facts, so (path, seq) tells two of one name and line
    apart."""
    some = None if kinds is None else frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*r, i) for p, c in zip(*(x.to_pylist() for x in b.columns)) for i, r in enumerate(file_facts(p, c or "", some))]
            columns = zip(*rows) if rows else [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW)], names=NAMES)

    return files.select("path", "content").mapInArrow(run, FACT)


def candidates(path: str, spec: str, member: str | None) -> list[str]:
    """Paths that an import of Python or of a JVM language may mean, in order of preference; for scripts see modules."""
    kind, folder = language(path), path.rsplit("/", 1)[0] if "/" in path else ""
    out: list[str] = []
    if kind == "python":
        dots = len(spec) - len(spec.lstrip("."))
        base = joined(folder, "/".join([".."] * (dots - 1))) if dots else ""
        if base is not None:
            at = "/".join(filter(None, [base, spec.lstrip(".").replace(".", "/")]))
            if member:
                out += [f"{at}/{member}.py".lstrip("/"), f"{at}/{member}/__init__.py".lstrip("/")]
            out += [f"{at}.py", f"{at}/__init__.py".lstrip("/")] if at else ["__init__.py"]
    elif kind in ("java", "kotlin", "scala"):
        out.append(spec.replace(".", "/") + ".java")
    return list(dict.fromkeys(out))


@F.pandas_udf(T.ArrayType(T.StringType()))
def candidate_paths(path: pd.Series, spec: pd.Series, member: pd.Series) -> pd.Series:
    return pd.Series([candidates(*x) for x in zip(path, spec, member)])


def import_targets(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, seq of each import that means a file, with target, line, type, resolution. Candidate paths are joined to the
    files; the first that exists is meant. JVM names match by package and class, wildcards by package; several files for
    one name are ambiguous."""
    imports = found.where("kind = 'import'").select("path", "seq", "line", "name", F.col("owner").alias("member"))
    known, own = files.select(F.col("path").alias("target")), ["path", "seq", "line"]
    jvm = language_of(F.col("path")).isin("java", "kotlin", "scala")
    plain = imports.where(~jvm).select(*own, F.posexplode(candidate_paths("path", "name", "member")).alias("n", "target")).select(*own, F.array("n").alias("rank"), "target")
    plain = plain.union(module_targets(imports.where(~jvm), found).select(*own, "rank", "target")).join(known, "target")
    best = plain.groupBy(*own).agg(F.min_by("target", "rank").alias("target")).select(*own, "target", F.lit("import").alias("type"), F.lit("resolved").alias("resolution"))
    classes = package_classes(found)
    named = imports.where(jvm & ~F.endswith("name", F.lit(".*"))).join(classes, F.concat_ws(".", "pkg", "cls") == F.col("name"))
    one = named.groupBy(*own).agg(F.min("target").alias("target"), F.count_distinct("target").alias("n"))
    jvm_named = one.select(*own, "target", F.lit("import").alias("type"), F.when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("resolution"))
    wild = imports.where(jvm & F.endswith("name", F.lit(".*"))).withColumn("pkg", F.expr("substring(name, 1, length(name) - 2)")).join(classes, "pkg")
    jvm_wild = wild.select(*own, "target", F.lit("wildcard-import").alias("type"), F.lit("inferred").alias("resolution")).distinct()
    return best.unionByName(jvm_named).unionByName(jvm_wild).where("path <> target")


def package_classes(found: DataFrame) -> DataFrame:
    """target, pkg, cls: the classes of each package, and their files."""
    classes = found.where("kind = 'class'").select(F.col("path").alias("target"), F.col("name").alias("cls"))
    return classes.join(found.where("kind = 'package'").select(F.col("path").alias("target"), F.col("name").alias("pkg")), "target")


def same_package(found: DataFrame) -> DataFrame:
    """path, target, line, type, resolution: a class of the own package that a file names; ambiguous if several files
    define it."""
    classes = package_classes(found)
    own = found.where("kind = 'package'").select("path", F.col("name").alias("pkg"))
    uses = found.where("kind = 'reference'").select("path", F.col("name").alias("cls"), "line").join(own, "path").join(classes, ["pkg", "cls"]).where("path <> target")
    by = uses.groupBy("path", "cls").agg(F.collect_set("target").alias("targets"), F.min("line").alias("line"))
    sure = F.when(F.size("targets") > 1, "ambiguous").otherwise("inferred")
    return by.select("path", F.explode("targets").alias("target"), "line", F.lit("same-package").alias("type"), sure.alias("resolution"))


def resolve_imports(files: DataFrame, found: DataFrame) -> DataFrame:
    """source, target, line, type, resolution: the distinct edges of imports and of classes used within a package."""
    edges = import_targets(files, found).select("path", "target", "line", "type", "resolution").unionByName(same_package(found))
    return edges.withColumnRenamed("path", "source").distinct()


def unresolved_imports(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, name, line of each import that means no file here, also beside one on its line that does."""
    met = import_targets(files, found).select("path", "seq")
    return found.where("kind = 'import'").join(met, ["path", "seq"], "left_anti").select("path", "name", "line")


def with_class(found: DataFrame) -> DataFrame:
    """path, name, line, class: the innermost class around each function."""
    from tessera.operators.linkage import innermost

    f = found.where("kind = 'function'").select("path", "name", "line", F.concat_ws("|", "path", "seq").alias("point"), F.col("line").alias("at"))
    c = found.where("kind = 'class'").select("path", F.concat_ws("|", "line", "name").alias("span"), F.col("line").alias("start"), F.col("end_line").alias("end"))
    held = innermost(f.select("path", "point", "at"), c, "path")
    return f.join(held, "point").select("path", "name", "line", F.element_at(F.split("span", r"\|"), -1).alias("class"))


def resolve_calls(found: DataFrame, imports: DataFrame) -> DataFrame:
    """caller, path, line, name, target, resolution of every call site. A call with a receiver means a method or function of what
    the receiver is, see receivers.method_targets, and nothing else. One without means, in this order: what its file imports
    by that name, the same file's function, a function of an imported file; in languages where methods are called without a
    receiver, first a method of the class around it. The first step with candidates decides: one is resolved, several
    ambiguous; none at all is unresolved. The caller is the innermost function around it."""
    from tessera.operators import receivers
    from tessera.operators.linkage import innermost

    f = found.where("kind = 'function'").select("path", "name", "line", "end_line", "owner").withColumn("key", F.concat_ws("|", "path", "line", "name"))
    free = f.where(F.col("owner").isNull() | ~language_of(F.col("path")).isin(*receivers.EXPLICIT))
    classes = receivers.class_spans(found)
    imports = stored(imports, "imports")
    calls = found.where("kind = 'call'").select("path", "name", "line", "seq", F.col("owner").alias("receiver")).withColumn("call", F.concat_ws("|", "path", "seq"))
    spread = imports.select(F.col("source").alias("path"), F.col("line").alias("at"), "target")
    bound = found.where("kind IN ('import', 'binding')").select("path", F.col("line").alias("at"), F.col("detail").alias("name"), F.coalesce("owner", "detail").alias("exported")).where("name IS NOT NULL")
    given = bound.join(spread, ["path", "at"]).select("path", "name", "target", "exported").distinct()
    given = stored(given, "given")
    known = f.select("name").union(given.select("name")).union(found.where("kind IN ('export', 'reexport')").select("detail"))
    calls = stored(calls.join(known.distinct(), "name", "left_semi"), "calls")
    spans = f.select("path", F.col("key").alias("span"), F.col("line").alias("start"), F.col("end_line").alias("end"))
    caller = innermost(calls.select("path", F.col("call").alias("point"), F.col("line").alias("at")), spans, "path").toDF("call", "caller")
    reach = imports.select(F.col("source").alias("path"), "target").distinct()
    exports = receivers.exported(found, spread, given, free.select("path", "name", "key").union(classes.select("path", "name", "span")))
    plain = calls.where("receiver IS NULL")
    theirs = plain.join(reach, "path").join(free.select(F.col("path").alias("target"), "name", "key"), ["target", "name"])
    named = plain.join(given, ["path", "name"]).join(exports.toDF("target", "exported", "key"), ["target", "exported"]).join(f.select("key").distinct(), "key", "left_semi")
    own = plain.join(free.select("path", "name", "key"), ["path", "name"])
    step = lambda df, n: df.select("call", "key", F.lit(n).alias("step"))
    by = step(named, 1).union(step(own, 2)).union(step(theirs, 3)).groupBy("call", "step").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key"))
    by = by.unionByName(receivers.method_targets(found, calls, given, reach, f, classes, exports).withColumn("step", F.lit(0)))
    first = by.groupBy("call").agg(F.min_by(F.struct("n", "key"), "step").alias("b"))
    out = calls.join(first, "call", "left").join(caller, "call", "left")
    n = F.col("b.n")
    return out.select("caller", "path", "line", "name", F.when(n == 1, F.col("b.key")).alias("target"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("resolution"))


def dead_functions(found: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that nothing calls, not exported, no entry point, and no candidate of an unclear call."""
    f = found.where("kind = 'function'").select("path", "name", "line", F.get_json_object("detail", "$.exported").alias("exported"), F.concat_ws("|", "path", "line", "name").alias("target"))
    unclear = calls.where("resolution <> 'resolved'").select("name").distinct()
    quiet = f.join(calls.where("resolution = 'resolved'").select("target"), "target", "left_anti").join(unclear, "name", "left_anti")
    return quiet.where("exported = 'false' OR exported IS NULL").where(~F.col("name").isin("main", "__init__")).select("path", "name", "line")
