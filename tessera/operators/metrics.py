"""Measures of functions and structure, and what they suggest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIMITS = {"lines": 60, "params": 5, "nesting": 4, "complexity": 10, "cognitive": 11}
BRANCH = re.compile(r"\b(?:if|elif|for|while|case|catch|except)\b|&&|\|\||\?(?![?.])|\b(?:and|or)\b")
OPEN = re.compile(r"\b(?:if|elif|else|for|while|switch|case|try|catch|except|with)\b")


def function_shape(code: str, python: bool) -> tuple[int, int, int, int, int, int]:
    """Non-blank lines, parameters, nesting, branches plus one, cognitive estimate (branches weigh their depth), returns."""
    from tessera.operators.text import masked

    plain = masked(code, python)
    rows = [r for r in plain.split("\n") if r.strip()]
    head = re.search(r"\(([^)]*)\)", plain)
    params = len([p for p in (head[1].split(",") if head else []) if p.strip() and p.strip() not in ("self", "cls")])
    depth = nesting = cognitive = 0
    base = len(rows[0]) - len(rows[0].lstrip()) if rows else 0
    for i, r in enumerate(rows[1:]):
        if python:
            depth = max(0, (len(r) - len(r.lstrip()) - base) // 4 - 1)
        opens = bool(OPEN.search(r))
        nesting = max(nesting, depth + opens)
        cognitive += len(BRANCH.findall(r)) * (1 + depth)
        if not python:
            depth = max(0, depth + r.count("{") - r.count("}"))
    return len(rows), params, nesting, 1 + len(BRANCH.findall(plain)), cognitive, len(re.findall(r"\breturn\b", plain))


def maintainability(functions: DataFrame) -> DataFrame:
    """path, name, language and the figures of function_shape, with `over`: which limits they exceed. functions: path,
    name, language, code."""
    names = ["lines", "params", "nesting", "complexity", "cognitive", "returns"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = pd.DataFrame([function_shape(c or "", lang == "python") for c, lang in zip(f["code"], f["language"])], columns=names, dtype="int32")
            yield pd.concat([f[["path", "name", "language"]].reset_index(drop=True), made], axis=1)

    out = functions.select("path", "name", "language", "code").mapInPandas(run, "path string, name string, language string, " + ", ".join(f"{n} int" for n in names))
    return out.withColumn("over", F.array_compact(F.array(*(F.when(F.col(k) > v, F.lit(k)) for k, v in LIMITS.items()))))


def by_language(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("language").agg(F.count("*").alias("n"), F.round(F.avg("lines"), 1).alias("avg_lines"), F.sum("complexity").alias("complexity"), F.count_if(F.size("over") > 0).alias("n_over"))


def write_owners(calls: DataFrame, roles: DataFrame) -> DataFrame:
    """target, n_callers, callers: files that call writing functions of a repository or entity. calls: path, target, fn."""
    r = roles.where(F.col("role").isin("Repository", "Entity/Model")).select(F.col("path").alias("target"))
    w = calls.where(F.lower("fn").rlike("^(save|create|update|delete|insert|remove|persist|write)")).join(r, "target", "left_semi").where("path <> target")
    return w.groupBy("target").agg(F.count_distinct("path").alias("n_callers"), F.array_sort(F.collect_set("path")).alias("callers"))


def domain_clusters(files: DataFrame) -> DataFrame:
    """token, n of files whose name, less its extension and role suffix, is the same; three letters or more, two files or more."""
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    bare = F.regexp_replace(base, r"(?i)(controller|service|repository|model|entity|dto|view|routes?|handler|config|utils?|helpers?|tests?|spec)$", "")
    token = F.lower(F.regexp_replace(bare, "[_-]", ""))
    return files.select(token.alias("token"), "path").where(F.length("token") >= 3).groupBy("token").agg(F.count_distinct("path").alias("n")).where("n >= 2")


def audit(nodes: DataFrame, edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """problem, n: dangling ends, repeated nodes and relations, evidence lines out of their file. lengths: path, n."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target"))
    dangling = ends.join(nodes.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("n")).withColumn("problem", F.lit("dangling"))
    twice = nodes.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n")).withColumn("problem", F.lit("duplicate-node"))
    again = edges.groupBy("source", "target", "type").count().where("count > 1").agg(F.count("*").alias("n")).withColumn("problem", F.lit("duplicate-relation"))
    wrong = edges.join(lengths.toDF("source", "len"), "source").where("line < 1 OR line > len").agg(F.count("*").alias("n")).withColumn("problem", F.lit("evidence-line"))
    return dangling.unionByName(twice).unionByName(again).unionByName(wrong)


#: Design patterns by what a file's text shows; a third value is what its path must show.
PATTERNS = (
    ("Singleton", r"getInstance|let\s+instance\s*=|private\s+static\s+instance", ""),
    ("Factory", r"create[A-Z]\w*\s*\(|return new", ""),
    ("Observer/Event", r"subscribe|addEventListener|\.on\(|emit\(", ""),
    ("Custom Hooks", r"export\s+(?:const|function)\s+use[A-Z]", ""),
    ("Higher-Order Component", r"with[A-Z]\w*\s*=\s*\(|export\s+default\s+connect", ""),
    ("Context Provider", r"createContext|Provider|useContext", ""),
    ("UserForms", r"(?i)Attribute\s+VB_Name\s*=\s*[\"']UserForm", ""),
    ("Modules", r"(?i)Attribute\s+VB_Name\s*=\s*[\"']Module", ""),
    ("Class Modules", r"(?i)Attribute\s+VB_Name\s*=\s*[\"']Class", ""),
    ("Route Decorators", r"@(?:app\.route|router\.|blueprint\.|get|post|put|delete|patch)\s*\(", r"\.py$"),
    ("Dataclasses", r"@dataclass", r"\.py$"),
    ("Abstract Base Classes", r"\bABC\b|@abstractmethod|ABCMeta", r"\.py$"),
    ("Context Managers", r"@contextmanager|def\s+__enter__", r"\.py$"),
    ("Mixins", r"class\s+\w*Mixin\w*\s*[\(:]?", r"\.py$"),
    ("Django Signals", r"Signal\s*\(|@receiver\s*\(|\.connect\s*\(", r"\.py$"),
    ("Middleware", r"class\s+\w*Middleware|def\s+middleware\s*\(", r"\.py$"),
)
#: Patterns that a file's name alone shows, and from how many lines on a file is long.
NAMED_PATTERNS = (("Factory", r"(?i)factory[^/]*$"), ("UserForms", r"(?i)UserForm[^/]*$"), ("Middleware", r"(?i)middleware[^/]*\.py$"))
LONG_FILE = 500


def patterns(files: DataFrame, most: int = 20) -> DataFrame:
    """pattern, n, files (the first by path)."""
    shown = [F.when(F.col("content").rlike(p) & F.col("path").rlike(of), F.lit(n)) for n, p, of in PATTERNS] + [F.when(F.col("path").rlike(p), F.lit(n)) for n, p in NAMED_PATTERNS]
    long_ = F.when(F.regexp_count("content", F.lit("\n")) >= LONG_FILE, F.lit("Long File"))
    hit = F.array_distinct(F.array_compact(F.array(*shown, long_)))
    found = files.select("path", F.explode(hit).alias("pattern"))
    first = found.distinct().withColumn("i", F.row_number().over(W.partitionBy("pattern").orderBy("path"))).where(F.col("i") <= most)
    named = first.groupBy("pattern").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return found.groupBy("pattern").agg(F.count("*").alias("n")).join(named, "pattern")


def suggestions(counts: DataFrame) -> DataFrame:
    """rank, title, n: what to do first. counts: kind, n."""
    rows = (("cycle", 1, "Break dependency cycles"), ("secret", 1, "Move secrets out of the code"), ("critical", 1, "Split the most complex files"), ("dead", 10, "Remove functions that nothing calls"), ("large", 3, "Divide large files"), ("duplicate", 3, "Merge duplicated code"))
    title = F.coalesce(*(F.when((F.col("kind") == k) & (F.col("n") >= least), F.lit(t)) for k, least, t in rows))
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i + 1)) for i, (k, _, _) in enumerate(rows)))
    return counts.select(rank.alias("rank"), title.alias("title"), "n").where("title IS NOT NULL").orderBy("rank")


def entry_points(files: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """path, score, signals of where to start reading: ten for each signal in the text, two for a file that imports but is
    not imported."""
    from tessera.functions.scalars import entry_signals
    from tessera.operators.graph import degrees

    d = degrees(edges).withColumnRenamed("node", "path")
    f = files.select("path", entry_signals(F.col("content")).alias("signals")).join(d, "path", "left")
    top = (F.coalesce("n_in", F.lit(0)) == 0) & (F.coalesce("n_out", F.lit(0)) > 0)
    score = F.size("signals") * 10 + F.when(top, 2).otherwise(0)
    return f.select("path", score.alias("score"), "signals").where("score > 0").orderBy(F.desc("score"), "path").limit(most)


#: From how many functions a file is large, and from how many importers it is a hub.
LARGE, HUB = 16, 9


def issues(functions: DataFrame, edges: DataFrame, dead: DataFrame) -> DataFrame:
    """kind, subject, n of what is worth a look: files with dead functions, large files, hubs by distinct importers, and pairs that
    import each other. functions: path, name; dead: path, name."""
    from tessera.operators.graph import mutual_pairs

    count = lambda df, kind, least: df.groupBy(F.col("path").alias("subject")).agg(F.count("*").alias("n")).where(f"n >= {least}").select(F.lit(kind).alias("kind"), "subject", "n")
    importers = edges.where("source <> target").select("source", F.col("target").alias("path")).distinct()
    pairs = mutual_pairs(edges).select(F.lit("mutual").alias("kind"), F.concat_ws(" <> ", "a", "b").alias("subject"), F.lit(2).cast("long").alias("n"))
    return count(dead, "dead-functions", 1).union(count(functions, "large-file", LARGE)).union(count(importers, "hub", HUB)).union(pairs)


def drift_offenders(crossings: DataFrame, most: int = 5) -> DataFrame:
    """source, n of the files with most imports that go up too far. crossings: source, target, gap."""
    return crossings.where("gap > 1").groupBy("source").agg(F.count_distinct("target").alias("n")).orderBy(F.desc("n"), "source").limit(most)


#: Languages whose constructors are named as their class, files whose functions may be components, and names of those.
JVM_FILES, COMPONENT_FILES = r"(?i)\.(?:java|kt|kts|groovy|scala|cs)$", r"(?i)\.(?:jsx|tsx|vue|svelte)$"
COMPONENT_NAMES = r"(?:Component|Page|Layout|View|Screen|Widget|Provider|Dialog|Modal|Panel|Card|Form)$"
TYPES = ("class", "record", "enum", "interface", "trait", "struct", "type")
TYPE_WORDS = r"^\s*(?:(?:export|public|private|protected|abstract|final|sealed|data|open|static)\s+)*(?:class|record|enum|interface|trait|struct|type)\s"


def naming_findings(functions: DataFrame) -> DataFrame:
    """path, name, line, expected of functions whose names break their language's convention. functions: path, name, line,
    class, type, code. Private names, type declarations, constructors and components are spared."""
    leaf, path, code = F.substring_index("name", ".", -1), F.col("path"), F.coalesce("code", F.lit(""))
    python = path.rlike(r"(?i)\.(?:py|pyw|pyi)$")
    constructor = path.rlike(JVM_FILES) & (F.contains(F.lower(F.coalesce("type", F.lit(""))), F.lit("constructor")) | leaf.eqNullSafe(F.substring_index("class", ".", -1)))
    component = leaf.rlike("^[A-Z][a-zA-Z0-9]*$") & (path.rlike(COMPONENT_FILES) | leaf.rlike(COMPONENT_NAMES) | code.rlike(r"return\s*\(?\s*<|=>\s*\(?\s*<"))
    spared = F.startswith("name", F.lit("_")) | F.lower(F.coalesce("type", F.lit(""))).isin(*TYPES) | code.rlike(TYPE_WORDS) | constructor | component
    fine = F.when(python, leaf.rlike("^[a-z][a-z0-9_]*$")).otherwise(leaf.rlike("^[a-z][a-zA-Z0-9]*$"))
    return functions.where(F.col("name").isNotNull() & ~spared & ~fine).select("path", "name", "line", F.when(python, "snake_case").otherwise("camelCase").alias("expected"))
