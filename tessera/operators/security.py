"""Security rules over source files, and line rules that suggest migrations.

Files are masked once in an Arrow pass (comments blanked; comments and strings blanked; offsets and line breaks stay);
the rules are column expressions over both, so a file is read once for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.text import masked

#: Paths whose code does not run in production, and those that secret rules skip.
SKIPPED = (
    r"(^|/)tests?/|(^|/)__tests__(/|$)|\.(test|spec)\.(js|jsx|ts|tsx|mjs|cjs)$|\.smoke\.(js|mjs|cjs)$|(^|/)benchmarks?(/|$)|(^|/)__mocks__(/|$)"
    r"|(^|/)(__)?fixtures(__)?(/|$)|(^|/)docs?(/|$)|\.(md|markdown|mdx)$"
)
TOOLING = r"(^|/)\.(github|claude)(/|$)|(^|/)(scripts|tools|tooling)(/|$)"
#: An assigned literal credential, what may follow one, and values that are samples.
ASSIGNED = r"(?i)(?:password|passwd|pwd|secret|api_key|apikey|token|auth)\s*[=:]\s*(['\"])([^'\"]{4,})\1"
ENDED = r"^\s*($|[;,})\]]|//|(\+\s*('[^']*'|\"[^\"]*\")\s*)+([;,})\]]|$))"
SAMPLES = r"(?i)^(changeme|change-me|change_me|example|sample|placeholder|your[-_ ]?(api[-_ ]?)?key|your[-_ ]?token|dummy|redacted|replace[-_ ]?me|todo|xxx+|\*{3,}|<[^>]+>)$"
#: Calls that run SQL, and SQL that is put together in such a call.
SQL_CALL = r"\b(?:query|execute|raw|executeQuery|executeUpdate|prepareStatement|createQuery)\s*\("
SQL_JOINED = r"\b(?:query|execute|raw)\s*\(\s*(?:'[^']*'|\"[^\"]*\"|`[^`]*`)\s*\+"
SQL_TEMPLATE = r"(?is)\b(?:query|execute|raw)\s*\(\s*`(?=[^`]*(?:SELECT|INSERT|UPDATE|DELETE))[^`]*\$\{[^`]*`"
HTML_VALUE = r"dangerouslySetInnerHTML\s*[:=]\s*\{\{?\s*__html\s*:\s*([^}]+)\}"
PY, VBA = r"(?i)\.pyw?$", r"(?i)\.(vba|bas|cls|vb)$"
#: Title, severity, path pattern (a leading ! excludes), whether only production paths count, code pattern, how
#: many must be there, whether the first line is given.
RULES = (
    ("Dynamic Code Execution", "medium", r"!(?i)\.(py|pyw|pyi)$", False, r"(?<![\w$.])eval\s*\(", 1, True),
    ("Function Constructor", "medium", "", False, r"\b(?:new\s+)?Function\s*\(", 1, True),
    ("Command Execution", "medium", "", True, r"(?:\b(?:child_process|cp)\.\s*(?:exec|execSync|execFile|execFileSync|spawn|spawnSync)\s*\(|(?<![\w$.])(?:exec|execSync|spawn|spawnSync)\s*\()", 1, True),
    ("Debug Statements", "low", "", False, r"console\.(?:log|debug|info)\(", 4, False),
    ("SendKeys Usage", "high", VBA, False, r"(?i)SendKeys\s*\(", 1, False),
    ("Shell Command Execution", "high", VBA, True, r"(?i)Shell\s*\(", 1, True),
    ("WScript.Shell Creation", "high", VBA, False, r"(?i)CreateObject\s*\(", 1, True),
    ("Dynamic Code Execution", "medium", VBA, False, r"(?i)Application\.Run\s*\(", 1, False),
    ("Excessive Error Suppression", "medium", VBA, False, r"(?i)On Error Resume Next", 3, False),
    ("Python eval()", "high", PY, False, r"(?<![\w$.])eval\s*\(", 1, True),
    ("Python exec()", "high", PY, False, r"(?<![\w$.])exec\s*\(", 1, True),
    ("Pickle Deserialization", "high", PY, False, r"\bpickle\.load|\bunpickle", 1, False),
    ("Shell Injection Risk", "high", PY, True, r"subprocess\.\w+\([^)]*shell\s*=\s*True", 1, False),
    ("OS Command Execution", "high", PY, False, r"\bos\.(?:system|popen)\s*\(", 1, True),
    ("Bare Except Clauses", "medium", PY, False, r"\bexcept\s*:", 3, False),
    ("Assert in Production", "low", r"(?i)^(?!.*test).*\.pyw?$", False, r"\bassert\s+", 6, False),
    ("Debug Mode Enabled", "medium", PY, False, r"\bDEBUG\s*=\s*True\b", 1, False),
)
SEVERITIES = ("high", "medium", "low", "info")


def masked_files(files: DataFrame) -> DataFrame:
    """path, content, scan (without comments), code (without comments and strings)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            python = f["path"].str.lower().str.endswith((".py", ".pyw", ".pyi"))
            body = f["content"].fillna("")
            yield f.assign(content=body, scan=[masked(c, p, strings=False) for c, p in zip(body, python)], code=[masked(c, p) for c, p in zip(body, python)])

    return files.select("path", "content").mapInPandas(run, "path string, content string, scan string, code string")


def production(path: Column) -> Column:
    return ~F.lower(path).rlike(f"{SKIPPED}|{TOOLING}")


def first_line(lines: Column, pattern: str) -> Column:
    return F.array_position(F.transform(lines, lambda line: line.rlike(pattern)), F.lit(True)).cast("int")


def hardcoded(scan: Column, code: Column) -> Column:
    """Lines on which executable code assigns a literal credential."""

    def bad(line: Column, plain: Column) -> Column:
        found = F.regexp_substr(line, F.lit(ASSIGNED))
        at = F.regexp_instr(line, F.lit(ASSIGNED))
        name = F.trim(F.substring(plain, at, F.length(F.regexp_extract(found, r"^[^=:]*?(?=\s*[=:])", 0))))
        after = F.substring(line, at + F.length(found), F.length(line))
        value = F.regexp_extract(found, ASSIGNED, 2)
        named = F.contains(line, F.lit("process.env")) | F.contains(line, F.lit("config."))
        return F.coalesce((name != "") & after.rlike(ENDED) & ~named & ~value.rlike(SAMPLES), F.lit(False))

    hit = F.zip_with(F.split(scan, "\n"), F.split(code, "\n"), bad)
    return F.filter(F.transform(hit, lambda h, i: F.when(h, i + 1)), lambda i: i.isNotNull())


def security_scan(files: DataFrame) -> DataFrame:
    """path, title, severity, line (0: the whole file) of every rule that a file breaks; see RULES."""
    m = masked_files(files).withColumn("lines", F.split("code", "\n"))
    live, hit = production(F.col("path")), lambda title, severity, line: F.struct(F.lit(title).alias("title"), F.lit(severity).alias("severity"), line.cast("int").alias("line"))
    found = []
    for title, severity, of, only, pattern, least, lined in RULES:
        fits = F.regexp_count("code", F.lit(pattern)) >= least
        if of:
            fits &= ~F.col("path").rlike(of[1:]) if of[0] == "!" else F.col("path").rlike(of)
        if only:
            fits &= live
        if title == "WScript.Shell Creation":
            fits &= F.col("scan").rlike(r"(?i)CreateObject\s*\(\s*[\"']WScript\.Shell[\"']")
        found.append(F.when(fits, hit(title, severity, first_line(F.col("lines"), pattern) if lined else F.lit(0))))
    sink = r"innerHTML\s*=|dangerouslySetInnerHTML"
    values = F.regexp_extract_all("scan", F.lit(HTML_VALUE), 1)
    static = ~F.col("code").rlike(r"innerHTML\s*=") & (F.size(values) > 0) & F.forall(values, lambda v: F.trim(v).rlike(r"^(['\"`])(?:(?!\1)[\s\S])*\1$"))
    found.append(F.when(F.col("code").rlike(sink) & live & ~static, hit("Potential XSS Sink", "high", first_line(F.col("lines"), sink))))
    joined = (F.col("code").rlike(r"\b(?:query|execute|raw)\s*\(") & F.col("scan").rlike(SQL_JOINED)) | (F.col("code").rlike(SQL_CALL) & F.col("scan").rlike(SQL_TEMPLATE))
    found.append(F.when(joined, hit("Potential SQL Injection Risk", "high", F.coalesce(F.nullif(first_line(F.col("lines"), SQL_CALL), F.lit(0)), F.lit(0)))))
    secret = F.when(~F.lower("path").rlike(SKIPPED), F.transform(hardcoded(F.col("scan"), F.col("code")), lambda i: hit("Hardcoded Secret", "high", i)))
    # a computed module name: the code has a call, the source no literal after it
    loads = F.zip_with("lines", F.split("scan", "\n"), lambda c, s: c.rlike(r"(?<![\w.])__import__\s*\(") & ~s.rlike(r"(?<![\w.])__import__\s*\(\s*(['\"])(?:\\.|(?!\1)[^\\])*?\1"))
    dynamic = F.when(F.col("path").rlike(PY), F.filter(F.transform(loads, lambda h, i: F.when(h, hit("Dynamic Import", "medium", i + 1))), lambda h: h.isNotNull()))
    none = F.array().cast("array<struct<title: string, severity: string, line: int>>")
    every = F.concat(F.array_compact(F.array(*found)), F.coalesce(secret, none), F.coalesce(dynamic, none))
    return m.select("path", F.explode(every).alias("f")).select("path", "f.*")


#: Title, category, severity, path pattern or null, and the patterns that a line must all fit; the first rule wins.
MIGRATIONS = (
    ("Replace hardcoded secret with environment variable", "Security", "High", None, (r"(?i)\b(password|secret|api[_-]?key|token)\s*=\s*[\"'][^\"']+[\"']",)),
    ("Avoid eval() for dynamic code execution", "Security", "High", None, (r"\beval\s*\(",)),
    ("Replace deprecated import with new module", "Deprecated APIs", "High", r"\.py$", (r"^\s*import\s+urllib\s*$",)),
    ("Convert callback to async/await", "Deprecated APIs", "Medium", None, (r"function\s*\(.*\)\s*\{\s*$", r"callback|cb\)")),
    ("Update framework/dependency to a current release", "Upgrades", "Medium", None, (r"(?i)^\s*(fastapi|django|flask|numpy|requests|spring-boot-starter)\s*==\s*[\d.]+|\"(react|express|axios|lodash)\":\s*\"[\^~]?[\d.]+\"",)),
    ("Use 'const' or 'let' instead of 'var'", "Modernization", "Low", None, (r"\bvar\s+\w+\s*=",)),
)
PER_FILE = 6


def migrations(lines: DataFrame) -> DataFrame:
    """path, line, title, category, severity, before, after of the first PER_FILE lines of a file that a rule fits.
    lines: path, line, text."""
    text, rule = F.col("text"), F.lit(None).cast("int")
    for i, (_, _, _, path, patterns) in reversed(list(enumerate(MIGRATIONS))):
        fits = F.lit(True) if path is None else F.col("path").rlike(path)
        for p in patterns:
            fits &= text.rlike(p)
        rule = F.when(fits, i).otherwise(rule)
    hit = lines.withColumn("rule", rule).where("rule IS NOT NULL")
    first = hit.withColumn("n", F.row_number().over(W.partitionBy("path").orderBy("line"))).where(F.col("n") <= PER_FILE)
    name = F.trim(F.substring_index(F.trim("text"), "=", 1))
    after = (
        F.when((F.col("rule") == 0) & F.col("path").rlike(r"\.py$"), F.concat(F.lit("import os\n"), name, F.lit(' = os.environ.get("'), F.upper(name), F.lit('")')))
        .when(F.col("rule") == 0, F.concat(F.lit("const "), name, F.lit(" = process.env."), F.upper(name), F.lit(";")))
        .when(F.col("rule") == 2, "from urllib import parse")
        .when(F.col("rule") == 5, F.regexp_replace(F.trim("text"), r"^(.*?)\bvar\b", "$1const"))
    )
    part = lambda k: F.element_at(F.array(*(F.lit(m[k]) for m in MIGRATIONS)), F.col("rule") + 1)
    return first.select("path", "line", part(0).alias("title"), part(1).alias("category"), part(2).alias("severity"), F.trim("text").alias("before"), after.alias("after"))
