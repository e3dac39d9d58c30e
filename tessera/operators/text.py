"""Scans and scores of file contents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXCLUDED = (".git", "node_modules", "dist", "build", "target", "__pycache__", ".venv", "vendor")
BINARY = ("png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "gz", "jar", "class", "exe", "dll", "so", "woff", "woff2", "ttf", "mp4", "mp3")
MAX_BYTES, MAX_FILES, MAX_TOTAL, MAX_DEPTH = 5 << 20, 10_000, 100 << 20, 80


def clearly_binary(content):
    """A NUL, or over 2 % control characters in the first 4,096."""
    head = F.substring(content, 1, 4096)
    return F.contains(content, F.lit("\0")) | (F.regexp_count(head, F.lit(r"[\x00-\x07\x0E-\x1F]")) > 0.02 * F.length(head))


def prepared(files: DataFrame) -> DataFrame:
    """repository, seq, path, content with reason (null: taken in). Budgets by a running sum in order of seq, one
    repository to a window: a snapshot is at most MAX_FILES files, and a file past the budget does not free it."""
    from tessera.functions.scalars import valid_path

    path = F.regexp_replace(F.translate("path", "\\", "/"), "^(\\./)+", "")
    parts = F.split(path, "/")
    size = F.octet_length("content")
    f = files.withColumn("path", path)
    first = F.row_number().over(W.partitionBy("repository", "path").orderBy("seq"))
    f = f.withColumn("nth", first)
    reason = (
        F.when(~valid_path(F.col("path")) | (F.size(parts) > MAX_DEPTH), "unsafe-path").when(F.col("nth") > 1, "duplicate-path")
        .when(F.arrays_overlap(F.slice(parts, 1, F.greatest(F.lit(1), F.size(parts) - 1)), F.array(*map(F.lit, EXCLUDED))) & (F.size(parts) > 1), "excluded-directory")
        .when(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*BINARY) | clearly_binary(F.col("content")), "binary").when(size > MAX_BYTES, "too-large")
    )
    f = f.withColumn("reason", reason)
    running = W.partitionBy("repository").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("reason").isNull(), size).otherwise(0)).over(running)
    count = F.sum(F.col("reason").isNull().cast("int")).over(running)
    return f.withColumn("reason", F.coalesce("reason", F.when((used > MAX_TOTAL) | (count > MAX_FILES), "over-budget"))).drop("nth")


def masked(code: str, python: bool, strings: bool = True) -> str:
    """code with comments, and strings if asked, blanked; offsets and line breaks stay."""
    token = r"'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|#[^\n]*|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"" if python else r"/\*[\s\S]*?\*/|//[^\n]*|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`"
    comment = ("#",) if python else ("/*", "//")
    return re.sub(token, lambda m: re.sub(r"[^\n]", " ", m[0]) if strings or m[0].startswith(comment) else m[0], code)


@F.pandas_udf(T.StringType())
def mask_code(code: pd.Series, python: pd.Series) -> pd.Series:
    return pd.Series([masked(c or "", bool(p)) for c, p in zip(code, python)])


def scan(lines: DataFrame, rules: list[tuple[str, str]], key: str = "path", most: int | None = None) -> DataFrame:
    """key, line, rule of lines; of ordered rules the first that fits, at most `most` lines of a key."""
    rule = reduce(lambda out, r: F.when(F.col("text").rlike(r[1]), r[0]).otherwise(out), reversed(rules), F.lit(None).cast("string"))
    hit = lines.withColumn("rule", rule).where("rule IS NOT NULL").select(key, "line", "rule")
    if most is None:
        return hit
    return hit.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("line"))).where(F.col("n") <= most).drop("n")


#: Credential shapes.
KEY_BLOCK = r"(?is)-----BEGIN (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9_.~+/-]{10,}={0,2}"
TOKENS = r"\b(?:sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|AIza[0-9A-Za-z_-]{25,}|AKIA[0-9A-Z]{16})\b"
SECRET_NAME = r"[a-zA-Z0-9_]*?(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|client[_-]?secret|secret|token|secret[_-]?key|private[_-]?key|access[_-]?key|authorization)[a-zA-Z0-9_]*"
#: What a literal credential does not start with.
NOT_LITERAL = r"(?!os\.getenv|os\.environ|process\.env|getenv\(|\$\{|\{\{|<|\[|None|null|undefined|(?:none|null|true|false)(?![^\s,'\";#]))"


def redacted(text):
    """Keys, bearer and provider tokens, and literal credentials masked; a look-ahead spares references and constants."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), KEY_BLOCK, "[REDACTED_PRIVATE_KEY]")
    out = F.regexp_replace(out, BEARER, "Bearer [REDACTED_SECRET]")
    out = F.regexp_replace(out, TOKENS, "[REDACTED_SECRET]")
    out = F.regexp_replace(out, rf"(?i)(['\"]{SECRET_NAME}['\"]\s*:\s*['\"]){NOT_LITERAL}[^\r\n'\"]+(['\"])", "$1[REDACTED_SECRET]$2")
    return F.regexp_replace(out, rf"(?i)(\b{SECRET_NAME}\s*[:=]\s*)(['\"]?){NOT_LITERAL}[^\s,'\";#]+\2", "$1$2[REDACTED_SECRET]$2")


def shingle_sets(functions: DataFrame, size: int = 5) -> DataFrame:
    """id, s: the sorted distinct hashes of each function's token shingles; shorter functions have no row."""
    tokens = F.filter(F.split("code", r"[^A-Za-z0-9_]+"), lambda t: t != "")

    def hashes(t):
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - (size - 1)))
        return F.array_sort(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(t, i, size), " ")))))

    # the tokens are bound to a variable: a filter pushed down here would otherwise split the code again for each shingle
    bound = F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= size, hashes(t)))[0]
    return functions.select("id", bound.alias("s")).where("s IS NOT NULL")


def clone_classes(sets: DataFrame) -> DataFrame:
    """id, class: functions of one shingle set are a class, named by its least id."""
    least = sets.groupBy(F.xxhash64("s").alias("k"), F.size("s").alias("n")).agg(F.min("id").alias("class"))
    return sets.select("id", F.xxhash64("s").alias("k"), F.size("s").alias("n")).join(least, ["k", "n"]).select("id", "class")


def clone_pairs(functions: DataFrame, size: int = 5, similarity: float = 0.82) -> DataFrame:
    """a < b, similarity of clone classes, by an inverted index over their rarest shingles.

    Two sets of this similarity share one of each one's n - ceil(similarity * n) + 1 rarest shingles, so only those
    are indexed and no pair is lost. Copies count once: pairs are between classes, see clone_classes.
    """
    sets = shingle_sets(functions, size)
    own = sets.join(clone_classes(sets).where("id = class").select("id"), "id", "left_semi")
    post = own.select("id", F.size("s").alias("n"), "s").select("id", "n", F.explode("s").alias("h"))  # n first: rows then don't carry the set
    df = post.groupBy("h").agg(F.count("*").alias("df"))
    ranked = post.join(df, "h").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("df", "h")))
    p = ranked.where((F.col("df") > 1) & (F.col("r") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1)).select("h", "id", "n")
    q = p.toDF("h", "b", "m")
    met = p.withColumnRenamed("id", "a").join(q, "h").where((F.col("a") < F.col("b")) & (F.least("n", "m") >= similarity * F.greatest("n", "m"))).select("a", "b").distinct()
    full = met.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    return full.select("a", "b", F.round(both / (F.size("x") + F.size("y") - both), 4).alias("similarity")).where(F.col("similarity") >= similarity)


def fingerprint_groups(functions: DataFrame) -> DataFrame:
    """fingerprint, n, n_files of functions (file, code) alike in shape: conditions, calls, length in steps of 50."""
    code = F.regexp_replace("code", r"[A-Za-z_]\w*", "I")
    shape = F.concat_ws(":", F.regexp_count(code, F.lit(r"\?")), F.regexp_count(code, F.lit(r"I\(")), F.floor(F.length(code) / 50))
    return functions.groupBy(shape.alias("fingerprint")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files")).where("n_files > 1")


def lcs_ratio(pairs: DataFrame, head: int = 500) -> DataFrame:
    """Adds ratio: the longest common subsequence of a and b (first characters) over the longer length."""
    import numpy as np

    def one(a: str, b: str) -> float:
        a, b = (a or "")[:head], (b or "")[:head]
        if not a or not b:
            return 0.0
        row, y = np.zeros(len(b) + 1, np.int32), np.array(list(b))
        for ch in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == ch, row[:-1] + 1, 0)))
        return float(row[-1]) / max(len(a), len(b))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(ratio=[one(x, y) for x, y in zip(f["a"], f["b"])])

    return pairs.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in pairs.dtypes) + ", ratio double")


#: Shapes of live credentials, and what marks a sample.
SECRETS = (
    ("AWS Access Key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("AWS Secret Key (assigned)", r"(?i)aws_secret_access_key\s*[=:]\s*['\"][A-Za-z0-9/+=]{40}['\"]"),
    ("Google API Key", r"\bAIza[0-9A-Za-z\-_]{35}\b"),
    ("Slack Token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b"),
    ("GitHub Token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("PEM Private Key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("JWT-shaped Literal", r"['\"]eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+['\"]"),
    ("Credentials in Connection String", r"\b(?:mongodb|postgres|postgresql|mysql|redis|amqp)://[^:\s'\"]+:[^@\s'\"]+@"),
)
SAMPLE = r"(?i)example|placeholder|your[_-]|changeme|dummy|xxxx|<[^>]+>"


def secrets(lines: DataFrame, key: str = "path") -> DataFrame:
    """key, line, title of every secret shape in a line that no sample word marks; all shapes are tried."""
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(name)) for name, p in SECRETS)))
    return lines.where(~F.col("text").rlike(SAMPLE)).select(key, "line", F.explode(found).alias("title"))


#: What acquires and releases resources, and what starts and ends transactions.
ACQUIRE = r"(?i)\b(?:open|createReadStream|createWriteStream|getConnection|acquire|lock|connect)\s*\("
RELEASE = r"(?i)\b(?:close|dispose|release|unlock|destroy|disconnect)\s*\("
SCOPED = r"(?i)\b(?:try\s*\(|using\s*\(|with\s+[^:\n]+:|try\s*\{[\s\S]{0,2000}finally\s*\{)"
BEGIN = r"(?i)\b(?:beginTransaction|startTransaction|transaction\.begin|begin_tx|BEGIN)\b"
FINISH = r"(?i)\b(?:commit|rollback|transaction\.commit|transaction\.rollback)\b"


def lifetime_hints(functions: DataFrame) -> DataFrame:
    """functions (code, ...) with what their text shows of resources, transactions and exceptions: acquires, releases, scoped,
    cleanup_gap, tx_starts, tx_ends, tx_gap, throws, catches."""
    has = lambda p: F.col("code").rlike(p)
    n = lambda p: F.regexp_count("code", F.lit(p))
    return functions.select(
        *(c for c in functions.columns if c != "code"), has(ACQUIRE).alias("acquires"), has(RELEASE).alias("releases"), has(SCOPED).alias("scoped"),
        (has(ACQUIRE) & ~has(RELEASE) & ~has(SCOPED)).alias("cleanup_gap"), n(BEGIN).alias("tx_starts"), n(FINISH).alias("tx_ends"), ((n(BEGIN) > 0) & (n(FINISH) == 0)).alias("tx_gap"),
        n(r"\b(?:throw|raise)\b").alias("throws"), has(r"\b(?:catch|except)\b").alias("catches"),
    )


def opposite_guards(functions: DataFrame, near: int = 1_500) -> DataFrame:
    """The other columns, variable: variables that a function tests as if (x) and, within `near` characters, as if (!x)."""
    guard = r"\bif\s*\(\s*(!\s*)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\)"
    others = [c for c in functions.columns if c != "code"]
    parts = F.split("code", r"(?=\bif\s*\()")
    sizes = F.transform(parts, lambda p: F.length(p))
    tests = F.transform(parts, lambda p, i: F.struct(F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, b: a + b).alias("at"), F.regexp_extract(p, "^" + guard, 2).alias("variable"), (F.regexp_extract(p, "^" + guard, 1) != "").alias("negated")))
    rows = functions.select(*others, F.explode(F.filter(tests, lambda t: t["variable"] != "")).alias("t")).select(*others, "t.*")
    after = W.partitionBy(*others, "variable").orderBy("at")
    last = lambda flag: F.last(F.when(F.col("negated") == F.lit(flag), F.col("at")), ignorenulls=True).over(after.rowsBetween(W.unboundedPreceding, -1))
    met = rows.withColumn("other", F.when(F.col("negated"), last(False)).otherwise(last(True)))
    return met.where(F.col("at") - F.col("other") < near).select(*others, "variable").distinct()
