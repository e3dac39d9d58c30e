"""Findings: identity, repeats, clusters, suppression, user rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How sure a label is, greatest last.
CONFIDENCE = ("UNCERTAIN", "INFERENCE", "FACT")
MAX_PATTERN = 240


def rank(confidence):
    return F.array_position(F.array(*map(F.lit, CONFIDENCE)), confidence)


def deduplicated(findings: DataFrame, evidence: int = 5) -> DataFrame:
    """One row for each rule, path, line and severity: how many, the best confidence, the first ids as evidence."""
    of = ["ruleId", "path", "line", "severity"]
    out = findings.groupBy(*of).agg(F.count("*").alias("n"), F.max(rank(F.col("confidence"))).alias("r"))
    # ranked and cut before they are gathered: a place with very many findings gathers no more than others
    first = findings.select(*of, "id").withColumn("i", F.dense_rank().over(W.partitionBy(*of).orderBy("id"))).where(F.col("i") <= evidence)
    ids = first.groupBy(*(F.col(c).alias(f"_{c}") for c in of)).agg(F.array_sort(F.collect_set("id")).alias("evidence"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of))
    named = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("r").cast("int")).alias("confidence")
    return out.join(ids, same).select(*of, "n", "evidence", named)


def clusters(findings: DataFrame) -> DataFrame:
    """Places where rules of one family (the rule's first word) meet more than once."""
    family = F.split(F.col("ruleId"), r"[._-]")[0].alias("family")
    return findings.groupBy(family, "path", "line").agg(F.count("*").alias("n"), F.count_distinct("ruleId").alias("n_rules")).where("n > 1")


def suppressed(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds status and suppressed_by, the first rule that fits. rules: no, rule (exact, '*' or 'prefix.*'), path, line (null: any).

    A finding asks for what could suppress it: its rule, each prefix of it and '*', with and without its path and line. The
    list is met by an equi join, whatever its length, and gives one row at most for each question.
    """
    any_path, any_line = F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(-1))
    listed = rules.groupBy("rule", any_path.alias("rp"), any_line.alias("rl")).agg(F.min("no").alias("no"))
    words = F.split("ruleId", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.when(i < F.size(words), F.concat(F.array_join(F.slice(words, 1, i), "."), F.lit(".*"))).otherwise(F.col("ruleId")))
    asked = findings.select("id", F.explode(F.array_append(prefixes, F.lit("*"))).alias("rule"), "path", "line")
    asked = asked.select("id", "rule", F.explode(F.array("path", F.lit(""))).alias("rp"), "line").select("id", "rule", "rp", F.explode(F.array("line", F.lit(-1))).alias("rl"))
    hit = asked.join(listed, ["rule", "rp", "rl"]).groupBy("id").agg(F.min("no").alias("suppressed_by"))
    return findings.join(hit, "id", "left").withColumn("status", F.when(F.col("suppressed_by").isNotNull(), "suppressed").otherwise("open"))


def custom_rules(lines: DataFrame, rules: DataFrame, most_rules: int = 200) -> DataFrame:
    """Lines that a user's pattern matches, with status. rules: rule, pattern, include (a path pattern or null). Patterns that are
    too long or nest repeats are left out, and so are rules beyond the first most_rules by name, as partial. Only those few
    rules, a bound of most_rules rows of MAX_PATTERN characters, are sent to every task."""
    safe = rules.where((F.length("pattern") <= MAX_PATTERN) & ~F.col("pattern").rlike(r"\([^)]*[+*][^)]*\)[+*]"))
    status = "partial" if safe.count() > most_rules else "complete"
    hit = F.expr("regexp_like(text, pattern) AND (include IS NULL OR regexp_like(path, include))")
    return lines.join(F.broadcast(safe.orderBy("rule").limit(most_rules)), hit).select("rule", "path", "line", "text", F.lit(status).alias("status"))


#: The names under which tools give a finding's parts, in order of preference.
ALIASES = {"path": ("path", "file", "filePath", "filename"), "start": ("startLine", "line", "lineNumber"), "end": ("endLine", "line", "lineNumber"), "title": ("title", "name", "type")}
EXCERPT = 500


def normalized(findings: DataFrame, files: DataFrame, category: str = "quality") -> DataFrame:
    """id, ruleId, category, severity, confidence, status, title, path, start, end, evidence, source of findings of any layout.

    Missing parts get defaults; an unknown severity is info. Where the file is clear (that path, or the only one of that
    name) and has the line, that line is the evidence and its path the source.
    """
    from tessera.functions.scalars import fnv1a

    def given(names, kind: str, default: str | None = None):
        have = [F.col(f"`{n}`").cast(kind) for n in names if n in findings.columns]
        return F.coalesce(*have, F.lit(default).cast(kind))

    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit("finding"))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    kind, title = given(["category"], "string", category), given(ALIASES["title"], "string")
    severity = F.lower(given(["severity"], "string", "info"))
    rows = findings.select(
        given(["id"], "string").alias("id"), F.coalesce(given(["ruleId"], "string"), F.concat_ws(".", slug(kind), slug(title))).alias("ruleId"), kind.alias("category"),
        F.when(severity.isin("critical", "high", "medium", "low", "info"), severity).otherwise("info").alias("severity"), given(["confidence"], "string", "INFERENCE").alias("confidence"),
        given(["status"], "string", "detected").alias("status"), title.alias("title"), given(ALIASES["path"], "string").alias("path"), given(ALIASES["start"], "int").alias("start"), given(ALIASES["end"], "int").alias("end"),
    )
    base = lambda c: F.substring_index(c, "/", -1)
    known = files.select(F.col("path").alias("exact")).distinct()
    only = files.groupBy(base("path").alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("named")).where("n = 1").drop("n")
    placed = rows.join(known, F.col("path") == F.col("exact"), "left").withColumn("base", base("path")).join(only, "base", "left").withColumn("source", F.coalesce("exact", "named"))
    lines = files.select(F.col("path").alias("source"), F.posexplode(F.split("content", "\n")).alias("n", "text")).select("source", (F.col("n") + 1).alias("start"), F.substring("text", 1, EXCERPT).alias("evidence"))
    out = placed.join(lines, ["source", "start"], "left")
    own = F.concat(F.lit("finding:"), fnv1a(F.concat_ws("|", "ruleId", F.coalesce("path", F.lit("")), F.coalesce(F.col("start").cast("string"), F.lit("")), F.coalesce("title", F.lit("")))))
    source = F.when(F.col("evidence").isNotNull(), F.col("source"))
    return out.select(F.coalesce("id", own).alias("id"), "ruleId", "category", "severity", "confidence", "status", "title", "path", "start", F.coalesce("end", "start").alias("end"), "evidence", source.alias("source"))
