"""Values that run from an input through calls and their parameters to a dangerous operation.

One Arrow pass sums up each function by itself: which of its parameters, and which inputs read in it, reach an operation (a sink) or
an argument of a call. Arguments are then bound to the parameters of the functions that calls are resolved to, by joins, and a frontier of
(input, function, parameter) goes on call by call until nothing new is reached. A call that passes only clean arguments goes nowhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.extract import SINK, SOURCE, WORDS_NOT_CALLED, View, language, pattern_facts, python_facts
from tessera.operators.lexer import holders
from tessera.plans.storage import dropped, stored

HOPS, STATEMENT_LINES = 3, 24
PART = "kind string, path string, function string, param int, source_line int, line int, name string, position int"
PYTHON_TEXT = re.compile(r"((?:\b[rRbBuUfF]{1,2})?)('''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")|#[^\n]*")
CALL = re.compile(r"\b([A-Za-z_$][\w$]*)\s*\(")
ASSIGNED = re.compile(r"\s*(?:(?:const|let|var|final|[A-Z][\w<>\[\], ]*)\s+)?(?:([A-Za-z_$][\w$]*)|[{\[]([\w\s,$]+)[}\]])\s*(?::[^=]+)?=(?![=>])")
#: What follows a function's name up to its parameters. A pattern that holds the name would be compiled anew for each function.
DECLARED = re.compile(r"\s*(?:[:=]\s*(?:async\s*)?(?:function\s*\w*\s*)?)?(\(|\w+\s*=>)")
WORD = re.compile(r"\b")
HTML = re.compile(r"\binnerHTML\s*=")


def python_code(content: str) -> str:
    """Strings and comments blanked, but for what f-strings compute."""

    def blank(m: re.Match) -> str:
        if m[1] and "f" in m[1].lower():
            return "".join(p if k % 2 else re.sub(r"[^\n]", " ", p) for k, p in enumerate(re.split(r"(\{[^{}]*\})", m[0])))
        return re.sub(r"[^\n]", " ", m[0])

    return PYTHON_TEXT.sub(blank, content)


def within(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The parts, by commas, of the brackets that open at `at`, and where they close."""
    depth, parts, start = 0, [], at + 1
    for m in re.compile(r"[()\[\]{},]").finditer(text, at):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
            if not depth:
                return [*parts, (start, m.start())] if text[start : m.start()].strip() or parts else [], m.start()
        elif depth == 1:
            parts.append((start, m.start()))
            start = m.end()
    return [*parts, (start, len(text))], len(text)


def whole_words(code: str, name: str) -> Iterator[int]:
    """Ends of a name's places between word boundaries."""
    at = code.find(name)
    while at >= 0:
        end = at + len(name)
        if WORD.match(code, at) and WORD.match(code, end):
            yield end
        at = code.find(name, at + 1)


def parameters(code: str, name: str, kind: str) -> list[str]:
    """Names of a function's parameters; code starts with its declaration."""
    m = next(filter(None, (DECLARED.match(code, end) for end in whole_words(code, name))), None)
    if not m:
        return []
    if m[1] != "(":
        return [m[1].split("=")[0].strip()]
    out = []
    for a, b in within(code, m.start(1))[0]:
        text = code[a:b].split("=")[0].strip().lstrip("*.")
        if kind in ("java", "csharp", "c", "cpp"):
            text = (re.findall(r"[\w$]+", text) or [""])[-1]
        out.append(re.split(r"[\s:]", text)[0] if kind not in ("java", "csharp", "c", "cpp") else text)
    return out


def function_parts(path: str, content: str) -> list[tuple]:
    """Rows of PART of all functions of a file."""
    kind = language(path)
    view = View(content, kind)
    code = python_code(content) if kind == "python" else view.code
    declared = python_facts(path, content) if kind == "python" else pattern_facts(path, view)
    functions = [(f[2], f[3], f[4]) for f in declared if f[0] == "function" and f[7] != "synthetic"]
    lines, out = code.split("\n"), set()
    owner = holders([(first, last, k) for k, (_, first, last) in enumerate(functions)], list(range(1, len(lines) + 1)))
    for k, (name, first, last) in enumerate(functions):
        own = [line if owner[first - 1 + i] == k else "" for i, line in enumerate(lines[first - 1 : last])]
        key = f"{path}|{first}|{name}"
        known = {p: {(i, None)} for i, p in enumerate(parameters("\n".join(lines[first - 1 : min(last, first + 80)]), name, kind)) if p}
        at = 0
        while at < len(own):
            text, start = own[at], at
            at += 1
            while at < len(own) and at - start < STATEMENT_LINES and sum(text.count(c) for c in "([") > sum(text.count(c) for c in ")]"):
                text += "\n" + own[at]
                at += 1

            def labels(part: str, place: int, text=text, start=start) -> set:
                found = set().union(*(known[w] for w in re.findall(r"[\w$]+", part) if w in known)) if part else set()
                return found | {(None, first + start + text.count("\n", 0, place + m.start())) for m in SOURCE.finditer(part)}

            head = start == 0
            for m in CALL.finditer(text):
                if m[1] in WORDS_NOT_CALLED or head and m[1] == name:
                    continue
                line = first + start + text.count("\n", 0, m.start())
                for i, (a, b) in enumerate(within(text, m.end() - 1)[0]):
                    for param, source in labels(text[a:b], a):
                        out.add(("argument", path, key, param, source, line, m[1], i))
                        if SINK.match(m[0]):
                            out.add(("sink", path, key, param, source, line, m[1], None))
            for m in HTML.finditer(text):
                out |= {("sink", path, key, param, source, first + start, "innerHTML", None) for param, source in labels(text[m.end() :], m.end())}
            given = None if head and kind != "python" else ASSIGNED.match(text)
            if given:
                found = labels(text[given.end() :], given.end())
                for variable in re.findall(r"[\w$]+", given[1] or given[2]):
                    if found:
                        known[variable] = found
                    else:
                        known.pop(variable, None)
    return sorted(out, key=repr)


def parts(files: DataFrame) -> DataFrame:
    """What each function does with its parameters and inputs; see PART. A file that can't be read has none."""

    def read(path: str, content: str | None) -> list[tuple]:
        try:
            return function_parts(path, content or "")
        except Exception:  # the extraction has its diagnostic
            return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, c in zip(f["path"], f["content"]) for r in read(p, c)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PART.split(", ")]).astype({c: "Int32" for c in ("param", "source_line", "line", "position")})

    return files.select("path", "content").mapInPandas(run, PART)


def parameter_flows(files: DataFrame, calls: DataFrame, hops: int = HOPS, most: int | None = None) -> DataFrame:
    """source, source_line, sink, sink_line, operation, hops, trace (functions), status of the flows with at most `hops` calls, each
    by a shortest trace. calls: what extract.resolve_calls gives. With `most`, that many flows by source; status says if there are more."""
    spark = files.sparkSession
    found = stored(parts(files), "parts")
    to = calls.where("resolution = 'resolved'").select("path", "line", "name", F.col("target").alias("callee")).distinct()
    passed = found.where("kind = 'argument'").join(to, ["path", "line", "name"]).select("function", "param", "source_line", "callee", "position").distinct()
    passed = stored(passed, "passed")
    sinks = found.where("kind = 'sink'").select(F.col("function").alias("sink"), "param", "source_line", F.col("line").alias("sink_line"), F.col("name").alias("operation"))
    start = passed.where("source_line IS NOT NULL").select(F.col("function").alias("source"), "source_line", F.col("callee").alias("at"), F.col("position").alias("param"), F.array("function", "callee").alias("trace"))
    keys = ["source", "source_line", "at", "param"]
    state = stored(start.groupBy(*keys).agg(F.min("trace").alias("trace")), "state")
    levels = [state]
    steps = passed.where("param IS NOT NULL").select(F.col("function").alias("at"), "param", "callee", "position")
    for _ in range(hops - 1):
        on = state.join(steps, ["at", "param"]).select("source", "source_line", F.col("callee").alias("at"), F.col("position").alias("param"), F.array_append("trace", F.col("callee")).alias("trace"))
        for seen in levels:
            on = on.join(seen.select(*keys), keys, "left_anti")
        state = stored(on.groupBy(*keys).agg(F.min("trace").alias("trace")), "state")
        levels.append(state)
        if state.isEmpty():
            break
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.union(level)
    there = reached.join(sinks.where("param IS NOT NULL").drop("source_line"), (F.col("at") == F.col("sink")) & (reached["param"] == sinks["param"]))
    far = there.select("source", "source_line", "sink", "sink_line", "operation", (F.size("trace") - 1).alias("hops"), "trace")
    near = sinks.where("source_line IS NOT NULL").select(F.col("sink").alias("source"), "source_line", "sink", "sink_line", "operation", F.lit(0).alias("hops"), F.array("sink").alias("trace"))
    flows = far.union(near).groupBy("source", "source_line", "sink", "sink_line", "operation").agg(F.min(F.struct("hops", "trace")).alias("b")).select("source", "source_line", "sink", "sink_line", "operation", "b.*")
    out = stored(flows, "flows")
    dropped(spark, found, passed, *levels)
    if most is None:
        return out.withColumn("status", F.lit("complete"))
    return out.orderBy("source", "source_line", "sink", "sink_line", "operation").limit(most).withColumn("status", F.lit("partial" if out.count() > most else "complete"))
