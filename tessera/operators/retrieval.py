"""Chunks, embeddings, nearest chunks, their ranking, and conversation history."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS, OVERLAP_LINES, DIMENSIONS, POOL, BONUS = 1500, 3, 384, 48, 0.15


def fixed_chunks(files: DataFrame, size: int = CHUNK_CHARS, most: int = 12_000) -> DataFrame:
    """path, part, content: slices of files that are short enough and not blank."""
    n = F.length("content")
    fit = files.where((n <= most) & (F.trim("content") != ""))
    cut = fit.select("path", "content", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("i"))
    return cut.select("path", (F.col("i") + 1).alias("part"), F.expr(f"substring(content, i * {size} + 1, {size})").alias("content")).where(F.trim("content") != "")


def line_pieces(code: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_LINES) -> list[str]:
    """Whole lines up to a length, each piece beginning with the last lines of the one before."""
    if len(code) <= size:
        return [code]
    out: list[str] = []
    held: list[str] = []
    for line in code.split("\n"):
        held.append(line)
        if sum(map(len, held)) + len(held) >= size:
            out.append("\n".join(held))
            held = held[-overlap:]
    return [*out, "\n".join(held)] if held else out


def line_chunks(files: DataFrame) -> DataFrame:
    """path, part, content by whole lines with overlap; sequential within a file, so an Arrow function."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i + 1, c) for p, code in zip(f["path"], f["content"]) for i, c in enumerate(line_pieces(code or ""))]
            yield pd.DataFrame(rows, columns=["path", "part", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, part int, content string")


_WORD, _RUN = re.compile(r"[^a-z0-9]+"), re.compile(r"[a-z]+|[0-9]+")


def hashed_vector(text: str, size: int = DIMENSIONS) -> list[float]:
    """Signed counts of words and of their letter and digit runs, by FNV-1a, with length one."""
    v = [0.0] * size
    for word in filter(None, _WORD.split(text.lower())):
        for token in (word, *_RUN.findall(word)):
            h, g = 0x811C9DC5, 5381
            for c in map(ord, token):
                h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
                g = ((g * 33) ^ c) & 0xFFFFFFFF
            v[h % size] += -1.0 if g & 1 else 1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    return text.fillna("").map(hashed_vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def vector_topk(chunks: DataFrame, question: list[float], k: int, **only: str) -> DataFrame:
    """The k chunks of greatest cosine similarity, of those whose columns have the values in `only` (such as repository and
    model); a limit over an order, so each task keeps k rows."""
    for name, value in only.items():
        chunks = chunks.where(F.col(name) == value)
    q = F.array(*(F.lit(float(x)) for x in question))
    return chunks.withColumn("similarity", cosine(F.col("embedding"), q)).where("similarity IS NOT NULL").orderBy(F.desc("similarity"), "id").limit(k)


def graph_rerank(candidates: DataFrame, distances: DataFrame, k: int) -> DataFrame:
    """Score is similarity plus a bonus for hops from the open file; candidates: path, similarity; distances: path, hops."""
    near = candidates.orderBy(F.desc("similarity"), "path").limit(POOL).join(distances, "path", "left")
    score = F.col("similarity") + F.coalesce(F.lit(BONUS) / (1 + F.col("hops")), F.lit(0.0))
    return near.where(~F.isnan("similarity")).withColumn("score", score).orderBy(F.desc("score"), F.desc("similarity"), "path").limit(k)


def source_filter(chunks: DataFrame, question: str, floor: float = 0.43, drop: float = 0.09, most: int = 4) -> DataFrame:
    """Chunks worth naming as sources: those of a named file, else strong ones that share a word with the question."""
    named = {n.lower() for n in re.findall(r"[\w.-]+\.[A-Za-z]{1,8}", question)}
    base = F.lower(F.substring_index("path", "/", -1))
    if named:
        return chunks.where(base.isin(*named)).orderBy(F.desc("similarity"), "path").limit(most)
    terms = F.array(*map(F.lit, sorted(set(re.findall(r"[a-zA-Z_][a-zA-Z_0-9]{2,}", question.lower()))) or [""]))
    text = F.lower(F.substring("content", 1, 2500))
    shares = F.arrays_overlap(F.expr(f"regexp_extract_all(substring(lower(content), 1, 2500), '[a-zA-Z_][a-zA-Z_0-9]{{2,}}', 0)"), terms) & (F.length(text) > 0)
    top = F.max("similarity").over(W.partitionBy())
    kept = chunks.orderBy(F.desc("similarity"), "path").limit(POOL).withColumn("bar", F.greatest(F.lit(floor), top - drop)).where(F.col("similarity") >= F.col("bar")).where(shares)
    return kept.drop("bar").orderBy(F.desc("similarity"), "path").limit(most)


def trimmed_history(messages: DataFrame, turns: int = 6, chars: int = 50_000) -> DataFrame:
    """The last turns of each conversation that fit, newest first and at least one; a turn starts at a user's message."""
    order = W.partitionBy("conv_id").orderBy("turn")
    numbered = messages.withColumn("t", F.count_if(F.col("role") == "user").over(order)).where("t > 0")
    size = numbered.groupBy("conv_id", "t").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("size"))
    back = W.partitionBy("conv_id").orderBy(F.desc("t"))
    kept = size.withColumn("n", F.row_number().over(back)).withColumn("so_far", F.sum("size").over(back.rowsBetween(W.unboundedPreceding, 0)))
    kept = kept.where((F.col("n") <= turns) & ((F.col("n") == 1) | (F.col("so_far") <= chars)))
    return numbered.join(kept.select("conv_id", "t"), ["conv_id", "t"])


def prompt(chunks: DataFrame, each: int = 1200, total: int = 12_000) -> DataFrame:
    """One row: the chunks' texts in rank order, each and together cut to a length. chunks: rank, path, content."""
    piece = F.concat(F.lit("### "), F.col("path"), F.lit("\n"), F.substring("content", 1, each))
    few = chunks.orderBy("rank").limit(total)  # each piece has a character at least
    rows = few.select(F.struct("rank", piece.alias("p")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return rows.select(F.substring(F.array_join(F.col("rs.p"), "\n\n"), 1, total).alias("prompt"))


def chunk_metadata(functions: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """functions (path, name, line, ...) with class_name, the first class of the file by line, and imports, what it imports."""
    first = classes.groupBy("path").agg(F.min(F.struct("line", "name")).alias("c")).select("path", F.col("c.name").alias("class_name"))
    targets = edges.where("type = 'import'").groupBy(F.col("source").alias("path")).agg(F.array_sort(F.collect_set("target")).alias("imports"))
    return functions.join(first, "path", "left").join(targets, "path", "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))


MENTIONED, NAMES = 3, 8


def mentioned_files(files: DataFrame, question: str, primary: str | None = None, most: int = MENTIONED) -> DataFrame:
    """path, exact of files that a question names by their last part, those named with their whole path first; no private or
    odd paths, and not the file that is open."""
    from tessera.functions.scalars import sensitive_path, valid_path

    names = list(dict.fromkeys(n.lower() for n in re.findall(r"[\w.-]+\.[A-Za-z]{1,8}", question)))[:NAMES]
    path = F.col("path")
    fits = F.lower(F.substring_index(path, "/", -1)).isin(*names) & valid_path(path) & ~sensitive_path(path) & ~path.eqNullSafe(F.lit(primary))
    exact = F.contains(F.lit(question.lower()), F.lower(path))
    return files.where(fits).select("path", exact.alias("exact")).orderBy(F.desc("exact"), "path").limit(most)


WINDOW_LINES, LISTED, NEIGHBOURS = 400, 200, 150


def read_window(files: DataFrame, path: str, start: int = 1, end: int | None = None, most: int = WINDOW_LINES) -> DataFrame:
    """path, line, text of lines start to end of a file, at most `most`; nothing of private or odd paths."""
    from tessera.functions.scalars import sensitive_path, valid_path

    p = F.col("path")
    own = files.where((p == path) & valid_path(p) & ~sensitive_path(p)).select("path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    last = min(start + most - 1, end) if end else start + most - 1
    return own.where((F.col("n") + 1).between(start, last)).select("path", (F.col("n") + 1).alias("line"), "text")


def list_files(files: DataFrame, prefix: str = "", most: int = LISTED) -> DataFrame:
    """The first paths that start so, without private ones."""
    from tessera.functions.scalars import sensitive_path

    return files.where(F.startswith("path", F.lit(prefix)) & ~sensitive_path(F.col("path"))).select("path").orderBy("path").limit(most)


def dependencies_of(edges: DataFrame, path: str, most: int = NEIGHBOURS) -> DataFrame:
    """direction, path, type of a file's neighbours, the first by name; partial if there are more."""
    out = edges.where(F.col("source") == path).select(F.lit("imports").alias("direction"), F.col("target").alias("path"), "type")
    both = out.union(edges.where(F.col("target") == path).select(F.lit("imported-by"), "source", "type")).distinct()
    status = "partial" if both.count() > most else "complete"
    return both.orderBy("direction", "path", "type").limit(most).withColumn("status", F.lit(status))
