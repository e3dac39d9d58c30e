"""Codes of vectors by small codebooks for each part of them, with a VA-file as the filter of entries.

Components are whole numbers, floor(256 * x). A vector is cut into PARTS equal parts; each part position has a codebook of up
to ENTRIES entries, first the parts of the vectors of the smallest ids. A round assigns each part to its nearest entry and puts
the entry at its parts' mean, rounded down; an entry without parts stays.

Nearest entries by a VA-file: each coordinate of a codebook's entries is quantised to CELL_BITS bits, cells of as many entries each,
known by their least and greatest value. For a block of parts, a lookup table by coordinate and cell has the least and the
greatest squared difference; their sums over an entry's cells bound its distance on both sides. An entry whose lower bound is above
the least upper bound is out; only the others are computed, in whole numbers. The bounds are sure, so codes are exact.

Assignment is one scan. A task sums count and components by part and entry while batches pass and emits those sums alone, so what is
shuffled follows tasks, not rows, and the driver gets the codebooks (ENTRIES x components numbers). The label totals are
summed before they shuffle and joined to codes that are written, so a label of a third of the rows is split by Spark.

Nulls: rows whose vector is null or holds null or non-finite components are dropped; a null vec_id is kept, after all others; null
labels are one label. Repeated rows: each is coded; rows of one id are ordered by their components. Fewer than ENTRIES rows: as many
entries. No rows: none. Vectors of unequal length, or not divisible by PARTS: padded with zeros to the longest one's, rounded up.
Components saturate at +-2^24 (|x| of 65,536), so that distances fit 64 bits; a label's total that doesn't is null. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CELL_BITS = 4
LIMIT = 1 << 24
BLOCK = 2_048
SUMS = "part int, entry int, n long, sums array<long>"
CODED = "vec_id long, label {label}, code string, error long"


class VaFile:
    """The cells of one codebook: entries (k x d), and for each coordinate the cells' least and greatest value and each entry's cell."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        k, d = entries.shape
        count = min(1 << bits, k)
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = rank * count // k  # as many entries in each
        self.low, self.high = np.empty((d, count), np.int64), np.empty((d, count), np.int64)
        for j in range(d):
            for c in range(count):
                own = entries[self.cell[:, j] == c, j]
                self.low[j, c], self.high[j, c] = own.min(), own.max()

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (n x k) of the squared distances of q (n x d), from lookup tables by coordinate and cell."""
        lower = np.zeros((len(q), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(q.shape[1]):
            below, above = self.low[j] - q[:, j, None], q[:, j, None] - self.high[j]
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(-below, -above)
            lower += (near * near)[:, self.cell[:, j]]
            upper += (far * far)[:, self.cell[:, j]]
        return lower, upper

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of q, ties to the lower index, and its squared distance."""
        lower, upper = self.bounds(q)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])  # by row, then by entry
        off = q[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", off, off)
        first = np.flatnonzero(np.diff(row, prepend=-1))  # each row has a candidate: that of the least upper bound
        least = np.minimum.reduceat(distance, first)
        hits = np.flatnonzero(distance == least[row])
        return entry[hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]], least


def whole(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, v (whole components), label of the rows that are kept."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    as_long = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long")
    return vectors.where(F.col(embedding).isNotNull()).where(fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, as_long).alias("v"), F.col(label).alias("label")
    )


def matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and components (rows x width, padded with zeros), for blocks of rows."""
    column = batch.column(batch.schema.get_field_index("v"))
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        sizes = np.diff(part.offsets.to_numpy())
        out = np.zeros((len(part), width), np.int64)
        out[np.arange(width) < sizes[:, None]] = part.flatten().to_numpy()
        yield at, out


def assigned(books: np.ndarray, q: np.ndarray, bits: int, files: list[VaFile]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and summed distances of rows."""
    if not files:
        files += [VaFile(book, bits) for book in books]
    d = books.shape[2]
    codes, error = np.empty((len(q), len(books)), np.int64), np.zeros(len(q), np.int64)
    for p, f in enumerate(files):
        codes[:, p], distance = f.nearest(np.ascontiguousarray(q[:, p * d : (p + 1) * d]))
        error += distance
    return codes, error


def entry_sums(books: np.ndarray, bits: int):
    """For mapInArrow: a task's count and sums by part and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[VaFile] = []
        parts, k, d = books.shape
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for batch in batches:
            for _, q in matrices(batch, parts * d):
                codes, _ = assigned(books, q, bits, files)
                for p in range(parts):
                    n[p] += np.bincount(codes[:, p], minlength=k)
                    np.add.at(sums[p], codes[:, p], q[:, p * d : (p + 1) * d])
        part, entry = np.nonzero(n)
        rows = sums[part, entry]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(rows), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    return run


def coded_rows(books: np.ndarray, bits: int):
    """For mapInArrow: code and error of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[VaFile] = []
        parts, _, d = books.shape
        for batch in batches:
            for at, q in matrices(batch, parts * d):
                codes, error = assigned(books, q, bits, files)
                text = codes.astype(np.uint8).tobytes().hex()
                width = 2 * parts
                rows = batch.slice(at, len(q))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("vec_id"), rows.column("label"), pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return run


def trained(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = CELL_BITS) -> np.ndarray | None:
    """The codebooks (parts x entries x components of a part), or None where there are no rows."""
    widest = kept.agg(F.max(F.size("v"))).first()[0]
    if widest is None:
        return None
    d = max(1, -(-widest // parts))
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    rows = np.zeros((len(seeds), parts * d), np.int64)
    for i, r in enumerate(seeds):
        rows[i, : len(r.v)] = r.v
    books = np.ascontiguousarray(rows.reshape(len(seeds), parts, d).transpose(1, 0, 2))
    for _ in range(rounds):
        found = kept.select("v").mapInArrow(entry_sums(books, bits), SUMS)
        total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)] if d <= 64 else None
        if total:
            sums = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*total).alias("sums"))
        else:
            each = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            sums = each.groupBy("part", "entry").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("sums"))
        new = books.copy()
        for r in sums.collect():  # parts x entries rows
            new[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
        books = new
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = CELL_BITS,
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of each kept row, written to the shared folder; and the codebooks. entries: 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits")
    kept = whole(vectors, vec_id, embedding, label)
    schema = CODED.format(label=kept.schema["label"].dataType.simpleString())
    books = trained(kept, parts, entries, rounds, bits)
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 1), np.int64)
    return stored(kept.mapInArrow(coded_rows(books, bits), schema), "codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """label_error: the errors of all rows of the same label, null where the sum passes 64 bits."""
    totals = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "labels")
    own = totals.withColumnRenamed("label", "own_label")
    return coded.join(own, F.col("label").eqNullSafe(F.col("own_label"))).drop("own_label")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """SQL that assigns by all distances: a row for each vector, part and entry."""
    books = [f"""
b0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, q AS e
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))"""]
    for r in range(ROUNDS + 1):
        books.append(f"""
d{r} AS MATERIALIZED (SELECT vec_id, part, label, q, min([list_sum(list_transform(list_zip(q, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry]) AS best
  FROM p JOIN b{r} USING (part) GROUP BY ALL)""")
        if r < ROUNDS:
            books.append(f"""
s{r} AS (SELECT part, best[2] AS entry, i, sum(q[i]) AS s, count(*) AS n FROM d{r}, unnest(range(1, len(q) + 1)) AS u(i) GROUP BY ALL),
m{r} AS (SELECT part, entry, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS e FROM s{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, c[part * len(c) // {PARTS} + 1:(part + 1) * len(c) // {PARTS}] AS q FROM v, range({PARTS}) AS r(part)),
{','.join(books)},
c AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', best[2])), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM d{ROUNDS} GROUP BY vec_id),
x AS (SELECT sha256(string_agg(CAST(e[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS h FROM b{ROUNDS}, unnest(range(1, len(e) + 1)) AS u(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c, x"""


ORACLE_OP13 = _oracle()
