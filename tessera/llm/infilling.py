"""Fill-in-middle transformation, by DuckDB SQL inside mapInArrow.

Each Arrow batch is registered in a DuckDB connection of the task, in runs of rows of at most RUN_BYTES of text (a longer
text is a run of its own), so a task's memory follows the longest text and not the batch. One SQL statement cuts the texts into
code points (regexp_extract_all), picks two cuts and the form by the SHA-256 of `1:` and the doc_id, slices the three
parts (list_slice, array_to_string) and puts them in order; Arrow comes in and Arrow goes out, with no Python for single rows.

A text that holds one of the marks, or is empty, stays plain: so a mark occurs once in any other output, and cutting an output
at its marks gives the text back (restored()).

Nulls: a null text is empty; a null doc_id draws as the empty string, after the `1:`. Empty texts: plain, n = 0. Repeated rows: each
gives a row; equal ids draw alike, cut at their own length. Long texts: cut whole. No rows: none. Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Marks, and shares in percent of texts that change and, of those, that get their suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST = 90, 20
RUN_BYTES = 2_000_000
DRAW = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {at}, 8) AS UBIGINT)"
TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
RESTORED = TRANSFORMED.replace("output string", "text string, restored_sha256 string")


def transform_sql(changed: int, suffix_first: int) -> str:
    """SQL over batch(doc_id, text)."""
    h1, h2, h3, h4 = (DRAW.format(at=at) for at in (1, 9, 17, 25))
    return f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, {h1} AS h1, {h2} AS h2, {h3} % 100 AS h3, {h4} % 100 AS h4 FROM batch),
formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 >= {changed} THEN 'plain'
    WHEN h4 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, regexp_extract_all(t, '(?s).') AS u FROM formed),
placed AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS a,
    CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS b FROM cut),
sliced AS (
  SELECT * EXCLUDE (u), array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m,
    array_to_string(list_slice(u, b + 1, n), '') AS s FROM placed),
joined AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output FROM sliced)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  output, sha256(output) AS output_sha256 FROM joined"""


#: SQL over batch(the columns of TRANSFORMED): the parts of an output lie between its marks.
RESTORE_SQL = f"""
WITH cut AS (SELECT *, string_split_regex(CASE WHEN form = 'plain' THEN '' ELSE output END, '{PREFIX}|{SUFFIX}|{MIDDLE}') AS part FROM batch),
whole AS (
  SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN part[2] || part[4] || part[3] ELSE part[3] || part[4] || part[2] END AS text FROM cut)
SELECT doc_id, n, form, prefix_chars, middle_chars, text, sha256(text) AS restored_sha256, output_sha256 FROM whole"""


def runs(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.Table]:
    """The batch in runs of rows: a run ends where its texts pass a multiple of `most` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.flatnonzero(np.diff(size // most, append=-1)) + 1
    for start, end in zip(np.append(0, ends[:-1]), ends):
        yield pa.Table.from_batches([batch.slice(start, end - start)])


def by_duckdb(sql: str, text: str, most: int = RUN_BYTES):
    """For mapInArrow: sql over each run of rows, registered as `batch`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # one thread a task; nothing goes to the worker's own disk
        own = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True})
        try:
            for batch in batches:
                for rows in runs(batch, text, most):
                    own.register("batch", rows)
                    yield from own.sql(sql).to_arrow_table().to_batches()
                    own.unregister("batch")
        finally:
            own.close()

    return run


def transformed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, most: int = RUN_BYTES
) -> DataFrame:
    """Each document's output and how it was made; see TRANSFORMED."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(by_duckdb(transform_sql(changed, suffix_first), "text", most), TRANSFORMED)


def restored(made: DataFrame, most: int = RUN_BYTES) -> DataFrame:
    """The texts of transformed(), from output and form alone; see RESTORED."""
    return made.mapInArrow(by_duckdb(RESTORE_SQL, "output", most), RESTORED)


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(transformed(table(spark, sf_dir, "documents"))).drop("text")


ORACLE_OP12 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || doc_id) AS h FROM documents),
g AS (
  SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS g FROM d),
f AS (
  SELECT doc_id, t, n, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR g[3] % 100 >= {CHANGED} THEN 'plain' WHEN g[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM g),
o AS (
  SELECT *, left(t, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o"""
