"""A cache of results by file that keeps to a budget, and its portable copy. scope is what a budget holds for, a repository for one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Budgets of the cache and of its copy. Fixed values.
ENTRIES, CACHE_BYTES, COPY_BYTES = 500, 20 * 1024 * 1024, 8 * 1024 * 1024


def kept(uses: DataFrame, entries: int = ENTRIES, budget: int = CACHE_BYTES) -> DataFrame:
    """What stays of a log of writes and hits (scope, key, at, size, ...): the last row of each key, newest first while each scope has
    at most `entries` keys and `budget` bytes. The first that does not fit ends it, as all older ones would have gone before it.
    at must tell the rows of a scope apart. The rank is cut before bytes are summed, so a scope sums no more than `entries` rows."""
    last = uses.withColumn("r", F.row_number().over(W.partitionBy("scope", "key").orderBy(F.desc("at")))).where("r = 1")
    newest = W.partitionBy("scope").orderBy(F.desc("at"))
    few = last.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= entries)
    total = F.sum(F.coalesce("size", F.lit(0))).over(newest.rowsBetween(W.unboundedPreceding, 0))
    return few.withColumn("total", total).where(F.col("total") <= budget).drop("r", "total")


def copied(entries: DataFrame, version: str, most: int = ENTRIES, budget: int = COPY_BYTES) -> DataFrame:
    """scope, version, path, key, payload, saved of each entry (scope, path, key, payload) for a portable copy: in order of path those
    are saved that still fit; one that doesn't is left out, and the next is tried. Rows are read in order once; what is held is
    a count and a sum. One without key or payload is no entry."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, used = (), 0, 0
        for batch in batches:
            saved = []
            for scope, size in zip(batch.column("scope").to_pylist(), batch.column("size").to_pylist()):
                if at != (scope,):
                    at, n, used = (scope,), 0, 0
                saved.append(n < most and used + size <= budget)
                n, used = n + saved[-1], used + size * saved[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("scope", "version", "path", "key", "payload")), pa.array(saved, pa.bool_())], names=["scope", "version", "path", "key", "payload", "saved"])

    kind = dict(entries.dtypes)
    rows = entries.where("key IS NOT NULL AND payload IS NOT NULL").select("scope", F.lit(version).alias("version"), "path", "key", "payload", F.octet_length("payload").cast("long").alias("size"))
    return rows.repartition("scope").sortWithinPartitions("scope", "path", "key").mapInArrow(fitted, f"scope {kind['scope']}, version string, path {kind['path']}, key {kind['key']}, payload string, saved boolean")


def restored(copy: DataFrame, files: DataFrame, version: str) -> DataFrame:
    """scope, path, key, payload of files (scope, path, key) whose saved result is of this version and of this very content."""
    old = copy.where(F.col("saved") & (F.col("version") == version)).select("scope", "path", "key", "payload")
    return files.select("scope", "path", "key").join(old, ["scope", "path", "key"])
