"""A table of repositories whose replacement is one commit: all of it is seen, or nothing.

Below the table's folder: data/commit=<id>/repository=<name>, written whole and never changed; log/revision=<n>, one folder a
commit, with a row for each repository that it replaces, which is also the job that the replacement asks for. A commit
is a rename of its folder to the next free revision, which fails if it is taken. No list of repositories is collected.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "repository string, commit string, n_files long, schema string"


class StaleWriter(RuntimeError):
    """Another commit has replaced one of the repositories since the revision that a writer started from."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder; False if the target is there already."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    files = _fs(spark, target)
    files.mkdirs(_path(spark, target).getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(_path(spark, source)), files.makeQualified(_path(spark, target)), gateway.new_array(rename, 0))
    except Py4JJavaError as e:
        if files.exists(_path(spark, target)):
            return False
        raise e
    return True


def head(spark: SparkSession, path: str) -> int:
    """The last revision; 0 before the first commit."""
    log, files = _path(spark, f"{path}/log"), _fs(spark, path)
    if not files.exists(log):
        return 0
    return max((int(s.getPath().getName().split("=")[1]) for s in files.listStatus(log) if s.getPath().getName().startswith("revision=")), default=0)


def log(spark: SparkSession, path: str, since: int = 0, until: int | None = None) -> DataFrame:
    """LOG and revision: what the commits after `since` have replaced, up to `until` (by default the last there is now)."""
    until = head(spark, path) if until is None else until
    if until == 0:
        return spark.createDataFrame([], LOG + ", revision int")
    rows = spark.read.schema(LOG + ", revision int").option("basePath", f"{path}/log").parquet(f"{path}/log")
    return rows.where((F.col("revision") > since) & (F.col("revision") <= until))


def commit(rows: DataFrame, path: str, repositories: DataFrame | None = None, since: int | None = None) -> int:
    """Replaces repositories by their rows (repository, path, ...) in one commit and returns its revision.

    repositories: which (column repository); by default those that rows names. One without rows becomes empty. Rows of others, rows
    without a repository and a path twice in one repository are refused. since: the revision that the writer has read, by
    default the last; a later commit of one of these repositories makes this one fail, one of others does not.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex
    since = head(spark, path) if since is None else since
    stage, data = f"{path}/staging/{name}", f"{path}/data/commit={name}"
    schema = T.StructType([f for f in rows.schema if f.name != "repository"]).json()
    try:
        rows.withColumn("of", F.col("repository")).write.partitionBy("repository").option("compression", "zstd").parquet(f"{stage}/rows")
        kept = spark.read.schema(T.StructType([*T.StructType.fromJson(json.loads(schema)), T.StructField("of", T.StringType())])).parquet(f"{stage}/rows")
        twice = kept.groupBy("of", "path").count().where("count > 1 OR of IS NULL").limit(1).collect()
        if twice:
            raise ValueError(f"{'duplicate path ' + str(twice[0]['path']) if twice[0]['of'] is not None else 'rows without a repository'}")
        sizes = kept.groupBy(F.col("of").alias("repository")).agg(F.count("*").alias("n_files"))
        asked = (repositories if repositories is not None else sizes).select("repository").distinct()
        if repositories is not None and not sizes.join(asked, "repository", "left_anti").isEmpty():
            raise ValueError("rows of a repository that is not replaced")
        entry = asked.join(sizes, "repository", "left").select("repository", F.when(F.col("n_files").isNotNull(), F.lit(name)).alias("commit"), F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.lit(schema).alias("schema"))
        entry.write.parquet(f"{stage}/log")
        _moved(spark, f"{stage}/rows", data)
        mine, seen = spark.read.schema(LOG).parquet(f"{stage}/log").select("repository"), since
        while True:
            last = head(spark, path)
            if last > seen:
                if not log(spark, path, seen, last).join(mine, "repository", "left_semi").isEmpty():
                    raise StaleWriter(f"replaced after revision {since}")
                seen = last
            if _moved(spark, f"{stage}/log", f"{path}/log/revision={last + 1}"):
                return last + 1
    except Exception:
        _fs(spark, path).delete(_path(spark, data), True)  # nobody reads what no revision names
        raise
    finally:
        _fs(spark, path).delete(_path(spark, stage), True)


def entries(spark: SparkSession, path: str, revision: int | None = None) -> DataFrame:
    """LOG and revision of each repository's last replacement: as of a revision, by default the last. These are the jobs to do."""
    rows = log(spark, path, until=revision)
    return rows.groupBy("repository").agg(F.max_by(F.struct("commit", "n_files", "schema"), "revision").alias("e"), F.max("revision").alias("revision")).select("repository", "e.*", "revision")


def current(spark: SparkSession, path: str, revision: int | None = None) -> DataFrame:
    """The rows of all repositories as of a revision, by default the last. Later commits do not change what this reads. Columns are
    those of the last commit; what earlier rows lack is null."""
    last = head(spark, path) if revision is None else revision
    found = log(spark, path, last - 1, last).select("schema").first()
    if found is None:
        raise ValueError(f"no revision {last}")
    fields = T.StructType.fromJson(json.loads(found["schema"]))
    whole = T.StructType([*fields, T.StructField("commit", T.StringType()), T.StructField("repository", T.StringType())])
    live = entries(spark, path, last).where("commit IS NOT NULL").select("repository", "commit")
    return spark.read.schema(whole).parquet(f"{path}/data").join(live, ["repository", "commit"]).drop("commit")


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Deletes data that no revision among the last `keep` can read, and returns how many commits that were. The log stays."""
    last = head(spark, path)
    rows = log(spark, path, until=last).where("commit IS NOT NULL")
    used = rows.where(F.col("revision") > last - keep).select("commit").union(entries(spark, path, max(last - keep + 1, 0)).where("commit IS NOT NULL").select("commit"))
    old = [r["commit"] for r in rows.select("commit").distinct().join(used, "commit", "left_anti").collect()]  # one a commit, not a repository
    gone = [c for c in old if _fs(spark, path).delete(_path(spark, f"{path}/data/commit={c}"), True)]
    return len(gone)
