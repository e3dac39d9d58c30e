"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one made here where all run on this machine."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(path)
        return sc._jsc.sc().getCheckpointDir().get()
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextlib.contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within it, joins broadcast what shuffles have measured as small, never what is small as a file: texts made from
    templates are a hundred times larger in memory, and a broadcast passes through the driver."""
    before = {k: spark.conf.get(k, None) for k in (STATIC, MEASURED)}
    if before[MEASURED] is None:
        spark.conf.set(MEASURED, spark.conf.get(STATIC))
    spark.conf.set(STATIC, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def measured(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result stored, so that all its joins are planned within measured_broadcasts()."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with measured_broadcasts(spark):
            return stored(query(spark, sf_dir), query.__name__)

    return run


def stored_by(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Like stored(), bucketed by keys: later joins on them leave this side where it is."""
    spark = df.sparkSession
    table = f"tessera_{name}_{uuid.uuid4().hex}"
    (
        df.write.format("parquet").bucketBy(buckets, *keys).option("compression", "zstd")
        .option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    )
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of the catalog alone: the files, and the buckets in out's plan, stay
    return out


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes stored frames that nothing will read again; other tables are left alone."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for frame in frames for f in frame.inputFiles()}:
        if not path.rsplit("/", 1)[-1].startswith(("tessera-", "tessera_")):
            continue
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def released(spark: SparkSession, *frames: DataFrame) -> None:
    """Like dropped(), and lets Spark delete shuffle files out of use."""
    dropped(spark, *frames)
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
