"""Where rows are: tables in the folder that the cluster shares, which cut lineage and survive the loss of executors, and
small tables spread over all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session may lack it and gets a temporary folder; on a cluster
    the executors couldn't see one, so that is an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillflow-"))
    return sc._jsc.sc().getCheckpointDir().get()


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str = "level") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: computed once, pruned by column, known in size.

    Once the table is there nothing needs the shuffles that made it, so their files go at once. The table goes when
    discard() is told so, else when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    system, at = _folder(spark, path)
    system.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read any more."""
    for table in tables:
        system, at = _folder(table.sparkSession, table._written)
        system.delete(at, True)


#: A table below this is a single scan task or few, however many cores there are.
SMALL = 32 << 20


#: Of a table that the scan gives in fewer tasks than there are cores, what a task gets.
PIECE = 4 << 20


def spread(df: DataFrame, few: bool = False) -> DataFrame:
    """A small table's rows over all cores, so that work on each isn't done by one; with few also a table of fewer scan
    tasks than cores, in pieces of bounded size: a task of the scan may hold millions of narrow rows. Filters and columns
    still reach the scan. Tables that have tasks enough, and streams, are left as they are: there is nothing to move at
    scale."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    task = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    most = max(SMALL, cores * task) if few else SMALL
    return df.repartition(max(cores, -(-size // PIECE) if few else 0)) if cores > 1 and size < most else df
