"""Session helpers: one place for the settings every job relies on.

Nothing here creates cluster resources on its own.  ``get_spark`` is for
tests, the bench and local use; on a cluster the caller passes its own
session and only ``ensure_checkpoint_dir`` is consulted.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs for correct and stable results at any scale.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "graphloom") -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    master = master or os.environ.get("GRAPHLOOM_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEM", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only a
    session whose executors are threads of the driver (``local`` or
    ``local[n]``: tests, bench) gets a fresh scratch folder where none is named;
    any other session without a shared folder is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative graph jobs need a shared "
            "folder (HDFS/S3/ABFS) to cut lineage on a cluster")
    local_dir = tempfile.mkdtemp(prefix="graphloom-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Used by the iterative operators (BFS hops, components, Louvain) so a
    lost executor recomputes from the last written state, not from the
    first iteration.  A written table (rather than ``Dataset.checkpoint``)
    gives the next iteration a plain file scan with real statistics and no
    reference to the plan that produced it, so planning time stays flat
    however many rounds run.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/graphloom-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    # the schema is known: no footer reads to infer it again
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table that ``cut_lineage`` wrote for ``df``.

    For iterative operators: call it once the state that replaces ``df`` is
    written, so a job keeps the last rounds only.  Anything else is left alone.
    """
    path = getattr(df, "_table_path", None)
    if path is None:
        return
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    df._table_path = None


def drop_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of jobs that are done and that nothing refers to any more.

    Else they stay until the driver happens to collect its garbage.  For operators that write a table and go on from it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: Tables whose rows carry much text or long vectors: work per row is worth spreading.
WIDE_TABLES = {"documents", "pages", "conversations", "embeddings"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a wide one gets at least the cluster's parallelism worth of partitions.

    A Parquet file with one row group is read by one task, and every narrow
    step after the scan (regex, tokenising) would run in that task.  Large
    inputs have enough partitions already and are left as they are.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    if name not in WIDE_TABLES:
        return df
    parallel = spark.sparkContext.defaultParallelism
    return df.repartition(parallel) if df.rdd.getNumPartitions() < parallel else df
