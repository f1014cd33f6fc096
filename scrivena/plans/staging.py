"""Intermediate tables in the folder that all executors share.

A staged table cuts lineage the way ``DataFrame.checkpoint`` does, but is
columnar and compressed, is pruned when reread, and survives the loss of any
executor.  The folder is the one the cluster names in
``spark.checkpoint.dir``.  Where that is unset one is made, if driver and
tasks are one process; on a cluster, where each machine would write to a folder
of its own, that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; if that is unset, with a local master, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scrivena-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Delete what this application has staged; DataFrames that read it can't be used any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scrivena-{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return it reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scrivena-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt evenly over the cores if it comes in fewer parts than there are of these (one large file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Arrow batches of some BATCH_BYTES to Python if it names no other size: Spark's own 64 MB are held several times over by each core."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, None) is None:
        conf.set(BATCH_KEY, BATCH_BYTES)
    return df
