"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name under the one that the session names for checkpoints. Where it names none, a master on this
    machine alone has one of its own; a cluster has to name one.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top is None and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{top or tempfile.mkdtemp(prefix='corvane-')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for what is read more than once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table as it is read, dealt over all cores where it has fewer files than there are: a file with a single row group
    is one task's otherwise, whatever is done to its texts. Tables of more files stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(max(cores, df.rdd.getNumPartitions()))


def clear_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that nothing holds any more; it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
