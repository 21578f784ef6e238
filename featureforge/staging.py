"""Intermediate tables in the shared folder of the cluster.

A staged table cuts lineage, survives the loss of executors, and gives the
optimizer the true size of a small side, so that a broadcast join is chosen
only when the table really is below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a fresh one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="featureforge-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, label: str = "stage") -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(scan: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """Give a small file scan about one partition per ``rows_per_task`` rows, up to one per core.

    A large table has more splits than cores and is returned as it is. Only a
    table of a few small files is shuffled, so that costly expressions on its
    rows do not run in one task.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() > cores:
        return scan
    tasks = min(cores, scan.count() // rows_per_task + 1)
    return scan.repartition(tasks) if tasks > 1 else scan
