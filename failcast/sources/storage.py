"""Tables written in passing and results kept for later."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Numbers in the rows of a task that fits a model: 64 MB as doubles.
TASK_NUMBERS = 1 << 23


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the session's checkpoint directory.

    Only a local session may fall back to a folder of its own machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="failcast-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back.

    For tables that several passes read (fitting, tuning, evaluation): they do not
    repeat the work behind them, read only the columns they need, and survive the
    loss of executors.
    """
    path = f"{shared_folder(df.sparkSession)}/failcast-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, numbers_a_row: int, limit: int | None = None) -> DataFrame:
    """``df`` dealt over so many partitions that the rows of one hold at most about ``limit`` numbers.

    A file of a stored table is many times smaller than its rows are in memory, so how Spark cuts files does not
    bound what a task holds. Tables whose partitions are small enough stay as they are.
    """
    wanted = -(-df.count() * max(1, numbers_a_row) // (limit or TASK_NUMBERS))
    return df.repartition(wanted) if wanted > df.rdd.getNumPartitions() else df
