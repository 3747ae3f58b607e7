"""Readers for machine logs and the daily panel derived from order tables.

Every later window runs over one machine. Its size is bounded because the log
has at most one row per machine and day: two-digit years span a century, so a
machine has at most 36,525 rows, however large the log is. ``merge_days`` brings
a log with several readings per day into this form; ``rul_labels`` and the
feature operators fail loudly on a repeated day instead of guessing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from failcast.functions.columns import parse_date, parse_date_any, to_flag
from failcast.schema import (
    CATEGORICAL,
    FLAG,
    MODEL_METADATA_SCHEMA,
    RAW_LOG_SCHEMA,
    SENSORS,
    STATIC_NUMERIC,
    require_columns,
)


def read_log(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw log with text dates and flags, checked for its columns."""
    if fmt == "csv":
        # The header is matched by name; Spark would match a given schema by position.
        header = spark.read.csv(path, header=True, inferSchema=False)
        require_columns(header)
        typed = [
            F.col(f.name).try_cast(f.dataType).alias(f.name) for f in RAW_LOG_SCHEMA.fields
        ]
        return header.select(*typed)
    return require_columns(spark.read.format(fmt).load(path))


def parse_log(df: DataFrame, date_format: str | None = "M/d/yy") -> DataFrame:
    """Typed log: dates parsed (null dates dropped), flag as 0/1, NaN readings as null.

    ``date_format=None`` tries the known formats in order.
    """
    text = F.col("DATE").cast("string")
    day = parse_date_any(text) if date_format is None else parse_date(text, date_format)
    numeric = [c for c in (*STATIC_NUMERIC, *SENSORS) if c in df.columns]
    changes = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in numeric}
    changes["DATE"] = day
    changes[FLAG] = to_flag(F.col(FLAG).cast("string"))
    return df.withColumns(changes).filter(F.col("DATE").isNotNull())


def merge_days(df: DataFrame) -> DataFrame:
    """One row per machine and day: highest flag, mean reading, smallest text.

    Same-day readings are combined before the shuffle, so a machine that reports
    a third of all rows does not overload a task.
    """
    means = [F.avg(c).alias(c) for c in (*STATIC_NUMERIC, *SENSORS)]
    texts = [F.min(c).alias(c) for c in CATEGORICAL]
    return df.groupBy("ID", "DATE").agg(*texts, *means, F.max(FLAG).alias(FLAG))


_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine log derived from the order tables: a machine is a supplier.

    Order lines shrink to one row per supplier and ship date before any join, so
    the joins and the later windows see days, not lines.
    """

    def table(name: str) -> DataFrame:
        return read_table(spark, sf_dir, name)

    lines = table("lineitem")
    fault = (
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.08)
    )
    days = lines.groupBy(
        F.col("l_suppkey").alias("ID"), F.to_date("l_shipdate").alias("DATE")
    ).agg(
        F.max("l_quantity").alias("S5"),
        F.max("l_discount").alias("S8"),
        F.max("l_tax").alias("S13"),
        F.min("l_quantity").alias("_low"),
        F.max("l_extendedprice").alias("S16"),
        F.min("l_extendedprice").alias("S17"),
        F.count(F.lit(1)).cast("double").alias("S18"),
        F.min("l_discount").alias("S19"),
        F.max(F.when(fault, 1).otherwise(0)).alias(FLAG),
    )
    # Each lookup is joined on its own, so Spark knows its size from the file: it
    # broadcasts a small one and sort-merges a large one.
    by_day = Window.partitionBy("ID").orderBy("DATE")
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        days.filter(F.col("DATE").isNotNull())
        .join(table("supplier"), F.col("ID") == F.col("s_suppkey"))
        .join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "ID",
            "DATE",
            F.col("r_name").alias("REGION_CLUSTER"),
            F.concat(F.lit("V"), (F.col("ID") % 5).cast("string")).alias("MAINTENANCE_VENDOR"),
            F.col("n_name").alias("MANUFACTURER"),
            (F.col("ID") % 8).cast("int").alias("WELL_GROUP"),
            F.datediff("DATE", F.min("DATE").over(whole)).cast("double").alias("AGE_OF_EQUIPMENT"),
            "S5",
            "S8",
            "S13",
            F.when(F.col("_low") <= 40, F.col("_low")).alias("S15"),
            "S16",
            "S17",
            "S18",
            "S19",
            FLAG,
        )
    )


def read_model_metadata(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Metadata files of saved best models as one table."""
    return spark.read.schema(MODEL_METADATA_SCHEMA).option("multiLine", True).json(paths)
