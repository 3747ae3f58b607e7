"""Tables the catalogue queries start from, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.functions.columns import horizon_class, within
from failcast.operators.labels import rul_labels
from failcast.operators.splits import time_split
from failcast.schema import TASKS
from failcast.sources.machine_log import daily_panel

SCORE_OF_TASK = {"NOW": "p_now", "LE_7_DAYS": "p_le7", "LE_30_DAYS": "p_le30"}


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return rul_labels(daily_panel(spark, d))


def split_panel(spark: SparkSession, d: str) -> DataFrame:
    return time_split(labelled(spark, d))


def scored_wide(spark: SparkSession, d: str) -> DataFrame:
    """Split panel with three deterministic scores, which any engine can repeat."""
    day = F.dayofyear("DATE")
    return split_panel(spark, d).select(
        "ID",
        "DATE",
        "split",
        "RUL_DAYS",
        horizon_class(F.col("RUL_DAYS")).alias("true_class"),
        (((F.col("S5") * 7 + F.col("S18") * 13 + day) % 97) / 100).alias("p_now"),
        (((F.col("S5") * 3 + F.col("S18") * 11 + day * 2) % 89) / 100).alias("p_le7"),
        (((F.col("S5") * 5 + F.col("S18") * 3 + day * 3) % 101) / 100).alias("p_le30"),
        ((F.col("S5") * 7 + F.col("S18") * 13 + day) % 120).alias("RUL_PRED"),
    )


def scored_long(wide: DataFrame) -> DataFrame:
    """One row per row and task: split, label, score."""
    cells = [
        F.struct(
            F.lit(task).alias("task"),
            within(F.col("RUL_DAYS"), days).alias("label"),
            F.col(SCORE_OF_TASK[task]).alias("score"),
        )
        for task, days in TASKS
    ]
    return wide.select("split", F.inline(F.array(*cells)))
