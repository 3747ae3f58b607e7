"""Failure labels. One shuffle by machine serves labels and features alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from failcast.functions.columns import clip, horizon_class, within
from failcast.schema import FLAG, TASKS


def by_machine() -> WindowSpec:
    """Rows of one machine by day; bounded, as the log has one row per day."""
    return Window.partitionBy("ID").orderBy("DATE")


def first_failure(log: DataFrame) -> DataFrame:
    """First failure day of every machine that has failed."""
    return (
        log.filter(F.col(FLAG) == 1)
        .groupBy("ID")
        .agg(F.min("DATE").alias("FIRST_FAILURE_DATE"))
    )


def rul_labels(log: DataFrame, clip_days: int | None = None) -> DataFrame:
    """Remaining useful life in days for rows up to the machine's first failure.

    Machines without a failure are dropped. The first failure is taken by a
    window instead of a join, in the same sort order as the feature windows, so
    the log is shuffled once.
    """
    rows = by_machine()
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    repeated = F.lag("DATE").over(rows) == F.col("DATE")
    out = (
        log.withColumns(
            {
                "FIRST_FAILURE_DATE": F.min(F.when(F.col(FLAG) == 1, F.col("DATE"))).over(whole),
                "_repeated": F.coalesce(repeated, F.lit(False)),
            }
        )
        .filter(F.col("DATE") <= F.col("FIRST_FAILURE_DATE"))
        .withColumn(
            "RUL_DAYS",
            F.when(
                F.col("_repeated"),
                F.raise_error(F.lit("more than one row for a machine and day; use merge_days")).cast("int"),
            ).otherwise(F.datediff("FIRST_FAILURE_DATE", "DATE")),
        )
        .drop("_repeated")
    )
    if clip_days is not None:
        out = out.withColumn(f"RUL_{clip_days}", clip(F.col("RUL_DAYS"), 0, clip_days))
    return out


def horizon_label(df: DataFrame, days: int, out: str = "IMMINENT_FAILURE") -> DataFrame:
    """1 where the failure is at most ``days`` away."""
    return df.withColumn(out, within(F.col("RUL_DAYS"), days))


def horizon_classes(df: DataFrame, out: str = "FAILURE_HORIZON_CLASS") -> DataFrame:
    return df.withColumn(out, horizon_class(F.col("RUL_DAYS")))


def task_labels(df: DataFrame, tasks: Sequence[tuple[str, int]] = TASKS) -> DataFrame:
    """One row per input row and cumulative task with its 0/1 label."""
    cells = [
        F.struct(F.lit(n).alias("task"), F.lit(d).alias("max_days"), within(F.col("RUL_DAYS"), d).alias("label"))
        for n, d in tasks
    ]
    return df.select("*", F.explode(F.array(*cells)).alias("_t")).select(*df.columns, "_t.*")


def advance_label(log: DataFrame, days: int, mode: str = "forward") -> DataFrame:
    """Label failure-free rows with FAIL_WITHIN_HORIZON.

    ``forward`` looks at the next ``days`` rows. ``trailing`` looks one row ahead
    and ``days - 2`` rows back, the literal effect of shifting by one and taking
    a rolling maximum.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    if mode == "forward":
        hit = F.max(FLAG).over(by_machine().rowsBetween(1, days))
        out = log.withColumn("_hit", hit)
    elif mode == "trailing":
        out = log.withColumn("_next", F.lead(FLAG, 1).over(by_machine()))
        out = out.withColumn("_hit", F.max("_next").over(by_machine().rowsBetween(1 - days, 0))).drop("_next")
    else:
        raise ValueError(f"Unknown mode: {mode}")
    return (
        out.filter(F.col(FLAG) == 0)
        .withColumn("FAIL_WITHIN_HORIZON", F.coalesce(F.col("_hit"), F.lit(0)).cast("int"))
        .drop("_hit")
    )
