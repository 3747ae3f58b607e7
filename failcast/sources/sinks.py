"""Experiment log, best models with their metadata, and curve tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.operators import curves, metrics
from failcast.sources.storage import stored


def _literal(value):
    if isinstance(value, Mapping):
        return F.struct(*[_literal(value[k]).alias(str(k)) for k in sorted(value, key=str)])
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def log_rows(results: DataFrame, settings: Mapping, run_id: str, counts: Mapping[str, int] | None = None) -> DataFrame:
    """Result rows with run id, time, settings as JSON and row counts."""
    now = datetime.now(timezone.utc).isoformat()
    extra = {
        "run_id": F.lit(run_id),
        "logged_at_utc": F.lit(now),
        "settings_json": F.to_json(_literal(settings)),
        "bins_json": F.to_json(_literal(list(settings.get("bin_max_days", [])) or [0])),
    }
    for name, value in (counts or {}).items():
        extra[name] = F.lit(value).cast("long")
    for name in ("csv_path", "metric", "train_fraction", "val_fraction", "beta", "max_train_rows", "sequence_length"):
        if name in settings:
            extra[name] = F.lit(settings[name])
    return results.withColumns(extra)


def append_experiment_log(
    results: DataFrame, settings: Mapping, path: str, run_id: str, counts: Mapping[str, int] | None = None
) -> DataFrame:
    """Add a run to the log and return the whole log.

    A run has a folder of its own, which is written aside and then put in place of what it held. So a run
    that is logged again, after a failure or by mistake, stands there once, and runs that are logged at the same
    time do not touch each other. The results are written first: they may themselves read the log.
    """
    rows = stored(log_rows(results, settings, run_id, counts)).withColumn("run", F.lit(f"run-{run_id}"))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run").parquet(path)
    return read_experiment_log(results.sparkSession, path)


def read_experiment_log(spark: SparkSession, path: str) -> DataFrame:
    """All runs; a run may have columns that others lack."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("run")


def save_best(model: MLWritable, meta: Mapping, folder: str) -> str:
    """Save a fitted model and its metadata file under ``folder``."""
    spark = SparkSession.getActiveSession()
    task = str(meta["task"]).lower()
    model.write().overwrite().save(f"{folder}/best_model_{task}")
    spark.range(1).select(*[_literal(meta[k]).alias(k) for k in sorted(meta)]).write.mode("overwrite").json(
        f"{folder}/best_model_{task}_metadata"
    )
    return folder


def save_curves(scored: DataFrame, folder: str, by: list[str], epsilon: float = 0.001, **names) -> None:
    """Points of the precision-recall and ROC curves per group, as many as drawing them within ``epsilon`` takes.

    0 keeps a point for each distinct score.
    """
    curves.pr_curve(scored, by, epsilon, **names).write.mode("overwrite").parquet(f"{folder}/pr_curve")
    curves.roc_curve(scored, by, epsilon, **names).write.mode("overwrite").parquet(f"{folder}/roc_curve")


def save_combined(preds: DataFrame, folder: str, by: list[str]) -> None:
    """Confusion matrices, class reports and summary metrics per group."""
    metrics.confusion_matrix(preds, by).write.mode("overwrite").parquet(f"{folder}/confusion")
    metrics.class_report(preds, by).write.mode("overwrite").parquet(f"{folder}/class_report")
    metrics.multiclass_metrics(preds, by).write.mode("overwrite").parquet(f"{folder}/summary")


def save_predictions(scored: DataFrame, path: str) -> None:
    scored.write.mode("overwrite").parquet(path)


def preview(scored: DataFrame, n: int = 10) -> DataFrame:
    """First rows by machine and day."""
    return scored.orderBy("ID", "DATE").limit(n)


def binary_confusions(scored: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """2 x 2 counts per task at its threshold."""
    limit = F.lit(0.5)
    for task, value in limits.items():
        limit = F.when(F.col("task") == task, F.lit(value)).otherwise(limit)
    return metrics.binary_confusion(scored, limit, ["task"])

