"""Query catalogue: every operator run over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.operators import (
    baselines,
    curves,
    features,
    horizons,
    labels,
    metrics,
    prep,
    splits,
    tuning,
    weights,
)
from failcast.plans.inputs import labelled, scored_long, scored_wide, split_panel
from failcast.schema import CATEGORICAL, REQUIRED_COLUMNS, SENSORS, STATIC_NUMERIC, TASK_BETA, make_tasks
from failcast.sources.machine_log import daily_panel, parse_log
from failcast.sources.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def day_text(name: str = "DATE") -> Column:
    return F.col(name).cast("string").alias(name)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


# --- source, parsing, labels --------------------------------------------------


@query
def daily_panel_(spark, d):
    return daily_panel(spark, d).select("ID", day_text(), *REQUIRED_COLUMNS[2:])


QUERIES["daily_panel"] = QUERIES.pop("daily_panel_")


def _as_text(log: DataFrame) -> DataFrame:
    """The panel as a text log with some unreadable dates and flags."""
    bad_day = (F.col("ID") % 7 == 0) & (F.dayofmonth("DATE") == 13)
    bad_flag = (F.col("ID") % 5 == 0) & (F.dayofmonth("DATE") == 20)
    return log.withColumns(
        {
            "DATE": F.when(bad_day, "13/13/13x").otherwise(F.date_format("DATE", "M/d/yy")),
            "EQUIPMENT_FAILURE": F.when(bad_flag, "n/a").otherwise(F.col("EQUIPMENT_FAILURE").cast("string")),
        }
    )


@query
def parse_coerce(spark, d):
    log = parse_log(_as_text(daily_panel(spark, d)))
    return log.select("ID", day_text(), "EQUIPMENT_FAILURE", "S15")


@query
def date_formats(spark, d):
    """Mixed date formats in one column."""
    log = daily_panel(spark, d)
    text = (
        F.when((F.col("ID") % 7 == 0) & (F.dayofmonth("DATE") == 13), "no date")
        .when(F.col("ID") % 3 == 0, F.date_format("DATE", "yyyy-MM-dd"))
        .when(F.col("ID") % 3 == 1, F.date_format("DATE", "M/d/yyyy"))
        .otherwise(F.date_format("DATE", "M/d/yy"))
    )
    log = parse_log(log.withColumn("DATE", text), date_format=None)
    return log.select("ID", day_text(), "EQUIPMENT_FAILURE")


@query
def first_failure(spark, d):
    return labels.first_failure(daily_panel(spark, d)).select("ID", day_text("FIRST_FAILURE_DATE"))


@query
def rul_labels(spark, d):
    return labelled(spark, d).select("ID", day_text(), day_text("FIRST_FAILURE_DATE"), "RUL_DAYS")


@query
def rul_clipped(spark, d):
    df = labels.horizon_label(labels.rul_labels(daily_panel(spark, d), clip_days=100), 7)
    return df.select("ID", day_text(), "RUL_DAYS", "RUL_100", "IMMINENT_FAILURE")


@query
def horizon_class(spark, d):
    df = labels.horizon_classes(labelled(spark, d))
    return df.select("ID", day_text(), "RUL_DAYS", "FAILURE_HORIZON_CLASS")


@query
def task_labels(spark, d):
    df = labelled(spark, d).select("ID", "DATE", "RUL_DAYS")
    return labels.task_labels(df, make_tasks([30, 0, 7, 7])).withColumn("DATE", F.col("DATE").cast("string"))


def _advance(spark, d, mode):
    log = daily_panel(spark, d).select("ID", "DATE", "EQUIPMENT_FAILURE")
    return labels.advance_label(log, 7, mode).select("ID", day_text(), "FAIL_WITHIN_HORIZON")


@query
def advance_label_forward(spark, d):
    return _advance(spark, d, "forward")


@query
def advance_label_trailing(spark, d):
    return _advance(spark, d, "trailing")


# --- features -------------------------------------------------------------------


@query
def lag_delta(spark, d):
    df = features.rolling_features(labelled(spark, d), windows=())
    pairs = [c for s in SENSORS for c in (F.col(f"{s}_lag1"), F.round(f"{s}_delta1", 6).alias(f"{s}_delta1"))]
    return df.select("ID", day_text(), *pairs)


@query
def rolling_mean_7(spark, d):
    df = features.lag_roll_features(labelled(spark, d))
    return df.select("ID", day_text(), *rounded(*[f"{s}_roll7_mean" for s in SENSORS]))


@query
def rolling_mean_std_multi(spark, d):
    df = features.rolling_features(labelled(spark, d))
    names = [(s, w) for s in SENSORS for w in (7, 14, 30)]
    return df.select(
        "ID",
        day_text(),
        *rounded(*[f"{s}_roll{w}_mean" for s, w in names]),
        *rounded(*[f"{s}_roll{w}_std" for s, w in names], digits=5),
    )


@query
def rolling_slope(spark, d):
    df = features.rolling_features(labelled(spark, d))
    names = [f"{s}_roll{w}_slope" for s in SENSORS for w in (7, 14, 30)]
    return df.select("ID", day_text(), *rounded(*names, digits=5))


@query
def sequence_windows(spark, d):
    df = features.sequence_windows(split_panel(spark, d), "S16", 10, keys=("ID", "split"))
    weighted = F.aggregate(
        F.transform("sequence", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v
    )
    return df.select(
        "ID",
        day_text(),
        "split",
        F.element_at("sequence", 1).alias("first_value"),
        F.element_at("sequence", -1).alias("last_value"),
        F.round(weighted, 4).alias("weighted"),
    )


# --- splits and samples -----------------------------------------------------------


@query
def time_split_2way(spark, d):
    return splits.time_split_2way(labelled(spark, d)).select("ID", day_text(), "split")


@query
def time_split_3way(spark, d):
    return split_panel(spark, d).select("ID", day_text(), "split")


@query
def split_profile(spark, d):
    long = scored_long(scored_wide(spark, d))
    return metrics.label_profile(long, "label", ["task", "split"]).withColumn(
        "positive_rate", F.round("positive_rate", 6)
    )


@query
def data_profile(spark, d):
    df = labels.horizon_label(labels.rul_labels(daily_panel(spark, d), clip_days=100), 7)
    return metrics.data_profile(df, "IMMINENT_FAILURE", "RUL_100").withColumn(
        "positive_rate", F.round("positive_rate", 6)
    )


@query
def class_distribution(spark, d):
    return metrics.class_distribution(scored_wide(spark, d), "true_class", ["split"]).withColumn(
        "share", F.round("share", 6)
    )


@query
def row_cap(spark, d):
    # Several passes find the cut; they read the stored rows.
    train = stored(_train(split_panel(spark, d)).select("ID", "DATE", "RUL_DAYS"))
    return splits.cap_rows(train, 1000).select("ID", day_text(), "RUL_DAYS")


@query
def stratified_split(spark, d):
    log = stored(daily_panel(spark, d).select("ID", "DATE", "EQUIPMENT_FAILURE"))
    return splits.stratified_split(log, "EQUIPMENT_FAILURE").withColumn("DATE", F.col("DATE").cast("string"))


# --- baselines, preparation ---------------------------------------------------------


@query
def id_rate_baseline(spark, d):
    df = labels.horizon_label(split_panel(spark, d), 7)
    df = baselines.id_rate_baseline(df, "IMMINENT_FAILURE")
    return df.select("ID", day_text(), "split", *rounded("score"))


@query
def id_mode_baseline(spark, d):
    df = labels.horizon_classes(split_panel(spark, d), "true_class")
    return baselines.id_mode_baseline(df, "true_class").select("ID", day_text(), "split", "true_class", "pred_class")


@query
def global_rate_baseline(spark, d):
    df = labels.horizon_label(split_panel(spark, d), 30, "y")
    return baselines.global_rate_baseline(df, "y").select("ID", day_text(), "split", *rounded("score"))


@query
def class_weights(spark, d):
    train = scored_wide(spark, d).filter(F.col("split") == "train")
    table = weights.class_weight_table(train, "true_class")
    return table.select("class", "n", *rounded("balanced", "others_per_row"))


def _train(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


@query
def impute_median(spark, d):
    df = stored(split_panel(spark, d))
    fills = prep.medians(_train(df), SENSORS)
    filled = [F.round(F.coalesce(F.col(s), F.lit(fills[s])), 6).alias(s) for s in SENSORS]
    return df.select("ID", day_text(), "split", *filled)


@query
def impute_mode(spark, d):
    table = prep.most_frequent(_train(split_panel(spark, d)), CATEGORICAL)
    return table.withColumnRenamed("column", "column_name")


@query
def standardize(spark, d):
    df = stored(split_panel(spark, d))
    columns = [*STATIC_NUMERIC, *SENSORS]
    model = prep.PanelEncoder(categorical=(), numeric=columns).fit(_train(df))
    values = prep.vector_to_array(F.col("features"))
    z = [F.round(F.get(values, F.lit(i)), 5).alias(c) for i, c in enumerate(columns)]
    return model.transform(df).select("ID", day_text(), "split", *z)


@query
def one_hot(spark, d):
    """Rows per position of the one-hot vector."""
    df = stored(split_panel(spark, d))
    model = prep.PanelEncoder(categorical=CATEGORICAL, numeric=()).fit(_train(df))
    bits = model.transform(df).select("split", F.posexplode(prep.vector_to_array(F.col("features"))))
    return (
        bits.filter(F.col("col") == 1)
        .groupBy(F.col("pos").alias("position"), "split")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- curves, thresholds, metrics -----------------------------------------------------

_BY = ["task", "split"]


def _long(spark, d):
    return scored_long(scored_wide(spark, d))


def _beta():
    return curves.beta_column("task", {k: v for k, v in TASK_BETA.items() if k != "LE_0_DAYS"}, 2.0)


@query
def binary_confusion(spark, d):
    return metrics.binary_confusion(_long(spark, d), 0.5, _BY)


@query
def binary_metrics(spark, d):
    names = ("precision", "recall", "f1", "fbeta", "alert_rate", "pr_auc", "roc_auc")
    return metrics.binary_metrics(_long(spark, d), 0.5, _BY).select(*_BY, *rounded(*names))


@query
def pr_curve(spark, d):
    return curves.pr_curve(_long(spark, d), _BY).select(*_BY, "threshold", *rounded("precision", "recall"))


@query
def pr_curve_thinned(spark, d):
    """The points that draw the curves within 0.02."""
    points = curves.pr_curve(_long(spark, d), _BY, epsilon=0.02)
    return points.select(*_BY, "threshold", *rounded("precision", "recall"))


@query
def roc_curve(spark, d):
    return curves.roc_curve(_long(spark, d), _BY).select(*_BY, "threshold", *rounded("fpr", "tpr"))


@query
def average_precision(spark, d):
    return curves.ranking_metrics(_long(spark, d), _BY).select(*_BY, *rounded("pr_auc"))


@query
def roc_auc(spark, d):
    return curves.ranking_metrics(_long(spark, d), _BY).select(*_BY, *rounded("roc_auc"))


@query
def fbeta_threshold(spark, d):
    return curves.tune_threshold(_long(spark, d), _BY, _beta()).select(*_BY, "threshold", *rounded("best_fbeta"))


@query
def f1_threshold(spark, d):
    return curves.tune_threshold_f1(_long(spark, d), _BY).select(*_BY, "threshold", *rounded("best_f1"))


@query
def tuned_evaluation(spark, d):
    out = curves.tuned_evaluation(_long(spark, d), ["task"], _beta())
    names = ("val_metric", "precision", "recall", "f1", "fbeta", "pr_auc", "roc_auc", "alert_rate")
    return out.select("task", "threshold", *rounded(*names), "positives_val", "positives_test")


@query
def predictability(spark, d):
    long = _long(spark, d)
    points = curves.sweep(long, _BY)
    table = points.groupBy(*_BY).agg(
        curves._average_precision().alias("pr_auc"),
        curves._roc_area().alias("roc_auc"),
        (F.max("positives") / F.max("total")).alias("base_rate"),
    )
    return metrics.predictability(table, "base_rate").select(
        *_BY, *rounded("pr_auc", "roc_auc", "base_rate"), "predictable"
    )


@query
def precision_gain(spark, d):
    test = _long(spark, d).filter(F.col("split") == "test")
    table = metrics.threshold_metrics(test, 0.5, ["task"])
    gain = metrics.precision_gain(table, "LE_30_DAYS", "NOW", "task")
    return gain.select(*rounded("baseline_precision", "model_precision", "gain"), "improved")


@query
def rul_error(spark, d):
    return metrics.rul_error(scored_wide(spark, d), ["split"]).select("split", "n", *rounded("mae", "rmse"))


@query
def rul_error_bands(spark, d):
    return metrics.rul_error_bands(scored_wide(spark, d)).select("band", "n", *rounded("mae", "rmse"))


@query
def event_metrics(spark, d):
    out = metrics.event_metrics(scored_wide(spark, d))
    return out.select(
        "horizon", *rounded("precision", "recall", "f1", "pr_auc"), "support_pos", "pred_pos"
    )


# --- horizons --------------------------------------------------------------------------


def _chosen(spark, d):
    return horizons.horizon_confidence(scored_wide(spark, d))


@query
def multiclass_report(spark, d):
    out = metrics.class_report(_chosen(spark, d), ["split"])
    return out.select("split", "name", *rounded("precision", "recall", "f1"), "support")


@query
def multiclass_confusion(spark, d):
    out = metrics.confusion_matrix(_chosen(spark, d), ["split"])
    return out.select("split", "true_class", "pred_class", "n", *rounded("share_of_true", "share_of_all"))


@query
def multiclass_metrics(spark, d):
    out = metrics.multiclass_metrics(_chosen(spark, d), ["split"])
    return out.select("split", *rounded(*out.columns[1:]))


@query
def close_recall(spark, d):
    out = metrics.multiclass_metrics(_chosen(spark, d), ["split"])
    return out.select("split", *rounded("close_recall_macro"))


@query
def priority_f1(spark, d):
    out = metrics.combined_score(_chosen(spark, d), by=["split"])
    return out.select("split", "metric", *rounded("score"))


@query
def horizon_confidence(spark, d):
    return _chosen(spark, d).select(
        "ID", day_text(), *rounded("conf_NOW", "conf_D1_7", "conf_D8_30", "conf_GT_30")
    )


@query
def horizon_argmax(spark, d):
    return _chosen(spark, d).select("ID", day_text(), "pred_class", *rounded("pred_conf"))


_GATES = {"NOW": 0.9, "LE_7_DAYS": 0.7, "LE_30_DAYS": 0.5}


@query
def horizon_policy(spark, d):
    out = horizons.horizon_policy(scored_wide(spark, d), _GATES)
    return out.select("ID", day_text(), "true_class", "policy_class")


@query
def horizon_cascade(spark, d):
    out = horizons.horizon_cascade(scored_wide(spark, d), _GATES)
    return out.select("ID", day_text(), "cascade_class", "gates_reached")


@query
def cascade_stages(spark, d):
    out = horizons.cascade_stage_metrics(scored_wide(spark, d), _GATES)
    return out.select("stage", "gate", *rounded("precision", "recall", "f1"), "stage_size", "total")


def _grids():
    sizes = {"NOW": 20, "LE_7_DAYS": 25, "LE_30_DAYS": 20}
    return {n: [(i + 1) / (size + 1) for i in range(size)] for n, size in sizes.items()}


def _val(spark, d):
    return scored_wide(spark, d).filter(F.col("split") == "val")


@query
def threshold_grid_search(spark, d):
    return horizons.policy_grid(_val(spark, d), _grids()).select("i", "j", "k", *rounded("score"), "feasible")


@query
def tune_policy(spark, d):
    out = horizons.tune_policy(_val(spark, d), _grids())
    return out.select(*rounded("t_now", "t_le7", "t_le30", "score"), "feasible")


@query
def confidence_summary(spark, d):
    out = horizons.confidence_summary(stored(_chosen(spark, d).select("pred_conf")))
    return out.select(*rounded(*out.columns))


# --- results ------------------------------------------------------------------------------


def _configs(spark, d):
    """Every threshold of the validation curve as a configuration with its F-beta."""
    val = _long(spark, d).filter(F.col("split") == "val")
    return curves.sweep(val, ["task"]).select(
        "task",
        F.round(F.col("score") * 100).cast("int").alias("config_id"),
        curves.curve_f_score(_beta()).alias("val_metric"),
    ).withColumn("val_metric", F.round("val_metric", 9))


@query
def top1_per_task(spark, d):
    return tuning.best_per_task(_configs(spark, d)).select("task", "config_id", *rounded("val_metric"))


@query
def best_flags(spark, d):
    rows = tuning.flag_best(_configs(spark, d))
    params = tuning.params_json({"task": F.col("task"), "config": F.col("config_id")})
    return rows.select("task", "config_id", *rounded("val_metric"), "best_for_task", params.alias("params_json"))


@query
def segment_failure_rate(spark, d):
    table = metrics.segment_failure_rate(daily_panel(spark, d), CATEGORICAL, "EQUIPMENT_FAILURE")
    return table.withColumn("rate", F.round("rate", 6))


@query
def segment_predictability(spark, d):
    """Ranking quality per manufacturer."""
    day = F.dayofyear("DATE")
    rows = labels.horizon_label(labelled(spark, d), 30, "label").select(
        F.col("MANUFACTURER").alias("value"),
        "label",
        (((F.col("S5") * 5 + F.col("S18") * 3 + day * 3) % 101) / 100).alias("score"),
    )
    return curves.ranking_metrics(rows, ["value"]).select("value", *rounded("pr_auc", "roc_auc"))


@query
def prediction_preview(spark, d):
    rows = scored_wide(spark, d).filter(F.col("split") == "test")
    return rows.select("ID", "DATE", "RUL_DAYS", "RUL_PRED").orderBy("ID", "DATE").limit(10).withColumn(
        "DATE", F.col("DATE").cast("string")
    )
