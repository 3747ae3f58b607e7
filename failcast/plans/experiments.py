"""The experiments as whole: log in, result table out.

Every experiment writes its feature table once, fits the preparation on the
train rows once, and scores all tasks and models in one pass over val and test.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failcast.functions.columns import row_hash, within
from failcast.operators import baselines, curves, features, horizons, labels, metrics, splits, tuning, weights
from failcast.operators.importance import permutation_importance, top_feature
from failcast.operators.models import (
    PRESETS,
    add_rul,
    add_score,
    add_scores,
    fit,
    fit_all,
    fit_calibrated_best,
    fit_rul,
    cross_fitted_sigmoid,
    fit_responses,
    on_sequences,
    sequence_responses,
    sequence_settings,
    sigmoid,
)
from failcast.operators.prep import VARIANTS, PanelEncoder, fit_pca, make_preprocessor
from failcast.operators.resample import smote
from failcast.schema import (
    CATEGORICAL,
    CLASS_COST,
    DEFAULT_BETA,
    DEPLOY_THRESHOLDS_ONE_VS_REST,
    IMMINENT_BETA,
    IMMINENT_DAYS,
    IMMINENT_THRESHOLD,
    KEYS,
    SEED,
    SENSORS,
    SEQUENCE_TASK_BETA,
    STATIC_NUMERIC,
    TASK_BETA,
    TASKS,
    TRAIN_FRACTION,
    VAL_FRACTION,
    make_tasks,
    numeric_features,
    require_columns,
)
from failcast.sources.storage import stored

# Forest configurations, boosted search space, sequence settings,
# boosted settings of the three-horizon run.
FOREST_GRID = (
    {"n_estimators": 300, "max_depth": None, "min_samples_leaf": 1, "max_features": "sqrt"},
    {"n_estimators": 500, "max_depth": None, "min_samples_leaf": 1, "max_features": "sqrt"},
    {"n_estimators": 700, "max_depth": 14, "min_samples_leaf": 2, "max_features": "sqrt"},
    {"n_estimators": 900, "max_depth": 18, "min_samples_leaf": 2, "max_features": 0.8},
    {"n_estimators": 1000, "max_depth": 22, "min_samples_leaf": 3, "max_features": 0.7},
)
BOOSTED_SPACE = {
    "n_estimators": [250, 400, 600, 900],
    "max_depth": [3, 4, 5, 6],
    "learning_rate": [0.02, 0.04, 0.06, 0.08],
    "min_child_weight": [1, 3, 5, 8],
    "gamma": [0.0, 0.5, 1.0, 2.0],
    "subsample": [0.7, 0.85, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "reg_alpha": [0.0, 0.1, 0.5],
    "reg_lambda": [1.0, 3.0, 8.0],
    "weight_factor": [0.75, 1.0, 1.25, 1.5],
}
SEQUENCE_LENGTH = 15
SEQUENCE_GRID = (
    {
        "lstm_units": 128,
        "lstm_layers": 2,
        "dropout_after_lstm": 0.2,
        "dense_units": 16,
        "l2_reg": 0.0003,
        "batch_size": 64,
        "learning_rate": 0.001,
        "epochs": 120,
    },
)
SEQUENCE_SPACE = {
    "lstm_units": [64, 128],
    "lstm_layers": [1, 2],
    "dropout_after_lstm": [0.2, 0.3, 0.4],
    "dense_units": [16, 32, 64],
    "l2_reg": [0.0001, 0.0003, 0.001],
    "batch_size": [16, 32, 64],
    "learning_rate": [0.0001, 0.0003, 0.0005, 0.001],
}
STAGE_A_SAMPLES = 12
STAGE_A_EPOCHS = 20
N_TRIALS = 24
THREE_HORIZON_PARAMS = {
    "NOW": {"n_estimators": 261, "max_depth": 15, "learning_rate": 0.005},
    "LE_7_DAYS": {"n_estimators": 261, "max_depth": 10, "learning_rate": 0.002},
    "LE_30_DAYS": {"n_estimators": 703, "max_depth": 15, "learning_rate": 0.06},
}
RESAMPLED_MODELS = {
    "LogReg": ("logreg", {"max_iter": 1000}),
    "RF": ("rf", {"n_estimators": 200, "class_weight": None}),
    "SVM": ("svm", {}),
    "XGB": ("xgb", {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3}),
}
# End of fixed values.

_SPLITS = ("train", "val", "test")


def horizon_table(
    log: DataFrame,
    train: float = TRAIN_FRACTION,
    val: float = VAL_FRACTION,
    max_train_rows: int = 0,
    clip_days: int | None = None,
) -> DataFrame:
    """Labelled, featured and split log, stored; train rows capped if asked for."""
    require_columns(log)
    rul = labels.rul_labels(log, clip_days)
    df = splits.stored_time_split(stored(features.lag_roll_features(rul)), train, val)
    if max_train_rows > 0:
        is_train = F.col("split") == "train"
        df = splits.cap_rows(df.filter(is_train), max_train_rows).unionByName(df.filter(~is_train))
    return df


def _train(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def _held_out(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") != "train")


def encoded(df: DataFrame, encoder: PanelEncoder, keep: Sequence[str]) -> tuple[DataFrame, PipelineModel]:
    """Fit on train rows; the vectors of all rows, stored."""
    model = encoder.fit(_train(df))
    return stored(model.transform(df).select(*keep, "features")), model


def _task(df: DataFrame, days: int) -> DataFrame:
    return df.withColumn("label", within(F.col("RUL_DAYS"), days))


def _positives(df: DataFrame, tasks: Sequence[tuple[str, int]]) -> Column:
    """Train positives per task, from one pass."""
    row = _train(df).agg(*[F.count_if(F.col("RUL_DAYS") <= d).alias(n) for n, d in tasks]).first()
    out = F.lit(0)
    for n, _ in tasks:
        out = F.when(F.col("task") == n, F.lit(row[n])).otherwise(out)
    return out


def _long(wide: DataFrame, cells: Sequence[tuple[Mapping, str]]) -> DataFrame:
    """One row per row and model: the model's tags, split, label and score."""
    parts = []
    for tags, score in cells:
        fixed = [F.lit(v).alias(k) for k, v in tags.items() if k != "days"]
        label = within(F.col("RUL_DAYS"), tags["days"]) if "days" in tags else F.col("label")
        parts.append(F.struct(*fixed, label.alias("label"), F.col(score).alias("score")))
    return wide.select("split", F.inline(F.array(*parts)))


def _betas(table: Mapping[str, float], fallback: float) -> Column:
    return curves.beta_column("task", dict(table), fallback)


# --- advance warning -----------------------------------------------------------


def run_advance_warning(
    log: DataFrame,
    days: int = 7,
    test_fraction: float = 0.2,
    params: Mapping | None = None,
    repeats: int = 8,
    mode: str = "forward",
    seed: int = SEED,
) -> DataFrame:
    """Failure within ``days``: forest, ranking and threshold metrics, top sensor."""
    require_columns(log)
    labelled = labels.advance_label(log, days, mode)
    df = stored(splits.time_split_2way(labelled, test_fraction)).withColumn(
        "label", F.col("FAIL_WITHIN_HORIZON")
    )
    columns = [*CATEGORICAL, *STATIC_NUMERIC, *SENSORS]
    numeric = [*STATIC_NUMERIC, *SENSORS]
    encoder = PanelEncoder(CATEGORICAL, numeric, scale=False).fit(_train(df))
    train = stored(encoder.transform(_train(df)).select("label", "features"))
    model = fit(train, "rf", {"n_estimators": 300, **(params or {})}, seed=seed)
    whole = PipelineModel([encoder, model])
    test = stored(df.filter(F.col("split") == "test").select("ID", "DATE", "label", *columns))

    scored = stored(add_score(test, whole).select("label", "score"))
    best = curves.tune_threshold_f1(scored).first()
    at_half = metrics.binary_metrics(scored, 0.5)
    at_best = metrics.threshold_metrics(scored, F.lit(best["threshold"]))
    sensor = top_feature(permutation_importance(whole, test, "label", columns, repeats, seed), "S").first()
    profile = {r["split"]: r for r in metrics.label_profile(df, "label").collect()}
    row = at_half.select(
        "roc_auc",
        "pr_auc",
        F.col("precision").alias("threshold_50_precision"),
        F.col("recall").alias("threshold_50_recall"),
        F.col("f1").alias("threshold_50_f1"),
        F.lit(best["threshold"]).alias("best_f1_threshold"),
    )
    chosen = at_best.select(
        F.struct(F.col("precision").alias("p"), F.col("recall").alias("r")).alias("x")
    ).scalar()
    row = row.select(
        F.lit(days).alias("horizon_days"),
        F.lit(profile["train"]["n"]).alias("train_rows"),
        F.lit(profile["test"]["n"]).alias("test_rows"),
        F.lit(profile["train"]["positive_rate"]).alias("train_positive_rate"),
        F.lit(profile["test"]["positive_rate"]).alias("test_positive_rate"),
        *row.columns,
        chosen["p"].alias("best_f1_precision"),
        chosen["r"].alias("best_f1_recall"),
        F.lit(best["best_f1"]).alias("best_f1_score"),
        F.lit(sensor["feature"]).alias("most_indicative_measurement"),
        F.lit(sensor["importance"]).alias("most_indicative_score"),
    )
    return metrics.predictability(row, "test_positive_rate")


# --- remaining useful life -------------------------------------------------------


def predict_rul(log: DataFrame, params: Mapping | None = None, windows: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Predicted RUL of val and test rows: ID, DATE, split, RUL_DAYS, RUL_PRED."""
    require_columns(log)
    rul = labels.rul_labels(log)
    df = splits.stored_time_split(stored(features.rolling_features(rul, windows=windows)))
    numeric = ["ID", *STATIC_NUMERIC, *SENSORS, *features.rolling_feature_names(windows=windows)]
    keep = ("ID", "DATE", "split", "RUL_DAYS")
    rows, _ = encoded(df, PanelEncoder(CATEGORICAL, numeric, scale=False), keep)
    model = fit_rul(_train(rows), params)
    return stored(add_rul(_held_out(rows), model).select(*keep, "RUL_PRED"))


def run_rul_regression(log: DataFrame, params: Mapping | None = None) -> DataFrame:
    """Errors on val and test, near-failure errors and event metrics on test."""
    preds = predict_rul(log, params)
    test = preds.filter(F.col("split") == "test")
    overall = metrics.rul_error(preds, ["split"])
    bands = metrics.rul_error_bands(test)
    events = metrics.event_metrics(test)

    def block(df: DataFrame, name: str, group: Column) -> DataFrame:
        wanted = {"n": "bigint", "mae": "double", "rmse": "double", "precision": "double", "recall": "double",
                  "f1": "double", "pr_auc": "double", "support_pos": "bigint", "pred_pos": "bigint"}
        cols = [
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()
        ]
        return df.select(F.lit(name).alias("report"), group.cast("string").alias("part"), *cols)

    return (
        block(overall, "error", F.col("split"))
        .unionByName(block(bands, "near_failure", F.col("band")))
        .unionByName(block(events, "event", F.col("horizon")))
    )


# --- imminent failure --------------------------------------------------------------


def run_imminent(
    log: DataFrame,
    days: int = IMMINENT_DAYS,
    params: Mapping | None = None,
    threshold: float = IMMINENT_THRESHOLD,
    beta: float = IMMINENT_BETA,
    seed: int = SEED,
) -> DataFrame:
    """Machine-rate baseline and forest, each at the default and the tuned threshold."""
    if days < 1:
        raise ValueError("days must be at least 1")
    df = labels.horizon_label(horizon_table(log, clip_days=100), days, "label")
    base = baselines.id_rate_baseline(df, "label", "s_base")
    keep = (*KEYS, "split", "label", "s_base")
    numeric = numeric_features()
    encoder = PanelEncoder(["ID", *CATEGORICAL], numeric, scale=False)
    rows, _ = encoded(base, encoder, keep)
    settings = {"n_estimators": 500, "class_weight": None, **(params or {})}
    model = fit(_train(rows), "rf", settings, seed=seed)
    scored = stored(
        add_score(_held_out(rows), model, "s_model").select("split", "label", "s_base", "s_model")
    )
    long = stored(_long(scored, [({"model": "baseline"}, "s_base"), ({"model": "rf"}, "s_model")]))
    test = long.filter(F.col("split") == "test")
    tuned = curves.tune_threshold(long.filter(F.col("split") == "val"), ["model"], beta)
    limits = {r["model"]: r["threshold"] for r in tuned.collect()}
    at = F.when(F.col("model") == "baseline", F.lit(limits["baseline"])).otherwise(F.lit(limits["rf"]))

    def table(limit: Column, kind: str) -> DataFrame:
        out = metrics.binary_metrics(test, limit, ["model"], 2.0)
        counts = metrics.binary_confusion(test, limit, ["model"])
        # Two rows on each side.
        return out.withColumnRenamed("fbeta", "f2").join(F.broadcast(counts), "model").select(
            F.concat_ws("@", "model", F.lit(kind)).alias("model"), limit.alias("threshold"), *out.columns[1:4],
            "f2", *out.columns[5:], "tp", "fp", "fn", "tn",
        )

    return table(F.lit(threshold), "default").unionByName(table(at, "tuned"))


# --- four classes at once --------------------------------------------------------------


def run_multiclass(
    log: DataFrame, params: Mapping[str, Mapping] | None = None, max_train_rows: int = 0, seed: int = SEED
) -> DataFrame:
    """Machine-mode baseline and three weighted models, chosen by near-class recall on val."""
    df = labels.horizon_classes(horizon_table(log, max_train_rows=max_train_rows), "true_class")
    base = baselines.id_mode_baseline(df, "true_class", out="p_base")
    rows, _ = encoded(
        base,
        PanelEncoder(["ID", *CATEGORICAL], numeric_features()),
        (*KEYS, "split", "true_class", "p_base"),
    )
    settings = params or {}
    kinds = {
        "LogReg balanced": ("logreg_multinomial", {"max_iter": 2000, "class_weight": "balanced"}),
        "LogReg cost-sensitive": ("logreg_multinomial", {"max_iter": 2000, "class_weight": CLASS_COST}),
        "RF cost-sensitive": ("rf", {"n_estimators": 400, "class_weight": CLASS_COST}),
    }
    train = _train(rows)
    models = fit_all(
        [
            lambda k=k, p=p, n=n: fit(train, k, {**p, **settings.get(n, {})}, "true_class", seed=seed)
            for n, (k, p) in kinds.items()
        ],
        3,
    )
    wide = _held_out(rows)
    for i, m in enumerate(models):
        wide = add_score(wide, m, f"p{i}", "prediction")
    cells = [F.struct(F.lit("Baseline").alias("model"), F.lit(0).alias("config_id"), F.col("p_base").alias("pred_class"))]
    cells += [
        F.struct(
            F.lit(n).alias("model"), F.lit(i + 1).alias("config_id"), F.col(f"p{i}").cast("int").alias("pred_class")
        )
        for i, n in enumerate(kinds)
    ]
    preds = stored(
        wide.select("split", "true_class", *[f"p{i}" for i in range(len(models))], "p_base")
    ).select("split", "true_class", F.inline(F.array(*cells)))
    table = metrics.multiclass_metrics(preds, ["split", "model", "config_id"])
    # Eight rows: the validation value of each model decides.
    val = F.when((F.col("split") == "val") & (F.col("config_id") > 0), F.struct(-F.col("close_recall_macro"), F.col("config_id")))
    best = F.min(val).over(Window.partitionBy(F.lit(0)))
    return table.withColumn("_best", best).withColumn(
        "selected", F.col("config_id") == F.col("_best.config_id")
    ).drop("_best")


# --- reduction variants ------------------------------------------------------------------


def run_reduction_variants(
    log: DataFrame,
    days: int = 7,
    variants: Sequence[str] = VARIANTS,
    beta: float = 2.0,
    svd_components: int = 40,
    pca_variance: float = 0.95,
    max_iter: int = 1000,
) -> DataFrame:
    """Logistic regression after each preparation variant, best test F-beta first."""
    df = labels.horizon_label(horizon_table(log), days, "label")

    def one(variant: str) -> DataFrame:
        encoder = make_preprocessor(variant, CATEGORICAL, numeric_features(), svd_components, pca_variance)
        rows, _ = encoded(df, encoder, ("ID", "DATE", "split", "label"))
        model = fit(_train(rows), "logreg", {"max_iter": max_iter})
        return add_score(_held_out(rows), model).select("split", "label", "score", F.lit(variant).alias("variant"))

    scored = one(variants[0])
    for v in variants[1:]:
        scored = scored.unionByName(one(v))
    # Several passes read the scores; the rows are projected and scored once.
    table = curves.tuned_evaluation(stored(scored), ["variant"], beta)
    return table.orderBy(F.col("fbeta").desc(), "variant")


# --- three cumulative horizons --------------------------------------------------------------


def score_horizons(
    rows: DataFrame,
    kind: str,
    tasks: Sequence[tuple[str, int]] = TASKS,
    params: Mapping[str, Mapping] | None = None,
    parallelism: int = 3,
    seed: int = SEED,
) -> tuple[DataFrame, list[Model]]:
    """Scores p_<i> of one model per task for all val and test rows, stored."""
    settings = params or {}

    def one(task: str, days: int) -> Model:
        data = _task(rows, days)
        if kind == "calibrated_best":
            return fit_calibrated_best(data, params=settings)[0]
        return fit(_train(data), kind, settings.get(task, settings.get(kind)), seed=seed)

    models = fit_all([lambda n=n, d=d: one(n, d) for n, d in tasks], parallelism)
    wide = add_scores(_held_out(rows), {f"p_{i}": m for i, m in enumerate(models)})
    return stored(wide.drop("features")), models


def run_horizons(
    log: DataFrame,
    model_type: str = "hgb",
    params: Mapping[str, Mapping] | None = None,
    beta: float = DEFAULT_BETA,
    reduce_all: bool = False,
    max_train_rows: int = 0,
    seed: int = SEED,
) -> DataFrame:
    """Rate baseline and model per task: tuned on val, measured on test."""
    if model_type not in (*PRESETS, "calibrated_best"):
        raise ValueError(f"Unsupported model type: {model_type}")
    df = horizon_table(log, max_train_rows=max_train_rows)
    rows, _ = encoded(
        df,
        PanelEncoder(CATEGORICAL, numeric_features(), reduce_all=reduce_all),
        ("ID", "DATE", "split", "RUL_DAYS"),
    )
    wide, _ = score_horizons(rows, model_type, params=params, seed=seed)
    rates = _train(rows).agg(*[F.avg(within(F.col("RUL_DAYS"), d)).alias(n) for n, d in TASKS]).first()
    wide = wide.withColumns({f"b_{i}": F.lit(rates[n]) for i, (n, _) in enumerate(TASKS)})
    cells = []
    for i, (n, d) in enumerate(TASKS):
        cells.append(({"task": n, "model": "Baseline(global rate)", "days": d}, f"b_{i}"))
        cells.append(({"task": n, "model": model_type, "days": d}, f"p_{i}"))
    table = curves.tuned_evaluation(_long(wide, cells), ["task", "model"], _betas(TASK_BETA, beta))
    return table.withColumn("positives_train", _positives(rows, TASKS)).orderBy("task", F.col("fbeta").desc())


def three_horizon_scores(
    log: DataFrame,
    params: Mapping[str, Mapping] = THREE_HORIZON_PARAMS,
    kind: str = "xgb",
    reduce_all: bool = True,
    seed: int = SEED,
) -> DataFrame:
    """Val and test rows with p_now, p_le7, p_le30 and the true class, stored."""
    rows, _ = encoded(
        horizon_table(log),
        PanelEncoder(CATEGORICAL, numeric_features(), reduce_all=reduce_all),
        ("ID", "DATE", "split", "RUL_DAYS"),
    )
    wide, _ = score_horizons(rows, kind, params=params, seed=seed)
    names = {f"p_{i}": c for i, c in enumerate(horizons.SCORES)}
    return labels.horizon_classes(wide.withColumnsRenamed(names), "true_class")


def tuned_limits(scores: DataFrame, beta: float = DEFAULT_BETA) -> dict[str, float]:
    """Tuned threshold of each task on the val rows: three numbers."""
    cells = [
        ({"task": n, "days": d}, c) for (n, d), c in zip(TASKS, horizons.SCORES)
    ]
    val = _long(scores.filter(F.col("split") == "val"), cells)
    tuned = curves.tune_threshold(val, ["task"], _betas(TASK_BETA, beta))
    return {r["task"]: r["threshold"] for r in tuned.collect()}


def run_three_horizons(
    log: DataFrame,
    params: Mapping[str, Mapping] = THREE_HORIZON_PARAMS,
    beta: float = DEFAULT_BETA,
    deploy: Mapping[str, float] = DEPLOY_THRESHOLDS_ONE_VS_REST,
    tune_combination: bool = False,
    combination_metric: str = "priority_weighted_f1",
    seed: int = SEED,
) -> DataFrame:
    """Test quality of the three ways to combine the horizon models.

    With ``tune_combination`` the policy uses the jointly tuned thresholds.
    """
    scores = three_horizon_scores(log, params, seed=seed)
    limits = tuned_limits(scores, beta)
    if tune_combination:
        val = scores.filter(F.col("split") == "val")
        best = horizons.tune_policy(val, metric=combination_metric).first()
        deploy = {"NOW": best["t_now"], "LE_7_DAYS": best["t_le7"], "LE_30_DAYS": best["t_le30"]}
    test = scores.filter(F.col("split") == "test")
    out = horizons.horizon_confidence(test)
    out = horizons.horizon_cascade(horizons.horizon_policy(out, deploy), limits)
    rules = {"confidence": "pred_class", "policy": "policy_class", "cascade": "cascade_class"}
    cells = [F.struct(F.lit(r).alias("rule"), F.col(c).alias("rule_class")) for r, c in rules.items()]
    preds = out.select("true_class", F.inline(F.array(*cells)))
    return metrics.multiclass_metrics(preds, ["rule"], pred="rule_class")


def three_horizon_report(scores: DataFrame, beta: float = DEFAULT_BETA) -> DataFrame:
    """Per task: tuned on val, measured on test."""
    cells = [({"task": n, "days": d}, c) for (n, d), c in zip(TASKS, horizons.SCORES)]
    return curves.tuned_evaluation(_long(scores, cells), ["task"], _betas(TASK_BETA, beta))


# --- tuning -------------------------------------------------------------------------------


def _evaluate_configs(
    rows: DataFrame,
    tasks: Sequence[tuple[str, int]],
    configs: Sequence[Mapping],
    fit_one,
    metric: str,
    betas: Mapping[str, float],
    beta: float,
    parallelism: int,
    effective: Callable[[Mapping], Mapping] = dict,
) -> tuple[DataFrame, dict[tuple[str, int], Model]]:
    """One row per task and configuration; every fitted model by (task, config_id).

    Configurations that are equal in what ``effective`` keeps of them share one fit and one score.
    """
    jobs = [(n, d, i + 1, p) for n, d in tasks for i, p in enumerate(configs)]
    kinds = [(n, json.dumps(effective(p), sort_keys=True, default=str)) for n, _, _, p in jobs]
    first = {kind: x for x, kind in reversed(list(enumerate(kinds)))}
    fitted_once = sorted(first.values())
    found = fit_all([lambda j=jobs[x]: fit_one(_train(_task(rows, j[1])), j) for x in fitted_once], parallelism)
    by_job = dict(zip(fitted_once, found, strict=True))
    models = [by_job[first[kind]] for kind in kinds]
    wide = add_scores(_held_out(rows), {f"s{x}": m for x, m in by_job.items()})
    wide = stored(wide.select("split", "RUL_DAYS", *[f"s{x}" for x in fitted_once]))
    cells = [
        ({"task": n, "config_id": i, "days": d}, f"s{first[kind]}") for (n, d, i, _), kind in zip(jobs, kinds, strict=True)
    ]
    table = curves.tuned_evaluation(
        _long(wide, cells), ["task", "config_id"], _betas(betas, beta), metric=metric
    )
    params = F.lit(None).cast("string")
    for i, p in enumerate(configs):
        text = tuning.params_json({k: F.lit(v) for k, v in p.items() if v is not None})
        params = F.when(F.col("config_id") == i + 1, text).otherwise(params)
    table = table.withColumns({"params_json": params, "positives_train": _positives(rows, tasks)})
    fitted = {(n, i): m for (n, _, i, _), m in zip(jobs, models)}
    return tuning.flag_best(table), fitted


def tune_grid(
    log: DataFrame,
    days: Sequence[int] = (0, 7, 30),
    grid: Sequence[Mapping] = FOREST_GRID,
    metric: str = "fbeta",
    beta: float = DEFAULT_BETA,
    reduce_all: bool = True,
    parallelism: int = 4,
    seed: int = SEED,
) -> DataFrame:
    """Every forest configuration on every cumulative task, best one flagged."""
    tasks = make_tasks(days)
    rows, _ = encoded(
        horizon_table(log),
        PanelEncoder(CATEGORICAL, numeric_features(), reduce_all=reduce_all),
        ("ID", "DATE", "split", "RUL_DAYS"),
    )

    def one(train: DataFrame, job) -> Model:
        return fit(train, "rf", {"class_weight": "balanced_subsample", **job[3]}, seed=seed)

    table, _ = _evaluate_configs(rows, tasks, grid, one, metric, TASK_BETA, beta, parallelism)
    return table


def tune_random(
    log: DataFrame,
    tasks: Sequence[tuple[str, int]] = TASKS,
    space: Mapping[str, Sequence] = BOOSTED_SPACE,
    n_trials: int = N_TRIALS,
    metric: str = "pr_auc",
    beta: float = DEFAULT_BETA,
    auto_weight: bool = True,
    parallelism: int = 4,
    seed: int = SEED,
) -> DataFrame:
    """Random boosted configurations per task, positives weighted up, best one flagged."""
    if n_trials < 1:
        raise ValueError("n_trials must be at least 1")
    rows, _ = encoded(
        horizon_table(log),
        PanelEncoder(CATEGORICAL, numeric_features()),
        ("ID", "DATE", "split", "RUL_DAYS"),
    )
    drawn = tuning.sample_grid(log.sparkSession, space, n_trials, seed, replace=True)
    configs = [
        {k: v for k, v in r.asDict().items() if k != "config_id"} for r in drawn.orderBy("config_id").collect()
    ]

    def one(train: DataFrame, job) -> Model:
        p = dict(job[3])
        factor = p.pop("weight_factor", 1.0)
        if auto_weight:
            p["scale_pos_weight"] = weights.positive_weight(train, "label", factor)
        return fit(train, "xgb", p, seed=seed)

    table, _ = _evaluate_configs(rows, tasks, configs, one, metric, {}, beta, parallelism)
    return table


def tune_sequences(
    log: DataFrame,
    days: Sequence[int] = (0, 7, 30),
    grid: Sequence[Mapping] | None = None,
    length: int = SEQUENCE_LENGTH,
    metric: str = "pr_auc",
    beta: float = DEFAULT_BETA,
    stage_a_samples: int = STAGE_A_SAMPLES,
    stage_a_epochs: int = STAGE_A_EPOCHS,
    parallelism: int = 4,
    seed: int = SEED,
) -> tuple[DataFrame, dict[tuple[str, int], Model]]:
    """Sequence models on every task; ``grid=None`` screens random configurations."""
    tasks = make_tasks(days)
    if grid is None:
        drawn = tuning.sample_grid(log.sparkSession, SEQUENCE_SPACE, stage_a_samples, seed)
        grid = [
            {**{k: v for k, v in r.asDict().items() if k != "config_id"}, "epochs": stage_a_epochs}
            for r in drawn.collect()
        ]
    vectors, _ = encoded(
        horizon_table(log),
        PanelEncoder(CATEGORICAL, numeric_features(), reduce_all=True),
        ("ID", "DATE", "split", "RUL_DAYS"),
    )
    # All configurations share the responses; held-out rows are scored by the stored ones.
    rows, kernels = sequence_responses(vectors, grid, length, seed=seed)

    def one(train: DataFrame, job) -> Model:
        return fit_responses(train, job[3])

    table, fitted = _evaluate_configs(
        rows, tasks, grid, one, metric, SEQUENCE_TASK_BETA, beta, parallelism, effective=sequence_settings
    )
    return table, {job: on_sequences(kernels, m) for job, m in fitted.items()}


# --- same-day failure with resampling ----------------------------------------------------------


def run_resampled_models(
    log: DataFrame,
    models: Mapping[str, tuple[str, Mapping]] = RESAMPLED_MODELS,
    pca_variance: float = 0.95,
    k: int = 5,
    seed: int = SEED,
) -> DataFrame:
    """Oversampled train rows, principal components, several models; best val F1 flagged."""
    require_columns(log)
    # Many passes read the split; rows are hashed for it once.
    df = stored(log.withColumn("_hash", row_hash(KEYS, seed))).withColumn("label", F.col("EQUIPMENT_FAILURE"))
    df = splits.stratified_split(df, "label", seed=seed, hashed="_hash")
    numeric = ["AGE_OF_EQUIPMENT", *[s for s in SENSORS if s != "S5"]]
    rows, _ = encoded(df, PanelEncoder([*CATEGORICAL, "WELL_GROUP"], numeric), ("ID", "DATE", "split", "label"))
    real = stored(_train(rows))
    more = stored(smote(real, "label", "features", k, seed))
    pca = fit_pca(more, "features", "reduced", pca_variance)

    def reduced(data: DataFrame) -> DataFrame:
        return pca.transform(data).drop("features").withColumnRenamed("reduced", "features")

    train = stored(reduced(more).select("label", "features"))
    names = list(models)
    fitted = fit_all([lambda n=n: fit(train, models[n][0], models[n][1], seed=seed) for n in names], 4)
    wide = reduced(_held_out(rows))
    for i, n in enumerate(names):
        if models[n][0] == "svm":

            def on_part(part: DataFrame, n: str = n) -> Model:
                enlarged = reduced(smote(part, "label", "features", k, seed)).select("label", "features")
                return fit(stored(enlarged), models[n][0], models[n][1], seed=seed)

            # New rows are made of a part's own rows only, and only real rows are scored.
            slope, offset = cross_fitted_sigmoid(real, on_part, prepare=reduced, balanced=True, seed=seed)
            wide = add_score(wide, fitted[i], "margin", "margin")
            wide = wide.withColumn(f"s{i}", sigmoid(F.col("margin"), slope, offset)).drop("margin")
        else:
            wide = add_score(wide, fitted[i], f"s{i}")
    wide = stored(wide.select("split", "label", *[f"s{i}" for i in range(len(names))]))
    cells = [({"model": n, "config_id": i + 1, "task": "FAILURE_DAY"}, f"s{i}") for i, n in enumerate(names)]
    table = metrics.binary_metrics(_long(wide, cells), 0.5, ["task", "model", "config_id", "split"], 1.0)
    order = F.struct(-F.col("f1"), F.col("config_id"))
    best = F.min(F.when(F.col("split") == "val", order)).over(Window.partitionBy("task"))
    # Two rows per model.
    return table.withColumn("_best", best).withColumn(
        "best_model", F.col("config_id") == F.col("_best.config_id")
    ).drop("_best", "fbeta")


def new_run_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
