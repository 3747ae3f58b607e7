"""Estimators by name, calibration, and scoring with many models in one pass."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.functions.columns import clip
from failcast.operators import curves
from failcast.operators.bagging import bag_counts, bag_sizes, bag_weights, joined_forest
from failcast.operators.features import sequence_windows
from failcast.operators.kernel import FourierFeatures, scaled_gamma
from failcast.operators.sequences import KernelFeatures
from failcast.operators.splits import stratified_split
from failcast.operators.weights import balanced_weights, positive_weight, weight_column
from failcast.operators.wide_forest import WIDE, fit_wide_forest
from failcast.schema import KEYS, SEED
from failcast.sources.storage import spread, stored

# Spark's trees stop at this depth; "no limit" means this.
MAX_DEPTH = 30

# Default settings of each model name.
PRESETS = {
    "logreg": {"C": 1.0, "max_iter": 15000, "class_weight": "balanced"},
    "rf": {"n_estimators": 500, "class_weight": "balanced"},
    "hgb": {"n_estimators": 350, "learning_rate": 0.06, "max_depth": 6, "min_child_weight": 35},
    "xgb": {
        "n_estimators": 350,
        "learning_rate": 0.05,
        "max_depth": 6,
        "subsample": 0.85,
        "colsample_bytree": 0.85,
    },
    "lgbm": {
        "n_estimators": 400,
        "learning_rate": 0.05,
        "max_depth": None,
        "subsample": 0.9,
        "colsample_bytree": 0.9,
    },
    "svm": {"max_iter": 100, "kernel": "rbf"},
}
CALIBRATED_CANDIDATES = ("logreg", "rf", "hgb", "xgb", "lgbm")
RUL_REGRESSOR = {
    "n_estimators": 800,
    "learning_rate": 0.05,
    "max_depth": 6,
    "subsample": 0.9,
    "colsample_bytree": 0.9,
}
# End of fixed values.
# Cosines that stand for the radial kernel.
KERNEL_FEATURES = 256
#: Models whose learners keep a number per row and feature.
TREES = ("rf", "hgb", "xgb", "lgbm")
MODEL_NAMES = (*PRESETS, "calibrated_best")


def _depth(value: int | None) -> int:
    return MAX_DEPTH if value is None else min(int(value), MAX_DEPTH)


def _forest(p: Mapping) -> dict:
    share = p.get("max_features", "sqrt")
    return {
        "numTrees": int(p.get("n_estimators", 100)),
        "maxDepth": _depth(p.get("max_depth")),
        "minInstancesPerNode": int(p.get("min_samples_leaf", 1)),
        "featureSubsetStrategy": share if isinstance(share, str) else str(float(share)),
    }


def _boosting(p: Mapping) -> dict:
    return {
        "maxIter": int(p.get("n_estimators", 100)),
        "stepSize": float(p.get("learning_rate", 0.1)),
        "maxDepth": _depth(p.get("max_depth", 6)),
        "subsamplingRate": float(p.get("subsample", 1.0)),
        "featureSubsetStrategy": str(float(p.get("colsample_bytree", 1.0))),
        "minInfoGain": float(p.get("gamma", 0.0)),
        "minInstancesPerNode": max(1, int(p.get("min_child_weight", 1))),
    }


def make_estimator(
    kind: str,
    params: Mapping | None = None,
    rows: int | None = None,
    features: str = "features",
    label: str = "label",
    weight: str | None = None,
    seed: int = SEED,
):
    """Spark estimator for a model name; ``params`` overrides the preset.

    ``rows`` turns the inverse penalty C into Spark's per-row penalty.
    """
    if kind not in PRESETS and kind not in ("logreg_multinomial", "gbt_regressor"):
        raise ValueError(f"Unsupported model type: {kind}")
    p = {**PRESETS.get(kind, {}), **(params or {})}
    common = {"featuresCol": features, "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if kind in ("logreg", "logreg_multinomial"):
        return LogisticRegression(
            maxIter=int(p.get("max_iter", 1000)),
            regParam=1.0 / (p.get("C", 1.0) * rows) if rows else 0.0,
            standardization=False,
            family="multinomial" if kind == "logreg_multinomial" else "binomial",
            **common,
        )
    if kind == "rf":
        return RandomForestClassifier(seed=seed, **_forest(p), **common)
    if kind == "svm":
        return LinearSVC(
            maxIter=int(p["max_iter"]), regParam=1.0 / (p.get("C", 1.0) * rows) if rows else 0.0, **common
        )
    if kind == "gbt_regressor":
        return GBTRegressor(seed=seed, **_boosting({**RUL_REGRESSOR, **p}), **common)
    return GBTClassifier(seed=seed, **_boosting(p), **common)


def class_weights_for(train: DataFrame, label: str, params: Mapping) -> dict[int, float]:
    """Weights asked for by ``class_weight`` or ``scale_pos_weight``; empty for none."""
    mode = params.get("class_weight")
    if isinstance(mode, Mapping):
        return dict(mode)
    if mode in ("balanced", "balanced_subsample"):
        return balanced_weights(train, label)
    if params.get("scale_pos_weight"):
        return {1: params["scale_pos_weight"]}
    return {}


def fit(train: DataFrame, kind: str, params: Mapping | None = None, label: str = "label", **options) -> Model:
    """Fit a model by name with the class weights its settings ask for.

    A forest with ``balanced_subsample`` weighs the rows of each tree's bag on its own. The margin classifier
    has the radial kernel, by random Fourier features, unless ``kernel`` is ``linear``. A forest on more than ``WIDE``
    features counts sparse rows.
    """
    p = {**PRESETS.get(kind, {}), **(params or {})}
    if kind == "rf" and p.get("class_weight") == "balanced_subsample":
        return fit_bagged_forest(train, p, label, **options)
    weights = class_weights_for(train, label, p)
    if kind == "rf" and _width(train) > WIDE:
        f = _forest(p)
        return fit_wide_forest(
            train, f["numTrees"], f["maxDepth"], f["minInstancesPerNode"], f["featureSubsetStrategy"], label, weights, **options
        )
    rows = train.count() if kind in ("logreg", "logreg_multinomial", "svm") else None
    data = train.select(label, "features")
    if kind in TREES:
        data = _spread(data)
    if weights:
        data = data.withColumn("weight", weight_column(label, weights))
    column = "features"
    before: list[Transformer] = []
    if kind == "svm" and p["kernel"] == "rbf":
        column = "fourier"
        gamma = p.get("gamma") or scaled_gamma(data, "features")
        width = len(data.select("features").first()[0])
        size = int(p.get("components", KERNEL_FEATURES))
        before = [FourierFeatures("features", column, width, size, gamma, options.get("seed", SEED))]
        data = before[0].transform(data).drop("features")
    model = make_estimator(
        kind, params, rows=rows, features=column, label=label, weight="weight" if weights else None, **options
    ).fit(data)
    return _with_own_features(before[0], model) if before else model


def _width(data: DataFrame) -> int:
    first = data.select("features").first()
    return len(first[0]) if first else 0


def _spread(data: DataFrame) -> DataFrame:
    """Rows dealt so that what a tree learner keeps of a partition does not grow with the table."""
    width = _width(data)
    return spread(data, width) if width else data


def _with_own_features(features: Transformer, model: Model) -> PipelineModel:
    """A model on features of its own, which it makes and drops."""
    name = features.getOrDefault("outputCol")
    return PipelineModel([features, model, SQLTransformer(statement=f"SELECT * EXCEPT ({name}) FROM __THIS__")])


def fit_bagged_forest(
    train: DataFrame, params: Mapping, label: str = "label", keys: Sequence[str] = KEYS, seed: int = SEED, parallelism: int = 4
) -> RandomForestClassificationModel:
    """Forest of trees on bags of their own, classes balanced within each bag.

    Bags are drawn by ``keys``; without these columns rows are told apart by their label and features.
    """
    if not set(keys) <= set(train.columns):
        train = train.withColumn("_row", F.xxhash64(label, vector_to_array("features")))
        keys = ["_row"]
    trees = int(params.get("n_estimators", 100))
    rows = stored(train.select(label, "features", bag_counts(trees, keys, seed).alias("_bags")))
    settings = {**_forest(params), "numTrees": 1, "bootstrap": False, "weightCol": "weight"}
    sizes = bag_sizes(rows, label, trees, counts="_bags")
    # A bag may lack a class that others have.
    classes = {"ml_attr": {"type": "nominal", "num_vals": int(max(c for _, c in sizes)) + 1}}

    def one(tree: int) -> Model:
        bag = bag_weights(rows, label, tree, sizes, counts="_bags").withMetadata(label, classes)
        estimator = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed + tree, **settings)
        return estimator.fit(bag.select(label, "features", "weight"))

    return joined_forest(fit_all([lambda t=t: one(t) for t in range(trees)], parallelism))


def fit_all(jobs: Sequence[Callable[[], Model]], parallelism: int = 4) -> list[Model]:
    """Run fits side by side; each is a distributed job of its own."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        # A thread that fits has no active session of its own.
        spark = SparkSession.builder.getOrCreate()
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs)


_OUTPUTS = ("rawPrediction", "probability", "prediction")


def add_score(df: DataFrame, model: Model, out: str = "score", kind: str = "probability") -> DataFrame:
    """Add the positive class's probability, the margin, or the prediction of a model."""
    if isinstance(model, CalibratedModel):
        return model.add_score(df, out)
    scored = model.transform(df)
    if kind == "prediction":
        value = F.col("prediction")
    elif kind == "margin":
        value = F.get(vector_to_array(F.col("rawPrediction")), F.lit(1))
    else:
        value = F.get(vector_to_array(F.col("probability")), F.lit(1))
    return scored.withColumn(out, value).drop(*_OUTPUTS)


def add_scores(df: DataFrame, models: Mapping[str, Model], kind: str = "probability") -> DataFrame:
    """One column per model, all in one pass over the rows."""
    for name, model in models.items():
        df = add_score(df, model, name, kind)
    return df


# --- calibration ------------------------------------------------------------


def platt_targets(scored: DataFrame, label: str) -> tuple[float, float]:
    """Softened targets of positive and negative rows."""
    row = scored.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return (row["p"] + 1.0) / (row["p"] + 2.0), 1.0 / (row["n"] + 2.0)


def fit_sigmoid(
    scored: DataFrame, label: str = "label", margin: str = "margin", weight: Column | None = None
) -> tuple[float, float]:
    """Slope and offset of the sigmoid that maps margins to probabilities.

    A soft target t is the pair of rows (1, weight t) and (0, weight 1 - t); ``weight`` multiplies both.
    """
    high, low = platt_targets(scored, label)
    t = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    each = F.lit(1.0) if weight is None else weight
    pair = F.array(
        F.struct(F.lit(1.0).alias("y"), (each * t).alias("w")), F.struct(F.lit(0.0).alias("y"), (each * (1 - t)).alias("w"))
    )
    rows = scored.select(array_to_vector(F.array(F.col(margin).cast("double"))).alias("x"), F.inline(pair))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=200).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def cross_fitted_sigmoid(
    train: DataFrame,
    fit_part: Callable[[DataFrame], Model],
    label: str = "label",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    balanced: bool = False,
    folds: int = 3,
    keys: Sequence[str] = KEYS,
    seed: int = SEED,
    parallelism: int = 3,
) -> tuple[float, float]:
    """Sigmoid of margins that no model gave to rows it was fitted on.

    ``fit_part`` gets the rows outside a fold, so whatever it makes of them (new rows, too) has not seen the fold; the
    fold's rows, changed by ``prepare``, are scored. ``balanced`` weighs both classes alike, for a
    model fitted on as many rows of each.
    """
    names = [str(i) for i in range(folds)]
    data = stored(stratified_split(train, label, [1 / folds] * folds, names, keys, seed, out="fold"))

    def one(name: str) -> DataFrame:
        model = fit_part(data.filter(F.col("fold") != name).drop("fold"))
        held = data.filter(F.col("fold") == name).drop("fold")
        return add_score(prepare(held) if prepare else held, model, "margin", "margin").select(label, "margin")

    scored = stored(functools.reduce(DataFrame.union, fit_all([lambda n=n: one(n) for n in names], parallelism)))
    weight = weight_column(label, balanced_weights(scored, label)) if balanced else None
    return fit_sigmoid(scored, label, weight=weight)


def sigmoid(margin: Column, slope: float, offset: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(margin * slope + offset)))


class CalibratedModel:
    """Mean of calibrated fold models."""

    def __init__(self, name: str, parts: Sequence[tuple[Model, float, float]]):
        self.name = name
        self.parts = list(parts)

    def add_score(self, df: DataFrame, out: str = "score") -> DataFrame:
        total = F.lit(0.0)
        spare = []
        for i, (model, slope, offset) in enumerate(self.parts):
            df = add_score(df, model, f"_margin{i}", "margin")
            spare.append(f"_margin{i}")
            total = total + sigmoid(F.col(f"_margin{i}"), slope, offset)
        return df.withColumn(out, total / len(self.parts)).drop(*spare)


def fit_calibrated(
    train: DataFrame,
    kind: str,
    params: Mapping | None = None,
    label: str = "label",
    folds: int = 3,
    keys: Sequence[str] = KEYS,
    seed: int = SEED,
    parallelism: int = 3,
) -> CalibratedModel:
    """Fit on all folds but one, calibrate on the one left out, for each fold.

    Folds keep the class shares exactly, so rare positives reach every fold.
    """
    names = [str(i) for i in range(folds)]
    data = stratified_split(train, label, [1 / folds] * folds, names, keys, seed, out="fold")

    def one(name: str):
        model = fit(data.filter(F.col("fold") != name), kind, params, label)
        held = add_score(data.filter(F.col("fold") == name), model, "margin", "margin")
        return (model, *fit_sigmoid(held, label))

    parts = fit_all([lambda n=n: one(n) for n in names], parallelism)
    return CalibratedModel(f"Calibrated({kind})", parts)


def fit_calibrated_best(
    rows: DataFrame,
    label: str = "label",
    candidates: Sequence[str] = CALIBRATED_CANDIDATES,
    params: Mapping[str, Mapping] | None = None,
    folds: int = 3,
    parallelism: int = 3,
) -> tuple[CalibratedModel, DataFrame]:
    """Best candidate by average precision on ``val``, calibrated on ``train``.

    Returns the model and the candidates' table; the first candidate wins ties.
    """
    if not candidates:
        raise ValueError("No candidates given")
    settings = params or {}
    train = rows.filter(F.col("split") == "train")
    models = fit_all([lambda c=c: fit(train, c, settings.get(c), label) for c in candidates], parallelism)
    val = rows.filter(F.col("split") == "val").select(label, "features")
    wide = add_scores(val, {f"m{i}": m for i, m in enumerate(models)})
    cells = F.array(*[F.struct(F.lit(i).alias("config_id"), F.col(f"m{i}").alias("score")) for i in range(len(models))])
    table = curves.ranking_metrics(
        wide.select(F.col(label).alias("label"), F.inline(cells)), ["config_id"]
    ).select("config_id", "pr_auc")
    best = table.agg(F.min_by("config_id", F.struct(-F.col("pr_auc"), "config_id"))).first()[0]
    kind = candidates[best]
    model = fit_calibrated(train, kind, settings.get(kind), label, folds, parallelism=parallelism)
    names = F.array(*[F.lit(c) for c in candidates])
    return model, table.withColumn("model", F.get(names, F.col("config_id")))


# --- remaining useful life, sequences ------------------------------------------


def fit_rul(train: DataFrame, params: Mapping | None = None, label: str = "RUL_DAYS") -> Model:
    return make_estimator("gbt_regressor", params, label=label).fit(_spread(train.select(label, "features")))


def add_rul(df: DataFrame, model: Model, out: str = "RUL_PRED") -> DataFrame:
    """Predicted days, never below 0."""
    return model.transform(df).withColumn(out, clip(F.col("prediction"), 0.0)).drop("prediction")


def sequence_rows(encoded: DataFrame, length: int, keys: Sequence[str] = ("ID", "split")) -> DataFrame:
    """Feature vectors of ``length`` successive rows of a machine as one vector."""
    rows = encoded.withColumn("features", vector_to_array("features"))
    seq = sequence_windows(rows, "features", length, keys)
    return seq.withColumn("features", array_to_vector(F.flatten("sequence"))).drop("sequence")


def balance_by_copies(df: DataFrame, label: str = "label") -> DataFrame:
    """Repeat positive rows until both classes weigh about the same."""
    times = max(1, round(positive_weight(df, label)))
    copies = F.when(F.col(label) == 1, F.lit(times)).otherwise(F.lit(1))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def fit_dense_sequence(train: DataFrame, params: Mapping, label: str = "label", seed: int = SEED) -> Model:
    """Dense network on flattened sequences; ``dense_units`` and ``epochs`` are used."""
    width = len(train.select("features").first()[0])
    return MultilayerPerceptronClassifier(
        layers=[width, int(params.get("dense_units", 16)), 2],
        maxIter=int(params.get("epochs", 120)),
        seed=seed,
        featuresCol="features",
        labelCol=label,
    ).fit(balance_by_copies(train.select(label, "features"), label))


def sequence_settings(params: Mapping) -> dict[str, float]:
    """What of a sequence configuration has an effect here: kernels, penalty and passes."""
    return {
        "kernels": int(params.get("lstm_units", 128)) * int(params.get("lstm_layers", 2)) // 2,
        "penalty": float(params.get("l2_reg", 0.0003)),
        "passes": int(params.get("epochs", 120)),
    }


def fit_sequence_model(
    train: DataFrame, params: Mapping, label: str = "label", length: int = 10, seed: int = SEED
) -> PipelineModel:
    """Logistic regression on responses to random kernels that slide over the steps of a sequence.

    ``train``: sequences of ``length`` steps, flattened. Only ``sequence_settings`` of ``params`` has an effect.
    """
    p = sequence_settings(params)
    width = len(train.select("features").first()[0]) // length
    features = KernelFeatures("features", "responses", length, width, p["kernels"], seed)
    # The fit reads its rows more than once; the kernels slide over them once.
    data = stored(features.transform(train.select(label, "features")).drop("features"))
    return _with_own_features(features, fit_responses(data, params, label))


def sequence_responses(
    vectors: DataFrame, configs: Sequence[Mapping], length: int = 10, keys: Sequence[str] = ("ID", "split"), seed: int = SEED
) -> tuple[DataFrame, KernelFeatures]:
    """``sequence_rows`` with responses to the kernels of all ``configs`` in place of ``features``, stored; the transformer.

    Kernels are drawn one after the other, so a configuration with fewer kernels has the first ones. The sequences
    themselves, ``length`` times as large as the vectors, are not stored.
    """
    width = len(vectors.select("features").first()[0])
    kernels = max(sequence_settings(p)["kernels"] for p in configs)
    features = KernelFeatures("features", "responses", length, width, kernels, seed)
    return stored(features.transform(sequence_rows(vectors, length, keys)).drop("features")), features


def fit_responses(train: DataFrame, params: Mapping, label: str = "label") -> Model:
    """The regression of ``fit_sequence_model`` on stored ``responses``; of more kernels than its own it takes the first."""
    p = sequence_settings(params)
    weights = balanced_weights(train, label)
    data = train.select(label, "responses").withColumn("weight", weight_column(label, weights))
    own = 2 * p["kernels"]
    first = None
    if len(train.select("responses").first()[0]) > own:
        first = VectorSlicer(inputCol="responses", outputCol="_first", indices=list(range(own)))
        data = first.transform(data).drop("responses")
    model = LogisticRegression(
        featuresCol="_first" if first else "responses",
        labelCol=label,
        weightCol="weight",
        regParam=p["penalty"],
        maxIter=p["passes"],
    ).fit(data)
    return _with_own_features(first, model) if first else model


def on_sequences(features: KernelFeatures, model: Model) -> PipelineModel:
    """A model on responses as a model on flattened sequences."""
    return _with_own_features(features, model)
