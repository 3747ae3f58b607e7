"""Threshold, regression and multiclass metrics; each is one partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failcast.functions.columns import f_score, ratio
from failcast.functions.order import running_totals
from failcast.operators.curves import _average_precision, _roc_area, sweep
from failcast.schema import HORIZON_CLASSES, PRIORITY_WEIGHTS

# Combination metrics by name, day bands of the error report.
COMBINATION_METRICS = ("priority_weighted_f1", "macro_f1", "weighted_f1", "macro_recall", "accuracy")
RUL_BANDS = (30, 14, 7)


def _count(condition: Column) -> Column:
    return F.count_if(condition)


# --- binary ---------------------------------------------------------------


def binary_confusion(
    scored: DataFrame, threshold: Column | float, by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """tp, fp, fn, tn of ``score >= threshold``."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    return scored.groupBy(*by).agg(
        _count(true & hit).alias("tp"),
        _count(~true & hit).alias("fp"),
        _count(true & ~hit).alias("fn"),
        _count(~true & ~hit).alias("tn"),
    )


def _binary_columns(beta: Column | float) -> list[Column]:
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return [
        p.alias("precision"),
        r.alias("recall"),
        f_score(p, r).alias("f1"),
        f_score(p, r, beta).alias("fbeta"),
        ratio(F.col("tp") + F.col("fp"), rows).alias("alert_rate"),
    ]


def threshold_metrics(
    scored: DataFrame, threshold: Column | float, by: Sequence[str] = (), beta: Column | float = 2.0, **names
) -> DataFrame:
    """Precision, recall, F1, F-beta and alert rate at a threshold."""
    return binary_confusion(scored, threshold, by, **names).select(*by, *_binary_columns(beta))


def binary_metrics(
    scored: DataFrame, threshold: Column | float, by: Sequence[str] = (), beta: Column | float = 2.0, **names
) -> DataFrame:
    """Threshold metrics together with average precision and ROC area, in one sweep."""
    points = sweep(scored, by, **names)
    hit = F.col("score") >= threshold
    neg = F.col("n") - F.col("pos")
    counted = points.groupBy(*by).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(neg)).alias("tn"),
        _average_precision().alias("pr_auc"),
        _roc_area().alias("roc_auc"),
    )
    return counted.select(*by, *_binary_columns(beta), "pr_auc", "roc_auc")


def predictability(results: DataFrame, base_rate: str) -> DataFrame:
    """Verdict: better than chance in ROC area and average precision."""
    yes = (F.col("roc_auc") > 0.60) & (F.col("pr_auc") > F.col(base_rate))
    return results.withColumn("predictable", F.coalesce(yes, F.lit(False)))


def precision_gain(results: DataFrame, model: str, baseline: str, name: str = "model") -> DataFrame:
    """Precision of ``model`` and ``baseline`` rows and their difference."""
    picked = results.agg(
        F.max(F.when(F.col(name) == baseline, F.col("precision"))).alias("baseline_precision"),
        F.max(F.when(F.col(name) == model, F.col("precision"))).alias("model_precision"),
    )
    gain = F.col("model_precision") - F.col("baseline_precision")
    return picked.withColumn("gain", gain).withColumn("improved", gain > 0)


# --- remaining useful life --------------------------------------------------


def _errors(condition: Column | None, truth: str, pred: str) -> list[Column]:
    gap = F.col(truth) - F.col(pred)
    gap = gap if condition is None else F.when(condition, gap)
    return [F.count(gap), F.avg(F.abs(gap)), F.sqrt(F.avg(gap * gap))]


def rul_error(preds: DataFrame, by: Sequence[str] = (), truth: str = "RUL_DAYS", pred: str = "RUL_PRED") -> DataFrame:
    n, mae, rmse = _errors(None, truth, pred)
    return preds.groupBy(*by).agg(n.alias("n"), mae.alias("mae"), rmse.alias("rmse"))


def rul_error_bands(
    preds: DataFrame, bands: Sequence[int] = RUL_BANDS, truth: str = "RUL_DAYS", pred: str = "RUL_PRED"
) -> DataFrame:
    """Errors restricted to true RUL within each band; all bands in one pass."""
    sums = []
    for h in bands:
        n, mae, rmse = _errors(F.col(truth) <= h, truth, pred)
        sums.append(F.struct(F.lit(h).alias("band"), n.alias("n"), mae.alias("mae"), rmse.alias("rmse")))
    rows = preds.agg(F.array(*sums).alias("bands"))
    return rows.select(F.inline("bands")).filter(F.col("n") > 0)


def event_metrics(
    preds: DataFrame, horizons: Sequence[int] = RUL_BANDS, truth: str = "RUL_DAYS", pred: str = "RUL_PRED"
) -> DataFrame:
    """Failure-within-horizon metrics of RUL predictions, a lower RUL ranking higher.

    All horizons share one table of distinct predictions; rows are not repeated.
    """
    true = {h: f"pos_{h}" for h in horizons}
    counts = preds.groupBy(F.col(pred).cast("double").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(truth) <= h).alias(c) for h, c in true.items()]
    )
    run = running_totals(counts, "pred", ["n", *true.values()])
    cells = []
    for h, c in true.items():
        hit = F.col("pred") <= h
        share = F.col(c) / F.col(f"all_{c}") * (F.col(f"run_{c}") / F.col("run_n"))
        positives, total = F.max(f"all_{c}"), F.max("all_n")
        cells.append(
            F.struct(
                F.lit(h).alias("horizon"),
                F.sum(F.when(hit, F.col(c)).otherwise(0)).alias("tp"),
                F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("pred_pos"),
                positives.alias("support_pos"),
                F.when(
                    (positives > 0) & (positives < total),
                    F.sum(F.when(F.col(f"all_{c}") > 0, share)),
                ).alias("pr_auc"),
            )
        )
    rows = run.agg(F.array(*cells).alias("h")).select(F.inline("h"))
    p, r = ratio(F.col("tp"), F.col("pred_pos")), ratio(F.col("tp"), F.col("support_pos"))
    return rows.select(
        "horizon",
        p.alias("precision"),
        r.alias("recall"),
        f_score(p, r).alias("f1"),
        "pr_auc",
        "support_pos",
        "pred_pos",
    )


# --- four horizon classes ----------------------------------------------------

_K = len(HORIZON_CLASSES)


def _cell(t: int, p: int) -> str:
    return f"_n{t}{p}"


def _confusion(preds: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    """One row per group with all class pairs counted: no join with a label grid."""
    return preds.groupBy(*by).agg(
        *[
            _count((F.col(truth) == t) & (F.col(pred) == p)).alias(_cell(t, p))
            for t in range(_K)
            for p in range(_K)
        ]
    )


def _plus(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


class _Classes:
    """Per-class expressions over the cells of one confusion row."""

    def __init__(self) -> None:
        cell = {(t, p): F.col(_cell(t, p)) for t in range(_K) for p in range(_K)}
        self.tp = [cell[c, c] for c in range(_K)]
        self.support = [_plus([cell[c, p] for p in range(_K)]) for c in range(_K)]
        self.predicted = [_plus([cell[t, c] for t in range(_K)]) for c in range(_K)]
        self.rows = _plus(self.support)
        self.precision = [ratio(self.tp[c], self.predicted[c]) for c in range(_K)]
        self.recall = [ratio(self.tp[c], self.support[c]) for c in range(_K)]
        # 2tp / (support + predicted) equals the harmonic mean and needs no rounding guard.
        self.f1 = [ratio(2 * self.tp[c], self.support[c] + self.predicted[c]) for c in range(_K)]
        self.accuracy = ratio(_plus(self.tp), self.rows)

    def macro(self, values: Sequence[Column]) -> Column:
        """Mean over the classes seen in truth or prediction."""
        seen = [F.when(self.support[c] + self.predicted[c] > 0, 1).otherwise(0) for c in range(_K)]
        return ratio(_plus([values[c] * seen[c] for c in range(_K)]), _plus(seen))

    def weighted(self, values: Sequence[Column]) -> Column:
        return ratio(_plus([values[c] * self.support[c] for c in range(_K)]), self.rows)

    def score(self, metric: str, weights: Sequence[float] = PRIORITY_WEIGHTS) -> Column:
        if metric == "priority_weighted_f1":
            return _plus([F.lit(weights[c]) * self.f1[c] for c in range(_K)])
        if metric == "macro_f1":
            return self.macro(self.f1)
        if metric == "weighted_f1":
            return self.weighted(self.f1)
        if metric == "macro_recall":
            return self.macro(self.recall)
        if metric == "accuracy":
            return self.accuracy
        raise ValueError(f"Unsupported combination score metric: {metric}")


def confusion_matrix(
    preds: DataFrame, by: Sequence[str] = (), truth: str = "true_class", pred: str = "pred_class"
) -> DataFrame:
    """All class pairs with count, share of the true class and share of all rows."""
    k = _Classes()
    cells = [
        F.struct(
            F.lit(t).alias("true_class"),
            F.lit(p).alias("pred_class"),
            F.col(_cell(t, p)).alias("n"),
            ratio(F.col(_cell(t, p)), k.support[t]).alias("share_of_true"),
            ratio(F.col(_cell(t, p)), k.rows).alias("share_of_all"),
        )
        for t in range(_K)
        for p in range(_K)
    ]
    return _confusion(preds, by, truth, pred).select(*by, F.inline(F.array(*cells)))


def class_report(
    preds: DataFrame, by: Sequence[str] = (), truth: str = "true_class", pred: str = "pred_class"
) -> DataFrame:
    """Precision, recall, F1 and support per class, then the averages over all four."""
    k = _Classes()

    def line(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("support")
        )

    lines = [line(n, k.precision[c], k.recall[c], k.f1[c], k.support[c]) for c, n in enumerate(HORIZON_CLASSES)]

    def mean(values: Sequence[Column]) -> Column:
        return _plus(values) / _K

    lines.append(line("accuracy", k.accuracy, k.accuracy, k.accuracy, k.rows))
    lines.append(line("macro avg", mean(k.precision), mean(k.recall), mean(k.f1), k.rows))
    lines.append(
        line("weighted avg", k.weighted(k.precision), k.weighted(k.recall), k.weighted(k.f1), k.rows)
    )
    return _confusion(preds, by, truth, pred).select(*by, F.inline(F.array(*lines)))


def multiclass_metrics(
    preds: DataFrame, by: Sequence[str] = (), truth: str = "true_class", pred: str = "pred_class"
) -> DataFrame:
    """Accuracy, macro and weighted averages, and recall over the three near classes."""
    k = _Classes()
    return _confusion(preds, by, truth, pred).select(
        *by,
        k.accuracy.alias("accuracy"),
        k.macro(k.precision).alias("macro_precision"),
        k.macro(k.recall).alias("macro_recall"),
        k.macro(k.f1).alias("macro_f1"),
        k.weighted(k.f1).alias("weighted_f1"),
        (_plus(k.recall[:3]) / 3).alias("close_recall_macro"),
    )


def combined_score(
    preds: DataFrame,
    metric: str = "priority_weighted_f1",
    by: Sequence[str] = (),
    truth: str = "true_class",
    pred: str = "pred_class",
    weights: Sequence[float] = PRIORITY_WEIGHTS,
) -> DataFrame:
    value = _Classes().score(metric, weights)
    return _confusion(preds, by, truth, pred).select(*by, F.lit(metric).alias("metric"), value.alias("score"))


# --- profiles -----------------------------------------------------------------


def class_distribution(
    df: DataFrame, column: str, by: Sequence[str] = (), names: Sequence[str] = HORIZON_CLASSES
) -> DataFrame:
    """Count and share of every class, classes without rows included."""
    counts = [F.count_if(F.col(column) == c) for c in range(len(names))]
    total = F.count(F.lit(1))
    cells = [
        F.struct(
            F.lit(c).alias("class"), F.lit(n).alias("name"), counts[c].alias("n"), (counts[c] / total).alias("share")
        )
        for c, n in enumerate(names)
    ]
    return df.groupBy(*by).agg(F.array(*cells).alias("c")).select(*by, F.inline("c"))


def label_profile(df: DataFrame, label: str, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows, positives and positive rate per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("long")).alias("positives"),
        F.avg(label).alias("positive_rate"),
    )


def data_profile(df: DataFrame, label: str, rul: str) -> DataFrame:
    """Rows, distinct machines, RUL range and positive rate of a labelled log."""
    # Per machine first: the distinct count is then a plain count.
    per_id = df.groupBy("ID").agg(
        F.count(F.lit(1)).alias("n"), F.min(rul).alias("lo"), F.max(rul).alias("hi"), F.sum(label).alias("p")
    )
    return per_id.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_ids"),
        F.min("lo").alias("min_rul"),
        F.max("hi").alias("max_rul"),
        (F.sum("p") / F.sum("n")).alias("positive_rate"),
    )


def segment_failure_rate(df: DataFrame, attributes: Sequence[str], label: str) -> DataFrame:
    """Failure likelihood by each value of each attribute, in one pass."""
    cells = F.array(
        *[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]
    )
    rows = df.select(F.col(label).alias("_y"), F.inline(cells))
    return rows.groupBy("attribute", F.coalesce("value", F.lit("unknown")).alias("value")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_y").cast("long")).alias("positives"),
        F.avg("_y").alias("rate"),
    )
