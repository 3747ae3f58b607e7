"""Ranking curves, areas under them, and thresholds, for any number of models.

``scored`` tables hold one row per scored row and model: the columns of ``by``,
``label`` (0/1) and ``score``. They are counted per distinct score before the
only shuffle, then ``running_totals`` walks the scores downwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failcast.functions.columns import f_score, ratio
from failcast.functions.order import running_totals

_EPS = 1e-12


def score_counts(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """Rows and positives per distinct score."""
    return scored.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )


def sweep(
    scored: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
    ranges: int | None = None,
) -> DataFrame:
    """One row per distinct score: tp and hits (rows) at that threshold, and totals."""
    counts = score_counts(scored, by, label, score)
    run = running_totals(counts, "score", ["pos", "n"], by, descending=True, ranges=ranges)
    return run.select(
        *by,
        "score",
        "pos",
        "n",
        F.col("run_pos").alias("tp"),
        F.col("run_n").alias("hits"),
        F.col("all_pos").alias("positives"),
        F.col("all_n").alias("total"),
    )


def thinned(points: DataFrame, by: Sequence[str], epsilon: float) -> DataFrame:
    """Rows of a sweep that are enough to draw its curves within about ``epsilon``.

    Along a sweep the hits, the true and the false positives only grow. Points that agree in these, in steps of
    ``epsilon`` (shares of the rates, and logarithms, since precision is a ratio), are one stretch, of which the
    first and the last stay: within a stretch recall and false positive rate change by less than ``epsilon``,
    precision by less than a factor of exp(2 epsilon). There are at most some (2 + ln rows + ln positives) / epsilon
    stretches, whatever the number of scores. Points are found per stretch, not in one order over all.
    """
    negatives = F.col("total") - F.col("positives")
    misses = F.col("hits") - F.col("tp")
    steps = {
        "_hits": F.log("hits"),
        "_tp": F.log(F.greatest(F.col("tp").cast("double"), F.lit(0.5))),
        "_recall": F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0),
        "_fpr": F.when(negatives > 0, misses / negatives).otherwise(0.0),
    }
    placed = points.withColumns({name: F.floor(value / epsilon) for name, value in steps.items()})
    kept = [c for c in points.columns if c not in by]
    whole = F.struct(*kept)
    ends = placed.groupBy(*by, *steps).agg(F.min_by(whole, "hits").alias("a"), F.max_by(whole, "hits").alias("b"))
    both = F.when(F.col("a.hits") == F.col("b.hits"), F.array("a")).otherwise(F.array("a", "b"))
    return ends.select(*by, F.inline(both))


def _precision() -> Column:
    return F.col("tp") / F.col("hits")


def _recall() -> Column:
    # Without positives the recall counts as 1 everywhere.
    return F.when(F.col("positives") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("positives"))


def pr_curve(scored: DataFrame, by: Sequence[str] = (), epsilon: float = 0.0, **names) -> DataFrame:
    """Precision and recall per threshold, and the closing point (1, 0) without one; ``epsilon`` as in ``thinned``."""
    points = sweep(scored, by, **names)
    points = thinned(points, by, epsilon) if epsilon else points
    point = F.struct(
        F.col("score").alias("threshold"), _precision().alias("precision"), _recall().alias("recall")
    )
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    # The highest score is the row whose running count is its own count.
    both = F.when(F.col("hits") == F.col("n"), F.array(point, end)).otherwise(F.array(point))
    return points.select(*by, F.explode(both).alias("p")).select(*by, "p.*")


def roc_curve(scored: DataFrame, by: Sequence[str] = (), epsilon: float = 0.0, **names) -> DataFrame:
    """False and true positive rate per threshold, and the opening point (0, 0); ``epsilon`` as in ``thinned``."""
    points = sweep(scored, by, **names)
    points = thinned(points, by, epsilon) if epsilon else points
    negatives = F.col("total") - F.col("positives")
    fpr = F.when(negatives > 0, (F.col("hits") - F.col("tp")) / negatives)
    tpr = F.when(F.col("positives") > 0, F.col("tp") / F.col("positives"))
    point = F.struct(F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    start = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    both = F.when(F.col("hits") == F.col("n"), F.array(start, point)).otherwise(F.array(point))
    return points.select(*by, F.explode(both).alias("p")).select(*by, "p.*")


def _average_precision() -> Column:
    # Every group of equal scores adds its share of recall at its precision.
    step = F.col("pos") / F.col("positives") * _precision()
    return F.sum(F.when(F.col("positives") > 0, step).otherwise(0.0))


def _roc_area() -> Column:
    # A negative counts the positives above it, and half of those at its score.
    fp = F.col("n") - F.col("pos")
    above = (F.col("tp") - F.col("pos")) + F.col("pos") / 2
    pairs = F.max(F.col("positives") * (F.col("total") - F.col("positives")))
    return F.when(pairs > 0, F.sum(above * fp) / pairs)


def ranking_metrics(scored: DataFrame, by: Sequence[str] = (), **names) -> DataFrame:
    """Average precision and ROC area per group; the latter is null for one class."""
    return sweep(scored, by, **names).groupBy(*by).agg(
        _average_precision().alias("pr_auc"), _roc_area().alias("roc_auc")
    )


def curve_f_score(beta: Column | float) -> Column:
    b2 = beta * beta
    p, r = _precision(), _recall()
    return (1 + b2) * p * r / ((b2 * p) + r + _EPS)


def curve_f1() -> Column:
    p, r = _precision(), _recall()
    return (2 * p * r) / (p + r + _EPS)


def _best_score(quality: Column) -> Column:
    """Score of the best quality, the lowest one on ties."""
    return F.min_by("score", F.struct(-quality, F.col("score")))


def beta_column(task: str, betas: dict[str, float], fallback: float) -> Column:
    """Beta of each task, with a fallback."""
    out = F.lit(float(fallback))
    for name, beta in betas.items():
        out = F.when(F.col(task) == name, F.lit(float(beta))).otherwise(out)
    return out


def tune_threshold(
    scored: DataFrame, by: Sequence[str] = (), beta: Column | float = 2.0, **names
) -> DataFrame:
    """Threshold that maximises F-beta per group, and that F-beta."""
    quality = curve_f_score(beta)
    return sweep(scored, by, **names).groupBy(*by).agg(
        _best_score(quality).alias("threshold"), F.max(quality).alias("best_fbeta")
    )


def tune_threshold_f1(scored: DataFrame, by: Sequence[str] = (), **names) -> DataFrame:
    """Threshold that maximises F1 per group, and that F1."""
    return sweep(scored, by, **names).groupBy(*by).agg(
        _best_score(curve_f1()).alias("threshold"), F.max(curve_f1()).alias("best_f1")
    )


def tuned_evaluation(
    scored: DataFrame,
    by: Sequence[str],
    beta: Column | float,
    split: str = "split",
    metric: str = "fbeta",
) -> DataFrame:
    """Tune on split ``val``, measure on split ``test``: one row per group.

    Both splits go through one sweep. The split is picked inside the aggregates,
    not by filters, so Spark runs the scoring and its shuffle once.
    """
    if metric not in ("pr_auc", "fbeta"):
        raise ValueError(f"Unsupported selection metric: {metric}")
    points = sweep(scored, [*by, split])
    on_val, on_test = F.col(split) == "val", F.col(split) == "test"
    quality = curve_f_score(beta)
    best = F.struct((-quality).alias("q"), F.col("score").alias("score"))
    some = F.col("positives") > 0
    area = F.col("pos") / F.col("positives") * _precision()
    above = (F.col("tp") - F.col("pos")) + F.col("pos") / 2
    tuned = points.groupBy(*by).agg(
        F.min(F.when(on_val, best)).alias("_best"),
        F.sum(F.when(on_val & some, area)).alias("_val_ap"),
        F.sum(F.when(on_test & some, area)).alias("_test_ap"),
        F.sum(F.when(on_test, above * (F.col("n") - F.col("pos")))).alias("_pairs"),
        F.max(F.when(on_val, F.col("positives"))).alias("positives_val"),
        F.max(F.when(on_test, F.col("positives"))).alias("positives_test"),
        F.max(F.when(on_test, F.col("total"))).alias("_total"),
    ).withColumn("threshold", F.coalesce(F.col("_best.score"), F.lit(0.5)))
    tuned = tuned.withColumn("val_pr_auc", F.coalesce(F.col("_val_ap"), F.lit(0.0)))
    # One threshold per group; the counted scores are those of the sweep's own shuffle.
    at = score_counts(scored, [*by, split]).join(F.broadcast(tuned), list(by))
    hit = F.col("score") >= F.col("threshold")
    facts = ("threshold", "val_pr_auc", "positives_val", "positives_test", "_total", "_test_ap", "_pairs")
    measured = at.groupBy(*by, *facts).agg(
        *[
            F.coalesce(F.sum(F.when(where & hit, F.col(c))), F.lit(0)).alias(f"_{w}_{c}")
            for w, where in (("val", on_val), ("test", on_test))
            for c in ("pos", "n")
        ]
    )

    def scores(w: str):
        tp, hits, positives = F.col(f"_{w}_pos"), F.col(f"_{w}_n"), F.col(f"positives_{w}")
        return ratio(tp, hits), ratio(tp, positives)

    p, r = scores("test")
    vp, vr = scores("val")
    both = F.col("positives_test") * (F.col("_total") - F.col("positives_test"))
    chosen = F.col("val_pr_auc") if metric == "pr_auc" else f_score(vp, vr, beta)
    return measured.select(
        *by,
        "threshold",
        chosen.alias("val_metric"),
        p.alias("precision"),
        r.alias("recall"),
        f_score(p, r).alias("f1"),
        f_score(p, r, beta).alias("fbeta"),
        F.coalesce("_test_ap", F.lit(0.0)).alias("pr_auc"),
        F.when(both > 0, F.col("_pairs") / both).alias("roc_auc"),
        (F.col("_test_n") / F.col("_total")).alias("alert_rate"),
        "positives_val",
        "positives_test",
    )
