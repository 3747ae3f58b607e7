"""Bags of trees, kernel features with cross-fitted sigmoids, and order-aware sequence features."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from failcast.operators import bagging, curves, kernel, models, sequences
from failcast.plans import experiments as x


def table(spark, points, labels):
    rows = [(i, int(c), [float(v) for v in p]) for i, (p, c) in enumerate(zip(points, labels, strict=True))]
    df = spark.createDataFrame(rows, "ID long, label int, a array<double>")
    return df.select("ID", F.lit("2020-01-01").cast("date").alias("DATE"), "label", array_to_vector("a").alias("features")).repartition(4)


def area(df, model):
    return curves.ranking_metrics(models.add_score(df, model)).first()["roc_auc"]


def poisson(u):
    """Poisson number of mean 1 for a number of 20 bits."""
    count, share, term = 0, 0.0, np.exp(-1)
    for k in range(20):
        share += term
        term /= k + 1
        count += u >= round(share * 2**20) and round(share * 2**20) < 2**20
    return count


def drawn(row, tree, seed):
    digest = hashlib.md5(f"{seed * 1_000_003 + tree // 3}|{row}|2020-01-01".encode()).hexdigest()
    return poisson(int(digest[:15], 16) >> 20 * (tree % 3) & 0xFFFFF)


def test_bags_equal_brute_force(spark):
    labels = [int(i % 7 == 0) for i in range(400)]
    df = table(spark, np.zeros((400, 1)), labels)
    sizes = bagging.bag_sizes(df, "label", 7, seed=5)
    total = 0
    for tree in range(7):
        want = {i: drawn(i, tree, 5) for i in range(400)}
        total += sum(want.values())
        own = [sum(n for i, n in want.items() if labels[i] == c) for c in (0, 1)]
        assert [sizes[tree, c] for c in (0, 1)] == own
        for parts in (1, 9):
            rows = bagging.bag_weights(df.repartition(parts), "label", tree, sizes, seed=5).collect()
            assert {r.ID for r in rows} == {i for i, n in want.items() if n}
            assert all(r.weight == pytest.approx(want[r.ID] * sum(own) / (2 * own[r.label])) for r in rows)
    assert 0.9 < total / 2800 < 1.1


def test_counts_of_all_bags_at_once(spark):
    df = spark.range(200).select(F.col("id").alias("ID"), F.lit("2020-01-01").alias("DATE"))
    each = F.array(*[bagging.bag_count(t).cast("byte") for t in range(7)])
    found = df.select(bagging.bag_counts(7).alias("all"), each.alias("each")).collect()
    assert all(len(r["all"]) == 7 and r["all"] == r["each"] for r in found)


def test_forest_of_bags(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(600, 4))
    labels = (points[:, 1] + 0.3 * rng.normal(size=600) > 1.6).astype(int)
    df = table(spark, points, labels)
    model = models.fit(df, "rf", {"n_estimators": 9, "max_depth": 4, "class_weight": "balanced_subsample"})
    assert model.getNumTrees == 9 and area(df, model) > 0.9
    # The same trees from any partitioning, and different trees.
    again = models.fit(df.repartition(11), "rf", {"n_estimators": 9, "max_depth": 4, "class_weight": "balanced_subsample"})
    assert [t.toDebugString.split("\n", 1)[1] for t in model.trees] == [t.toDebugString.split("\n", 1)[1] for t in again.trees]
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) == 9
    plain = models.fit(df.select("label", "features"), "rf", {"n_estimators": 3, "max_depth": 3, "class_weight": "balanced_subsample"})
    assert area(df, plain) > 0.8


def test_bag_without_a_class(spark, tmp_path):
    df = table(spark, np.arange(40.0)[:, None], [int(i == 39) for i in range(40)])
    model = models.fit(df, "rf", {"n_estimators": 12, "max_depth": 2, "class_weight": "balanced_subsample"})
    assert model.numClasses == 2 and {t.numClasses for t in model.trees} == {2}
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    a, b = ([r.score for r in models.add_score(df, m).orderBy("ID").collect()] for m in (model, again))
    assert a == b and max(a) == a[39]


def rings(rng, n, noise=0.1):
    labels = rng.integers(0, 2, n)
    radius, angle = 1 + labels + noise * rng.normal(size=n), rng.uniform(0, 2 * np.pi, n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), labels


def test_rings_need_the_radial_kernel(spark):
    rng = np.random.default_rng(2)
    train, test = (table(spark, *rings(rng, n)) for n in (800, 400))
    scores = {}
    for name in ("rbf", "linear"):
        model = models.fit(train, "svm", {"kernel": name, "components": 128, "max_iter": 50})
        scored = models.add_score(test, model, "score", "margin")
        assert scored.columns == [*test.columns, "score"]
        scores[name] = curves.ranking_metrics(scored).first()["roc_auc"]
    assert scores["rbf"] > 0.98 and scores["linear"] < 0.7


def test_products_come_near_the_kernel(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(30, 5))
    df = spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(points)], ["i", "v"])
    assert kernel.scaled_gamma(df, "v") == pytest.approx(1 / (5 * points.var()))
    made = kernel.FourierFeatures("v", "z", 5, 4096, 0.2).transform(df).orderBy("i")
    z = np.stack([r.z.toArray() for r in made.collect()])
    want = np.exp(-0.2 * ((points[:, None] - points[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.12


def log_loss(df, slope, offset):
    p = models.sigmoid(F.col("margin"), slope, offset)
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    return df.agg(F.avg(F.when(loss > 50, 50.0).otherwise(loss))).first()[0]


def test_sigmoid_of_other_folds_is_better_calibrated(spark):
    """Labels with much noise: margins of fitted rows are surer than those of new rows."""
    rng = np.random.default_rng(4)

    def noisy(n):
        points = rng.normal(size=(n, 8))
        return table(spark, points, (points[:, 0] + 1.5 * rng.normal(size=n) > 0).astype(int))

    train, test = noisy(300), noisy(1500)
    settings = {"components": 400, "max_iter": 60, "C": 30.0, "gamma": 0.3}
    model = models.fit(train, "svm", settings)
    in_sample = models.fit_sigmoid(models.add_score(train, model, "margin", "margin"))
    crossed = models.cross_fitted_sigmoid(train, lambda part: models.fit(part, "svm", settings))
    held_out = models.add_score(test, model, "margin", "margin")
    assert log_loss(held_out, *crossed) < log_loss(held_out, *in_sample) - 0.02


def test_folds_are_not_seen_by_their_models(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(90, 2))
    df = table(spark, points, (points[:, 0] > 0).astype(int))
    seen, scored = [], []

    def fit_part(part):
        seen.append({r.ID for r in part.collect()})
        return models.fit(part, "svm", {"kernel": "linear", "max_iter": 5})

    def prepare(held):
        scored.append({r.ID for r in held.collect()})
        return held

    models.cross_fitted_sigmoid(df, fit_part, prepare=prepare, balanced=True, parallelism=1)
    assert len(seen) == len(scored) == 3 and not any(a & b for a, b in zip(seen, scored, strict=True))
    assert set().union(*scored) == set(range(90)) and sum(map(len, scored)) == 90


def shapes(rng, n, steps=60, width=3):
    """Noise with an up and a down at a random place of one channel: only their order tells the classes apart."""
    data, labels = rng.normal(size=(n, steps, width)) * 0.5, rng.integers(0, 2, n)
    for i, c in enumerate(labels):
        at = rng.integers(0, steps - 4)
        data[i, at : at + 4, 1] += np.array([1.5, 1.5, -1.5, -1.5]) * (1 if c else -1)
    return data.reshape(n, -1), labels


def test_a_shape_at_a_random_place_is_found(spark, tmp_path):
    rng = np.random.default_rng(6)
    train, test = (table(spark, *shapes(rng, n)) for n in (400, 400))
    model = models.fit_sequence_model(train, {"lstm_units": 200, "epochs": 50}, length=60)
    dense = models.fit_dense_sequence(train, {"dense_units": 16, "epochs": 60})
    assert area(test, model) > 0.9 and area(test, dense) < 0.8
    model.write().overwrite().save(str(tmp_path / "m"))
    assert area(test, PipelineModel.load(str(tmp_path / "m"))) == pytest.approx(area(test, model))


def test_configurations_share_responses(spark):
    rng = np.random.default_rng(8)
    days = [(m, t, "train", Vectors.dense(rng.normal(size=3)), int(rng.integers(2))) for m in range(9) for t in range(12)]
    vectors = spark.createDataFrame(days, ["ID", "DATE", "split", "features", "label"])
    configs = [{"lstm_units": 4, "lstm_layers": 2, "epochs": 5}, {"lstm_units": 12, "lstm_layers": 2, "epochs": 5}]
    rows, kernels = models.sequence_responses(vectors, configs, 5)
    assert "features" not in rows.columns and len(rows.first()["responses"]) == 24
    flat = models.sequence_rows(vectors, 5)
    for c in configs:
        shared = models.fit_responses(rows, c)
        alone = models.fit_sequence_model(flat, c, length=5)
        found = {(r.ID, r.DATE): r.score for r in models.add_score(rows, shared).collect()}
        again = {(r.ID, r.DATE): r.score for r in models.add_score(flat, models.on_sequences(kernels, shared)).collect()}
        expected = {(r.ID, r.DATE): r.score for r in models.add_score(flat, alone).collect()}
        assert found.keys() == expected.keys() and len(found) == 9 * 8
        for k, v in expected.items():
            assert found[k] == pytest.approx(v, abs=1e-9) and again[k] == pytest.approx(v, abs=1e-9)


def test_responses_equal_a_loop(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(12, 11, 4))
    df = spark.createDataFrame(
        [(i, Vectors.dense(s.ravel()) if i % 2 else Vectors.sparse(44, list(range(44)), s.ravel())) for i, s in enumerate(data)], ["i", "v"]
    )
    stage = sequences.KernelFeatures("v", "f", 11, 4, 25, 3)
    found = np.stack([r.f.toArray() for r in stage.transform(df).orderBy("i").collect()])
    for k, kern in enumerate(stage.kernels()):
        taps = len(kern.weights)
        assert (taps - 1) * kern.gap < 11
        for i, s in enumerate(data):
            out = [
                kern.bias + sum(float(s[p + j * kern.gap, c]) * kern.weights[j, m] for j in range(taps) for m, c in enumerate(kern.channels))
                for p in range(11 - (taps - 1) * kern.gap)
            ]
            assert found[i, 2 * k] == pytest.approx(max(out)) and found[i, 2 * k + 1] == pytest.approx(np.mean(np.array(out) > 0))
    assert sequences.random_kernels(4, 1, 2)[0].weights.shape[0] == 1


def test_equal_settings_are_fitted_once(spark):
    """Configurations that differ in settings without effect share a fit; all have their row."""
    rng = np.random.default_rng(8)
    df = table(spark, rng.normal(size=(120, 3)), [0] * 120)
    df = df.withColumn("RUL_DAYS", (F.col("ID") % 40).cast("int"))
    df = df.withColumn("split", F.when(F.col("ID") < 60, "train").when(F.col("ID") < 90, "val").otherwise("test"))
    grid = [{"l2_reg": 0.1, "batch_size": b, "epochs": 3, "lstm_units": 4} for b in (16, 32, 64)] + [{"l2_reg": 0.2, "lstm_units": 4}]
    fits = []

    def one(train, job):
        fits.append((job[0], job[3]["l2_reg"]))
        return models.fit(train, "logreg", {"max_iter": 3})

    found, fitted = x._evaluate_configs(
        df, [("LE_7_DAYS", 7), ("LE_20_DAYS", 20)], grid, one, "pr_auc", {}, 1.0, 1, effective=models.sequence_settings
    )
    assert sorted(fits) == [("LE_20_DAYS", 0.1), ("LE_20_DAYS", 0.2), ("LE_7_DAYS", 0.1), ("LE_7_DAYS", 0.2)]
    rows = found.toPandas()
    assert len(rows) == 8 and len(fitted) == 8
    same = rows[rows["config_id"] < 4].groupby("task")["val_metric"].nunique()
    assert isinstance(same, pd.Series) and (same == 1).all()
