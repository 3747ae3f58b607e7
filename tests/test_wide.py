"""Preparation of wide data: components without a covariance, categories without a list on the driver."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from failcast.operators import bagging, components, dictionary, models, prep, wide_forest


def vectors(spark, points, sparse=False):
    make = (lambda p: Vectors.sparse(len(p), {int(i): float(p[i]) for i in np.flatnonzero(p)})) if sparse else Vectors.dense
    return spark.createDataFrame([(i, make(p)) for i, p in enumerate(points)], ["id", "v"]).repartition(7)


def dense_components(points, k):
    values, directions = np.linalg.eigh(np.cov(points.T))
    return values[::-1] / values.sum(), directions[:, ::-1][:, :k]


def apart(a, b):
    """Sine of the largest angle between two spaces."""
    return np.linalg.norm(a - b @ (b.T @ a), 2)


@pytest.mark.parametrize("narrow, sparse", [(96, False), (96, True), (4, False), (4, True)])
def test_components_equal_the_dense_result(spark, narrow, sparse):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(800, 70)) @ np.diag(0.8 ** np.arange(70)) @ rng.normal(size=(70, 70)) + 3
    points[:, 5:9] = 0
    points[::3, 20:60] = 0
    shares, want = dense_components(points, 70)
    found, mean, kept = components.principal_components(vectors(spark, points, sparse), "v", 0.95, narrow=narrow, first=4)
    k = components.components_for(shares, 0.95)
    assert found.shape == (70, k) and np.allclose(mean, points.mean(0))
    assert np.allclose(kept, shares[:k], rtol=1e-9)
    assert apart(found, want[:, :k]) < 1e-6
    assert np.allclose(found.T @ found, np.eye(k), atol=1e-9)


def test_mixed_and_zero_vectors(spark):
    rows = [Vectors.dense([1, 0, 2]), Vectors.sparse(3, {1: 4.0}), Vectors.sparse(3, {}), Vectors.dense([0, 0, 0])]
    df = spark.createDataFrame([(v,) for v in rows], ["v"]).coalesce(1)
    points = np.array([v.toArray() for v in rows])
    found, _, kept = components.principal_components(df, "v", 0.99)
    shares, want = dense_components(points, 2)
    assert np.allclose(kept, shares[: len(kept)]) and apart(found, want) < 1e-9
    same = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)] * 5, ["v"])
    found, mean, kept = components.principal_components(same, "v", 0.95)
    assert found.shape == (2, 1) and mean.tolist() == [1, 2] and kept.tolist() == [1]


def test_thirty_thousand_columns(spark):
    """Planted directions in wide sparse rows; no object grows with the square of the width."""
    width, n = 30_000, 3000
    rng = np.random.default_rng(2)
    groups = rng.integers(0, 12, n)
    rows = []
    for g in groups.tolist():
        entries = {g * 20 + j: 10.0 + g for j in range(20)}
        entries |= {int(i): 0.1 for i in rng.integers(1000, width, 10)}
        rows.append((Vectors.sparse(width, entries),))
    df = spark.createDataFrame(rows, ["v"]).repartition(8).persist()
    found, _, kept = components.principal_components(df, "v", 0.95)
    assert found.shape[0] == width and 8 <= found.shape[1] <= 12
    assert kept.sum() > 0.95 and (np.abs(found[240:]) < 0.01).all()
    with pytest.raises(ValueError, match="less variance"):
        components.principal_components(df, "v", 0.95, numbers=100_000)
    df.unpersist()


def test_projection_is_saved(spark, tmp_path):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(60, 5))
    df = vectors(spark, points)
    model = prep.fit_pca(df, "v", "p", 0.8)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = ({r.id: r.p.toArray() for r in m.transform(df).collect()} for m in (model, again))
    assert all(np.array_equal(a[i], b[i]) for i in a)
    center = points - points.mean(0)
    _, want = dense_components(points, len(a[0]))
    assert np.allclose(np.abs(np.stack([a[i] for i in range(60)])), np.abs(center @ want), atol=1e-9)


def categories(spark, n=200_000):
    """Every value once, and as many rows again of one value."""
    df = spark.range(n).select(F.concat(F.lit("c"), F.lpad(F.col("id"), 6, "0")).alias("c"))
    return df.union(spark.range(n // 2).select(F.lit("c000007").alias("c"))).repartition(8)


def test_two_hundred_thousand_values_do_not_collide(spark):
    df = categories(spark)
    model = prep.PanelEncoder(["c"], []).fit(df)
    found = model.transform(df).select("c", F.unwrap_udt("features").alias("v"))
    places = found.select("c", F.col("v.size").alias("size"), F.get("v.indices", F.lit(0)).alias("i")).distinct()
    row = places.agg(F.count("*").alias("n"), F.count_distinct("i").alias("i"), F.min("size").alias("s"), F.max("i").alias("m")).first()
    assert tuple(row) == (200_000, 200_000, 200_000, 199_999)
    # Numbers follow the order of the values.
    assert places.where(F.col("i") != F.substring("c", 2, 6).cast("int")).count() == 0
    odd = spark.createDataFrame([("unknown",), ("",), ("c000003",)], "c string")
    got = {r.c: (r.v.size, list(r.v.indices)) for r in model.transform(odd).select("c", F.unwrap_udt("features").alias("v")).collect()}
    assert got == {"unknown": (200_000, []), "": (200_000, []), "c000003": (200_000, [3])}


def test_dictionary_next_to_listed_columns(spark, tmp_path):
    rows = [("a", "x", 1.0), ("b", "y", 2.0), ("a", "z", None), (None, "x", 4.0), ("b", None, 5.0)]
    df = spark.createDataFrame(rows, "c string, d string, n double")
    listed = prep.PanelEncoder(["c", "d"], ["n"], index_limit=10).fit(df)
    looked_up = prep.PanelEncoder(["c", "d"], ["n"], index_limit=2).fit(df)
    new = spark.createDataFrame([*rows, ("q", "x", 0.0), ("a", "q", 0.0)], "c string, d string, n double")

    def result(model):
        return sorted(map(str, model.transform(new).select("c", "d", "n", vector_to_array("features")).collect()))

    assert result(listed) == result(looked_up)
    looked_up.write().overwrite().save(str(tmp_path / "m"))
    assert result(PipelineModel.load(str(tmp_path / "m"))) == result(listed)


def test_positions_keep_rows_and_columns(spark):
    """Hot, cold, unknown and null values, and columns named like the operator's own."""
    rows = [("h", i, "x") for i in range(900)] + [(f"v{i:03d}", i, "y") for i in range(300)] + [(None, 1, "n"), ("zz", 2, "u")]
    df = spark.createDataFrame(rows, "value string, _salt long, `a.b` string").repartition(4)
    counts = df.where("value is not null and value != 'zz'").groupBy("value").agg(F.count("*").alias("n"))
    known = dictionary.fit_dictionary(counts)
    got = dictionary.add_position(df, F.col("value"), known, "at")
    assert got.columns == ["value", "_salt", "a.b", "at"] and got.count() == len(rows)
    want = {v: i for i, v in enumerate(sorted({r[0] for r in rows} - {None, "zz"}))}
    assert all(r["at"] == want.get(r["value"]) for r in got.collect())
    assert dictionary.fit_dictionary(counts.limit(0)).count() == 0


def test_forest_on_wide_rows_equals_brute_force(spark, tmp_path):
    """Every split is the best of all features and limits; nodes hold the rows of the bag that come to them."""
    width, n = wide_forest.WIDE + 904, 400
    rng = np.random.default_rng(4)
    points = np.zeros((n, width))
    points[:, 0], points[:, 1] = rng.integers(-40, 40, n), rng.choice([0, 2.5], n)
    points[np.arange(n), rng.integers(3, 40, n) ** 2] = 1
    points[:, 2] = -3
    label = ((points[:, 0] > 11) ^ (points[:, 5:400].sum(1) > 0)).astype(int)
    as_vector = [Vectors.sparse(width, {int(i): float(p[i]) for i in np.flatnonzero(p)}) for p in points]
    as_vector[7] = Vectors.dense(points[7])
    rows = [(i, "d", int(y), v) for i, (y, v) in enumerate(zip(label, as_vector, strict=True))]
    df = spark.createDataFrame(rows, ["ID", "DATE", "label", "features"]).repartition(4)
    trees, depth, least, factor = 3, 4, 5, np.array([1.0, 2.0])
    settings = {"n_estimators": trees, "max_depth": depth, "min_samples_leaf": least, "max_features": 1.0, "class_weight": {1: 2.0}}
    model = models.fit(df, "rf", settings)
    assert isinstance(model, wide_forest.WideForestModel)
    feature, limit, left, right = (model.getOrDefault(p) for p in (model.feature, model.limit, model.left, model.right))
    votes = np.array(model.getOrDefault(model.votes)).reshape(-1, 2)
    bags = {r["ID"]: r["b"] for r in df.select("ID", bagging.bag_counts(trees).alias("b")).collect()}
    starts, limits = wide_forest._bounds(df, width)
    assert starts[3] - starts[2] == 0 and starts[2] - starts[1] == 1 and limits[starts[1]] == 1.25
    assert 20 <= starts[1] - starts[0] <= 31

    def gini(y, w):
        c = np.bincount(y, w, 2) * factor
        return c.sum() * (1 - ((c / c.sum()) ** 2).sum()) if c.sum() else 0.0

    scores = np.zeros(n)

    def check(node, some, w, tree, level):
        y, whole = label[some], gini(label[some], w[some])
        shares = np.bincount(y, w[some], 2) * factor
        assert np.allclose(votes[node], shares / shares.sum())
        gains = {}
        for f in [0, 1, 2, *range(9, 1600)]:
            for t in limits[starts[f] : starts[f + 1]]:
                go = points[some, f] <= t
                if min(w[some][go].sum(), w[some][~go].sum()) >= least:
                    gains[f, t] = whole - gini(y[go], w[some][go]) - gini(y[~go], w[some][~go])
        best = max(gains.values(), default=0.0)
        if left[node] == node:
            assert level == depth or best <= 1e-9
            return
        assert gains[feature[node], limit[node]] == pytest.approx(best)
        go = points[some, feature[node]] <= limit[node]
        check(left[node], some[go], w, tree, level + 1)
        check(right[node], some[~go], w, tree, level + 1)

    for t in range(trees):
        w = np.array([bags[i][t] for i in range(n)], float)
        check(t, np.flatnonzero(w), w, t, 0)
        at = np.full(n, t)
        for _ in range(depth):
            at = np.where(points[np.arange(n), np.array(feature)[at]] <= np.array(limit)[at], np.array(left)[at], np.array(right)[at])
        scores += votes[at, 1] / trees
    model.write().overwrite().save(f"{tmp_path}/m")
    for m in (model, wide_forest.WideForestModel.load(f"{tmp_path}/m")):
        got = {r["ID"]: r["score"] for r in models.add_score(df, m).collect()}
        assert np.allclose([got[i] for i in range(n)], scores)
    classes = models.add_score(df, model, "c", "prediction").select("ID", "c").collect()
    assert all(r["c"] == (scores[r["ID"]] > 0.5) for r in classes if abs(scores[r["ID"]] - 0.5) > 1e-9)


def test_limits_of_rare_features(spark, monkeypatch):
    """A feature that the sample misses, or sees with one value, can be split on all the same."""
    monkeypatch.setattr(wide_forest, "SAMPLE_ROWS", 40)
    rows = [(Vectors.sparse(4, {0: float(i % 100)} | ({1: 3.0} if i == 1 else {2: 2.0 + i} if i < 4 else {})),) for i in range(4000)]
    starts, limits = wide_forest._bounds(spark.createDataFrame(rows, ["features"]), 4)
    sizes = np.diff(starts)
    assert sizes[0] > 15 and sizes[1] == 1 and sizes[2] >= 1 and sizes[3] == 0
    assert limits[starts[1]] == 1.5 and 0 < limits[starts[2]] < 5
