"""Models on a synthetic log with a planted signal."""

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from failcast.functions.columns import row_hash, within
from failcast.operators import components, curves, forest, importance, models, prep, resample, splits, wide_forest
from failcast.plans import catalog, model_queries
from failcast.plans import experiments as x
from failcast.schema import CATEGORICAL, CLASS_COST, KEYS, SEED, SENSORS, numeric_features
from failcast.sources import machine_log, sinks, storage


@pytest.fixture(scope="module")
def log(spark):
    """S16 climbs during the last ten days before a failure."""
    rng = np.random.default_rng(3)
    rows = []
    for machine in range(30):
        life = int(rng.integers(40, 160))
        for t in range(life):
            left = life - 1 - t
            row = {"ID": machine, "DATE": (pd.Timestamp("2020-01-01") + pd.Timedelta(days=t)).date(),
                   "REGION_CLUSTER": f"R{machine % 3}", "MAINTENANCE_VENDOR": f"V{machine % 2}",
                   "MANUFACTURER": f"M{machine % 4}", "WELL_GROUP": machine % 5, "AGE_OF_EQUIPMENT": float(t)}
            row |= {s: float(rng.normal()) for s in SENSORS}
            row["S16"] += max(0, 10 - left)
            row["EQUIPMENT_FAILURE"] = int(left == 0)
            rows.append(row)
    return spark.createDataFrame(pd.DataFrame(rows)).cache()


@pytest.fixture(scope="module")
def rows(log):
    encoder = prep.PanelEncoder(CATEGORICAL, numeric_features())
    out, _ = x.encoded(x.horizon_table(log), encoder, ("ID", "DATE", "split", "RUL_DAYS"))
    return out.withColumn("label", within(F.col("RUL_DAYS"), 7))


SMALL = {"logreg": {"max_iter": 30}, "rf": {"n_estimators": 10, "max_depth": 5},
         "hgb": {"n_estimators": 8, "max_depth": 3, "min_child_weight": 1}}


@pytest.mark.parametrize("kind", ["logreg", "rf", "hgb"])
def test_models_beat_chance_and_repeat(rows, kind):
    train = rows.filter("split = 'train'")
    test = rows.filter("split = 'test'")
    score = [models.add_score(test, models.fit(train, kind, SMALL[kind])) for _ in range(2)]
    r = curves.ranking_metrics(score[0]).first()
    assert r["roc_auc"] > 0.8
    a, b = (sorted((v["ID"], str(v["DATE"]), round(v["score"], 9)) for v in s.collect()) for s in score)
    assert a == b


def counted_reads(df):
    """``df``, and a counter of the rows that are read from it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


def test_the_log_is_read_once(log):
    counted, seen = counted_reads(log)
    table = x.horizon_table(counted)
    assert seen.value == log.count()
    rul = x.labels.rul_labels(log)
    expected = x.splits.time_split(x.features.lag_roll_features(rul), of=rul)
    assert sorted(map(str, table.collect())) == sorted(map(str, expected.collect()))
    assert table.columns == expected.columns
    assert x.splits.stored_time_split(rul.filter("ID < 0")).count() == 0


def test_kernels_slide_over_sequences_once(rows):
    train = storage.stored(models.sequence_rows(rows.drop("label"), 10)).filter("split = 'train'")
    train = train.withColumn("label", within(F.col("RUL_DAYS"), 30)).select("label", F.unwrap_udt("features").alias("f"))
    counted, seen = counted_reads(train)
    shape = F.transform(F.col("f")["values"], lambda v: v)
    dense = counted.filter("f.type = 1").select("label", array_to_vector(shape).alias("features"))
    models.fit_sequence_model(dense, {"lstm_units": 4, "epochs": 5})
    # Class sizes and responses; the look at the first row ends early.
    assert seen.value < 3 * train.count(), seen.value / train.count()


def test_calibrated_best(rows):
    model, table = models.fit_calibrated_best(rows, candidates=("logreg", "rf"), params=SMALL)
    assert table.count() == 2
    s = models.add_score(rows.filter("split = 'test'"), model)
    r = s.agg(F.min("score"), F.max("score")).first()
    assert 0 <= r[0] <= r[1] <= 1 and curves.ranking_metrics(s).first()["roc_auc"] > 0.8


def test_pca_keeps_the_wanted_share():
    assert components.components_for([0.6, 0.35, 0.05], 0.95) == 3
    assert components.components_for([0.6, 0.36, 0.04], 0.95) == 2
    assert components.components_for([1.0], 0.95) == 1


def test_reduced_vectors_match_numpy(rows, spark):
    pca = prep.fit_pca(rows, "features", "r", 0.95)
    m = np.stack([v[0] for v in rows.select(vector_to_array("features")).collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    k = components.components_for(values / values.sum(), 0.95)
    got = np.stack([v[0] for v in pca.transform(rows).select(vector_to_array("r")).collect()])
    assert got.shape[1] == k and np.allclose(got.mean(axis=0), 0, atol=1e-8)
    assert np.allclose(np.sort(got.var(axis=0, ddof=1))[::-1], values[:k])


def test_oversampling(spark):
    rng = np.random.default_rng(0)
    data = [(i, int(i < 20), [float(v) for v in rng.normal(size=3)]) for i in range(213)]
    df = spark.createDataFrame(data, "id long, label int, a array<double>")
    df = df.withColumn("features", array_to_vector("a"))
    a = resample.smote(df, keys=["id"])
    assert a.groupBy("label").count().select("count").distinct().count() == 1
    points = np.array([d[2] for d in data[:20]])
    # New rows lie between the lowest and highest real ones.
    made = np.stack([r[0].toArray() for r in a.filter("synthetic = 1").select("features").collect()])
    assert (made >= points.min(axis=0) - 1e-9).all() and (made <= points.max(axis=0) + 1e-9).all()


def test_oversampling_many_equal_rows(spark):
    data = [(i, int(i < 60), [1.0, 2.0] if i < 40 else [float(i), 0.0]) for i in range(200)]
    df = spark.createDataFrame(data, "id long, label int, a array<double>")
    df = df.withColumn("features", array_to_vector("a"))
    out = resample.smote(df, keys=["id"])
    assert out.filter("label = 1").count() == 140


def importance_by_encoding(model, df, columns, repeats, seed=42):
    """Each column moved along the order of rows, whole rows encoded and scored again."""
    ordered = importance.dense_index(df).orderBy("position").collect()
    rows = pd.DataFrame([r.asDict() for r in ordered], dtype=object)
    spark, n = df.sparkSession, len(rows)

    def quality(table):
        given = spark.createDataFrame(list(table[df.columns].itertuples(index=False, name=None)), df.schema)
        return curves.ranking_metrics(models.add_score(given, model)).first()["pr_auc"]

    base, out = quality(rows), {}
    for c in columns:
        drops = []
        for r in range(repeats):
            shift = 1 + (seed * 7919 + 104729 * (r + 1)) % max(n - 1, 1)
            moved = rows.copy()
            moved[c] = np.roll(rows[c].to_numpy(dtype=object), shift)
            drops.append(base - quality(moved))
        out[c] = (np.mean(drops), np.std(drops))
    return out


@pytest.mark.parametrize("kind, variant", [("logreg", "baseline"), ("rf", "both")])
def test_importance_of_other_models_and_reduced_vectors(log, kind, variant):
    df = x.horizon_table(log).withColumn("label", within(F.col("RUL_DAYS"), 7))
    train, test = (df.filter(f"split = '{s}'") for s in ("train", "test"))
    columns = ["REGION_CLUSTER", "S16", "S17"]
    encoder = prep.PanelEncoder(columns[:1], columns[1:], variant=variant).fit(train)
    model = models.fit(encoder.transform(train), kind, {"n_estimators": 5, "max_depth": 4, "max_iter": 20})
    whole = PipelineModel([encoder, model])
    table = importance.permutation_importance(whole, test, "label", columns, 2)
    want = importance_by_encoding(whole, test, columns, 2)
    for r in table.collect():
        assert (r["importance"], r["importance_std"]) == pytest.approx(want[r["feature"]], abs=1e-9)


def test_columns_without_a_split_are_not_scored(log):
    df = x.horizon_table(log).withColumn("label", within(F.col("RUL_DAYS"), 7))
    train = df.filter("split = 'train'")
    columns = [*CATEGORICAL, *SENSORS]
    encoder = prep.PanelEncoder(CATEGORICAL, SENSORS, scale=False).fit(train)
    model = models.fit(encoder.transform(train), "rf", {"n_estimators": 1, "max_depth": 1})
    encode, join, parts = importance.encoded_parts(encoder, columns)
    row = encode.transform(df).select(*parts.values()).first()
    used = importance.used_columns(model, join, row, parts)
    assert len(parts) == len(columns) and len(used) <= 1
    table = importance.permutation_importance(PipelineModel([encoder, model]), df.filter("split = 'test'"), "label", columns, 2)
    assert {r["feature"] for r in table.collect() if r["importance"]} <= set(used) and table.count() == len(columns)


def test_partitions_of_a_fit_hold_bounded_rows(spark, monkeypatch):
    """A table in few partitions is dealt over more before trees are fitted, and no row is lost."""
    df = spark.range(3000).select(
        (F.col("id") % 2).cast("int").alias("label"), array_to_vector(F.array(*[(F.col("id") * k % 7).cast("double") for k in range(5)])).alias("features")
    ).coalesce(1)
    assert models._spread(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(storage, "TASK_NUMBERS", 2500)
    dealt = models._spread(df)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) <= 600
    assert dealt.exceptAll(df).isEmpty() and df.exceptAll(dealt).isEmpty()
    for kind in models.TREES:
        seen = []
        monkeypatch.setattr(models, "spread", lambda d, n: seen.append(n) or storage.spread(d, n))
        models.fit(df, kind, {"n_estimators": 2, "max_depth": 2, "class_weight": None})
        assert seen == [5]


def test_forest_scores_equal_the_models(spark):
    """Scores in Arrow batches equal the model's own to the last bit, also with a column of another row."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 2, (400, 2)), rng.normal(size=(400, 3))], axis=1).astype(float)
    y = ((x[:, 0] + x[:, 2] + rng.normal(size=400)) > 1).astype(float)
    other = x[rng.permutation(400)]
    rows = [(*map(float, a), *map(float, b), float(t)) for a, b, t in zip(x, other, y)]
    df = spark.createDataFrame(rows, [*[f"a{i}" for i in range(5)], *[f"b{i}" for i in range(5)], "label"])
    mixed = ["a0", "a1", "b2", "a3", "a4"]
    for name, columns in (("own", [f"a{i}" for i in range(5)]), ("other", [f"b{i}" for i in range(5)]), ("mixed", mixed)):
        df = VectorAssembler(inputCols=columns, outputCol=name).transform(df)
    # Two features are binary attributes, which trees split on as categories.
    attrs = {"ml_attr": {"attrs": {"binary": [{"idx": 0}, {"idx": 1}], "numeric": [{"idx": i} for i in (2, 3, 4)]}, "num_attrs": 5}}
    train = df.select("label", F.col("own").alias("features")).withMetadata("features", attrs)
    model = RandomForestClassifier(numTrees=7, maxDepth=5, seed=3).fit(train)
    read = forest.read_trees(spark, model)
    scores = forest.shuffled_scores(spark, *read, 5, [(2, 1)], "own", "other")
    kinds = [f"p{i}" for i in range(2)]
    for name, out in zip(("own", "mixed"), kinds):
        df = model.setFeaturesCol(name).transform(df).withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).drop(
            "rawPrediction", "probability", "prediction"
        )
    found = df.select(scores.alias("s"), *kinds).collect()
    assert [r["s"] for r in found] == [[r["p0"], r["p1"]] for r in found]
    assert any(r["p0"] != r["p1"] for r in found)


def test_importance_finds_the_planted_sensor(rows, log):
    df = x.horizon_table(log).withColumn("label", within(F.col("RUL_DAYS"), 7))
    columns = [*CATEGORICAL, *SENSORS]
    encoder = prep.PanelEncoder(CATEGORICAL, SENSORS, scale=False).fit(df.filter("split = 'train'"))
    model = models.fit(encoder.transform(df.filter("split = 'train'")), "rf", SMALL["rf"])
    test = df.filter("split = 'test'")
    table = importance.permutation_importance(PipelineModel([encoder, model]), test, "label", columns, 3)
    assert importance.top_feature(table).first()["feature"] == "S16" and table.count() == len(columns)
    # The same drops as by encoding shuffled rows anew.
    want = importance_by_encoding(PipelineModel([encoder, model]), test, columns, 3)
    got = {r["feature"]: (r["importance"], r["importance_std"]) for r in table.collect()}
    assert all(got[c] == pytest.approx(want[c], abs=1e-9) for c in columns)
    n = test.count()
    index = [r[0] for r in importance.dense_index(test).select("position").collect()]
    assert sorted(index) == list(range(n))


def test_forests_with_machines_as_features_count_sparse_rows(log, monkeypatch):
    """Four classes, two of them told apart by machine and sensor; bags are drawn by machine and day."""
    seen = []

    def spied(train, *args, **options):
        seen.append((set(train.columns), args))
        return wide_forest.fit_wide_forest(train, *args, **options)

    monkeypatch.setattr(models, "WIDE", 8)
    monkeypatch.setattr(models, "fit_wide_forest", spied)
    small = {"n_estimators": 4, "max_depth": 4}
    kinds = {"LogReg balanced": {"max_iter": 3}, "LogReg cost-sensitive": {"max_iter": 3}, "RF cost-sensitive": small}
    out = x.run_multiclass(log, kinds).collect()
    assert len(out) == 8 and sum(r["selected"] for r in out) == 2
    ((columns, args),) = seen
    assert {"ID", "DATE"} <= columns and args[-1] == CLASS_COST


def test_three_horizons(log):
    small = {n: {"n_estimators": 5, "max_depth": 3} for n in ("NOW", "LE_7_DAYS", "LE_30_DAYS")}
    out = x.run_three_horizons(log, small).collect()
    assert {r["rule"] for r in out} == {"confidence", "policy", "cascade"}


@pytest.mark.parametrize("epsilon", [0.05, 0.01])
def test_thinned_curves_stay_close(spark, epsilon):
    rng = np.random.default_rng(11)
    label = rng.integers(0, 2, 20_000) * (rng.random(20_000) < 0.1)
    score = rng.normal(size=20_000) + label
    scored = spark.createDataFrame(pd.DataFrame({"g": "a", "label": label.astype(int), "score": score}))
    whole = curves.sweep(scored, ["g"]).toPandas().sort_values("hits")
    few = curves.thinned(curves.sweep(scored, ["g"]), ["g"], epsilon).toPandas().sort_values("hits")
    assert set(few.columns) == set(whole.columns) and len(whole) == 20_000
    assert len(few) <= 2 * (2 + np.log(20_000) + np.log(label.sum()) + 4 * epsilon) / epsilon + 8
    assert {0, 19_999} <= set(np.searchsorted(whole["hits"], few["hits"]))

    def rates(t):
        return t["tp"] / t["positives"], (t["hits"] - t["tp"]) / (t["total"] - t["positives"]), t["tp"] / t["hits"]

    for exact, kept in zip(rates(whole), rates(few), strict=True):
        drawn = np.interp(whole["hits"], few["hits"], kept)
        assert np.abs(drawn - exact).max() < 2.5 * epsilon
    areas = [np.trapezoid(rates(t)[0], rates(t)[1]) for t in (whole, few)]
    assert abs(areas[0] - areas[1]) < epsilon
    many = curves.pr_curve(scored, ["g"], epsilon)
    assert many.filter("threshold is null").count() == 1 and many.count() == len(few) + 1


def test_unknown_names(rows, log):
    with pytest.raises(ValueError):
        models.make_estimator("nope")
    with pytest.raises(ValueError):
        x.run_horizons(log, "nope")
    with pytest.raises(ValueError):
        prep.make_preprocessor("nope", [], [])


def test_log_and_model_files(rows, tmp_path, spark):
    table = spark.createDataFrame([("LE_7_DAYS", 1, 0.5)], "task string, config_id int, val_metric double")
    path = f"{tmp_path}/log"
    sinks.append_experiment_log(table, {"beta": 1.5, "bin_max_days": [7]}, path, "r1")
    whole = sinks.append_experiment_log(table, {"beta": 1.5, "bin_max_days": [7]}, path, "r2")
    assert {r["run_id"] for r in whole.collect()} == {"r1", "r2"}
    # A run that is logged again stands there once, with what it gave last; a task it no longer has is gone.
    two = spark.createDataFrame([("NOW", 1, 0.1), ("LE_7_DAYS", 1, 0.2)], "task string, config_id int, val_metric double")
    sinks.append_experiment_log(two, {"beta": 1.0}, path, "r2")
    whole = sinks.append_experiment_log(table, {"beta": 2.0}, path, "r2")
    assert sorted((r["run_id"], r["task"], r["beta"]) for r in whole.collect()) == [("r1", "LE_7_DAYS", 1.5), ("r2", "LE_7_DAYS", 2.0)]
    # Runs at the same time do not touch each other; results may come from the log itself.
    with ThreadPool(4) as pool:
        pool.map(lambda k: sinks.append_experiment_log(table, {"beta": float(k)}, path, f"c{k % 4}"), range(4))
    again = sinks.append_experiment_log(whole.filter("run_id = 'r1'").select("task", "config_id", "val_metric"), {"beta": 9.0}, path, "r1")
    assert sorted(r["run_id"] for r in again.collect()) == ["c0", "c1", "c2", "c3", "r1", "r2"]
    train = rows.filter("split = 'train'")
    encoder = prep.PanelEncoder(["REGION_CLUSTER"], ["S16"], variant="svd_cat")
    model = models.fit(train, "logreg", SMALL["logreg"])
    sinks.save_best(model, {"task": "LE_7_DAYS", "threshold": 0.2, "bins": [7], "params": {"epochs": 3}}, f"{tmp_path}/b")
    meta = machine_log.read_model_metadata(spark, f"{tmp_path}/b/*_metadata").first()
    assert meta["threshold"] == 0.2 and meta["bins"] == [7] and meta["params"]["epochs"] == 3
    assert encoder.variant == "svd_cat"


def test_saved_preparation_reads_back(log, tmp_path):
    encoder = prep.PanelEncoder(CATEGORICAL, SENSORS, variant="both").fit(log)
    encoder.write().overwrite().save(f"{tmp_path}/p")
    again = PipelineModel.load(f"{tmp_path}/p")
    a = encoder.transform(log).orderBy("ID", "DATE").first()["features"]
    b = again.transform(log).orderBy("ID", "DATE").first()["features"]
    assert np.allclose(a.toArray(), b.toArray())


def test_oversampling_of_few_rows_is_dealt_over_tasks(spark):
    data = [(i, int(i < 3), [float(i), float(i % 3), 1.0]) for i in range(9003)]
    df = spark.createDataFrame(data, "id long, label int, a array<double>").withColumn("features", array_to_vector("a"))
    made = resample.smote(df, keys=["id"], limit=3000).filter("synthetic = 1")
    counts = [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == 8997 and len(counts) > 4 and max(counts) <= 8997 // 2
    points = [np.array(d[2]) for d in data[:3]]
    for x in (r[0].toArray() for r in made.select("features").limit(50).collect()):
        gaps = [abs(np.linalg.norm(x - p) + np.linalg.norm(x - q) - np.linalg.norm(p - q)) for p in points for q in points]
        assert min(gaps) < 1e-9


def test_split_by_a_stored_hash(spark):
    df = spark.range(500).select(F.col("id").alias("ID"), F.lit("2020-01-01").alias("DATE"), (F.col("id") % 9 == 0).cast("int").alias("label"))
    plain = splits.stratified_split(df, "label")
    stored = splits.stratified_split(df.withColumn("_h", row_hash(KEYS, SEED)), "label", hashed="_h")
    assert stored.columns == plain.columns
    assert sorted(stored.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("search", ["tune_random", "tune_sequences"])
def test_tuning_queries_run_the_whole_search(monkeypatch, search):
    asked = []
    monkeypatch.setattr(model_queries, "daily_panel", lambda *_: "log")
    monkeypatch.setattr(x, search, lambda *args, **limits: asked.append((args, limits)) or ["table"])
    catalog.QUERIES[{"tune_random": "random_tune", "tune_sequences": "sequence_tune"}[search]](None, "")
    assert asked == [(("log",), {})]
