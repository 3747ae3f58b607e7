"""Small cases computed by hand."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from failcast.functions.columns import parse_date, parse_date_any, to_flag
from failcast.operators import curves, features, horizons, labels, metrics, prep, splits, tuning, weights
from failcast.schema import make_tasks, require_columns


def days(spark, readings, machine=1, flags=None):
    rows = [
        Row(ID=machine, DATE=dt.date(2020, 1, 1) + dt.timedelta(i), S=None if v is None else float(v),
            EQUIPMENT_FAILURE=(flags or [0] * len(readings))[i])
        for i, v in enumerate(readings)
    ]
    return spark.createDataFrame(rows, "ID long, DATE date, S double, EQUIPMENT_FAILURE int")


def column(df, name):
    return [r[name] for r in df.orderBy("ID", "DATE").collect()]


def test_lag_and_mean_stay_within_a_machine(spark):
    df = days(spark, [1, 2, 3, 4]).union(days(spark, [10, 20, 30, 40], 2))
    out = features.lag_roll_features(df, ["S"])
    assert column(out, "S_lag1") == [None, 1, 2, 3, None, 10, 20, 30]
    assert column(out, "S_roll7_mean") == [None, None, 1.5, 2.0, None, None, 15, 20]


def test_slope_and_deviation_skip_nulls(spark):
    out = features.rolling_features(days(spark, [1, None, 3, 7]), ["S"], windows=(7,))
    last = out.orderBy("DATE").collect()[-1]
    assert last["S_roll7_slope"] == pytest.approx(2.0)
    assert last["S_roll7_std"] == pytest.approx(1.414214, abs=1e-6)
    assert last["S_roll7_mean"] == pytest.approx(2.0) and last["S_delta1"] == 4.0


def test_features_never_see_the_present_or_other_machines(spark):
    base = days(spark, [5, 3, 8, 1, 9, 2]).union(days(spark, [1, 2, 3, 4, 5, 6], 2))
    changed = base.withColumn(
        "S", F.when((F.col("ID") == 1) & (F.col("DATE") == "2020-01-04"), 1000.0).otherwise(F.col("S"))
    )
    names = [f"S_roll{w}_{k}" for w in (7, 14) for k in ("mean", "std", "slope")] + ["S_lag1"]
    a = features.rolling_features(base, ["S"], (7, 14)).orderBy("ID", "DATE").collect()
    b = features.rolling_features(changed, ["S"], (7, 14)).orderBy("ID", "DATE").collect()
    for i, (x, y) in enumerate(zip(a, b)):
        if i < 4 or i > 5:
            assert all(x[n] == y[n] or abs(x[n] - y[n]) < 1e-9 for n in names)
    assert a[5]["S_lag1"] == b[5]["S_lag1"] and a[4]["S_lag1"] != b[4]["S_lag1"]


def test_advance_label_modes(spark):
    flags = [0, 0, 0, 0, 1, 0, 0, 0, 0, 0]
    log = days(spark, range(10), flags=flags)
    day = {m: [r["DATE"].day - 1 for r in labels.advance_label(log, 3, m).filter("FAIL_WITHIN_HORIZON = 1").collect()]
           for m in ("forward", "trailing")}
    assert sorted(day["forward"]) == [1, 2, 3]
    # Row 4 is the failure itself and is not among the failure-free rows.
    assert sorted(day["trailing"]) == [3, 5]
    with pytest.raises(ValueError):
        labels.advance_label(log, 3, "sideways")


def test_rul_labels(spark):
    log = days(spark, range(4), flags=[0, 0, 1, 1]).union(days(spark, range(3), 2))
    out = labels.rul_labels(log, clip_days=1)
    assert column(out, "RUL_DAYS") == [2, 1, 0] and column(out, "RUL_1") == [1, 1, 0]


def test_repeated_day_fails_loudly(spark):
    log = days(spark, [1, 2], flags=[0, 1]).union(days(spark, [3], flags=[0]))
    with pytest.raises(Exception, match="merge_days"):
        labels.rul_labels(log).collect()


def test_dates_and_flags(spark):
    text = ["1/2/68", "1/2/69", "12/1/14", "2014-12-01", None, "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string")
    rows = df.select("i", parse_date(F.col("t")).alias("a"), parse_date_any(F.col("t")).alias("b")).orderBy("i").collect()
    d = dt.date
    assert [r["a"] for r in rows] == [d(2068, 1, 2), d(1969, 1, 2), d(2014, 12, 1), None, None, None]
    assert rows[3]["b"] == d(2014, 12, 1)
    flags = spark.createDataFrame([("1",), ("0.0",), ("x",), (None,), ("NaN",)], "f string")
    assert [r[0] for r in flags.select(to_flag(F.col("f"))).collect()] == [1, 0, 0, 0, 0]


def test_date_quantile(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, n),) for n in (1, 2, 5, 9)], "DATE date")
    assert splits.date_quantiles(df, [0.7]).first()[0] == [pytest.approx(18266.4)]
    got = splits.time_split_2way(df, 0.3).filter("split = 'train'").count()
    assert got == 3
    with pytest.raises(ValueError):
        splits.time_split(df, 0.9, 0.2)


def test_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "2"), (None, "1"), (3.0, "2"), (None, "1"), (None, "3")], "m double, c string")
    assert prep.medians(df, ["m"]) == {"m": 2.0}
    assert prep.most_frequent(df, ["c"]).first()["value"] == "1"


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 8, "y int")
    assert weights.balanced_weights(df, "y") == {1: 2.5, 0: 0.625}
    assert weights.positive_weight(df, "y") == 4.0


@pytest.fixture
def scored(spark):
    return spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")


def test_ranking_metrics(scored, spark):
    r = curves.ranking_metrics(scored).first()
    assert r["pr_auc"] == pytest.approx(0.833333, abs=1e-6) and r["roc_auc"] == 0.75
    assert curves.tune_threshold(scored, beta=2.0).first()["threshold"] == 0.35
    points = curves.pr_curve(scored).orderBy(F.col("threshold").asc_nulls_last()).collect()
    assert [(p[0], round(p[1], 6), p[2]) for p in points] == [
        (0.1, 0.5, 1.0), (0.35, 0.666667, 1.0), (0.4, 0.5, 0.5), (0.8, 1.0, 0.5), (None, 1.0, 0.0)
    ]
    one = spark.createDataFrame([(0, 0.5), (1, 0.5)], "label int, score double")
    r = curves.ranking_metrics(one).first()
    assert (r["pr_auc"], r["roc_auc"]) == (0.5, 0.5)
    none = spark.createDataFrame([(0, 0.5), (0, 0.7)], "label int, score double")
    r = curves.ranking_metrics(none).first()
    assert r["roc_auc"] is None and r["pr_auc"] == 0.0
    assert curves.tune_threshold(none, beta=2.0).first()["threshold"] == 0.5


def test_roc_area_ignores_monotone_changes(scored):
    warped = scored.withColumn("score", F.exp("score") * 3)
    assert curves.ranking_metrics(warped).first()["roc_auc"] == 0.75


def test_rul_errors(spark):
    preds = spark.createDataFrame([(0, 2.0), (5, 3.0), (20, 30.0), (40, 35.0)], "RUL_DAYS int, RUL_PRED double")
    r = metrics.rul_error(preds).first()
    assert r["mae"] == 4.75 and r["rmse"] == pytest.approx(5.766281, abs=1e-6)
    bands = {b["band"]: b for b in metrics.rul_error_bands(preds).collect()}
    assert (bands[7]["n"], bands[7]["mae"], bands[7]["rmse"]) == (2, 2.0, 2.0)
    assert bands[30]["mae"] == pytest.approx(4.666667, abs=1e-6) and bands[30]["rmse"] == 6.0


P3 = "p_now double, p_le7 double, p_le30 double"


def test_confidence(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.6)], P3)
    r = horizons.horizon_confidence(df).first()
    got = [r[c] for c in ("conf_NOW", "conf_D1_7", "conf_D8_30", "conf_GT_30")]
    assert got == pytest.approx([0.3, 0.0, 0.3, 0.4]) and r["pred_class"] == 3
    assert sum(got) == pytest.approx(1.0)


def test_policy_equals_cascade(spark):
    df = spark.createDataFrame([(0.6, 0.1, 0.1), (0.1, 0.45, 0.9), (0.1, 0.1, 0.35), (0.1, 0.1, 0.1)], P3)
    t = {"NOW": 0.5, "LE_7_DAYS": 0.4, "LE_30_DAYS": 0.3}
    out = horizons.horizon_cascade(horizons.horizon_policy(df, t), t).collect()
    assert [r["policy_class"] for r in out] == [r["cascade_class"] for r in out] == [0, 1, 2, 3]


def test_policy_tuning_falls_back_without_feasible_thresholds(spark):
    rows = [(c, 0.5, 0.5, 0.5) for c in (0, 1, 2, 3)]
    df = spark.createDataFrame(rows, "true_class int, " + P3)
    grids = {"NOW": [0.4, 0.6], "LE_7_DAYS": [0.4, 0.6], "LE_30_DAYS": [0.4, 0.6]}
    best = horizons.tune_policy(df, grids).first()
    # All NOW scores .45 * F1(.4); no choice meets the recall floors.
    assert not best["feasible"] and best["t_now"] == 0.4 and best["score"] == pytest.approx(0.18)
    with pytest.raises(ValueError):
        horizons.policy_grid(df, {**grids, "NOW": [0.6, 0.4]})


def test_stage_without_rows(spark):
    df = spark.createDataFrame([(0, 0.9, 0.9, 0.9)], "true_class int, " + P3)
    t = {"NOW": 0.5, "LE_7_DAYS": 0.5, "LE_30_DAYS": 0.5}
    out = horizons.cascade_stage_metrics(df, t).orderBy("stage").collect()
    assert out[0]["precision"] == 1.0 and out[1]["precision"] is None and out[2]["stage_size"] == 0


def test_one_hot_unknown_and_null(spark):
    fit = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    model = prep.PanelEncoder(["c"], []).fit(fit)
    new = spark.createDataFrame([("a",), ("b",), ("z",)], "c string")
    assert [list(r["features"].toArray()) for r in model.transform(new).collect()] == [[1, 0], [0, 1], [0, 0]]


def test_many_categories_are_looked_up(spark):
    fit = spark.createDataFrame([(f"m{i}",) for i in range(50)], "c string")
    model = prep.PanelEncoder(["c"], [], index_limit=20).fit(fit)
    row = model.transform(fit).first()
    assert row["features"].size == 50 and row["features"].numNonzeros() == 1


def test_columns_and_tasks(spark):
    with pytest.raises(ValueError, match=r"\['DATE', 'S5'\]"):
        require_columns(spark.createDataFrame([(1,)], "ID int"), ["S5", "ID", "DATE"])
    assert make_tasks([30, 0, 7, 7]) == [("LE_0_DAYS", 0), ("LE_7_DAYS", 7), ("LE_30_DAYS", 30)]


def test_grids(spark):
    space = {"a": [1, 2, 3], "b": [0.1, 0.2]}
    full = tuning.full_grid(spark, space)
    assert sorted(r["config_id"] for r in full.collect()) == list(range(1, 7))
    assert tuning.sample_grid(spark, space, 4).distinct().count() == 4
    drawn = tuning.sample_grid(spark, space, 10, replace=True)
    assert drawn.count() == 10 and drawn.collect() == tuning.sample_grid(spark, space, 10, replace=True).collect()


def test_draws_are_a_permutation_of_the_grid(spark):
    """All of a small grid once, in an order of its own for each seed; combinations as the full grid numbers them."""
    space = {"a": [1, 2, 3], "b": [0.1, 0.2], "c": list("vwxyz")}
    full = {r["config_id"]: (r["a"], r["b"], r["c"]) for r in tuning.full_grid(spark, space).collect()}
    orders = []
    for seed in (1, 2, 3):
        drawn = tuning.sample_grid(spark, space, 100, seed).collect()
        assert {r["config_id"]: (r["a"], r["b"], r["c"]) for r in drawn} == full
        orders.append(tuple(r["config_id"] for r in drawn))
    assert len(set(orders)) == 3 and tuple(sorted(orders[0])) not in orders
    for size in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(size).select(tuning.shuffled_number(F.col("id"), size, 5)).collect()]
        assert sorted(got) == list(range(size))


def test_draws_from_a_grid_that_cannot_be_listed(spark):
    space = {f"p{i}": list(range(10)) for i in range(12)}
    drawn = tuning.sample_grid(spark, space, 3000, seed=4)
    rows = drawn.collect()
    assert len({r["config_id"] for r in rows}) == 3000
    assert all(r["config_id"] - 1 == int("".join(str(r[f"p{i}"]) for i in range(12))) for r in rows)
    for i in range(12):
        counts = [sum(r[f"p{i}"] == v for r in rows) for v in range(10)]
        assert min(counts) > 220 and max(counts) < 380
    assert rows[:40] == tuning.sample_grid(spark, space, 40, seed=4).collect()


def test_best_rows(spark):
    df = spark.createDataFrame([("t", 2, 0.5), ("t", 1, 0.5), ("u", 3, 0.1)], "task string, config_id int, val_metric double")
    assert {(r["task"], r["config_id"]) for r in tuning.best_per_task(df).collect()} == {("t", 1), ("u", 3)}
    flagged = {(r["task"], r["config_id"]) for r in tuning.flag_best(df).filter("best_for_task").collect()}
    assert flagged == {("t", 1), ("u", 3)}
    js = df.limit(1).select(tuning.params_json({"b": F.lit(2), "a": F.lit("x")}).alias("j")).first()[0]
    assert js == '{"a":"x","b":2}'


def test_sequences_stay_within_a_machine(spark):
    df = days(spark, [1, 2, 3]).union(days(spark, [7, 8], 2))
    out = features.sequence_windows(df, "S", 2).orderBy("ID", "DATE").collect()
    assert [r["sequence"] for r in out] == [[1, 2], [2, 3], [7, 8]]
