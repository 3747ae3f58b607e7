"""Running totals and order statistics against brute force, with hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from failcast.functions import order
from failcast.operators import curves, splits


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one value."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(1000, 0.25), np.round(rng.normal(size=2000), 3)])
    pdf = pd.DataFrame({"id": range(3000), "x": x, "g": rng.integers(0, 2, 3000), "y": rng.integers(0, 2, 3000)})
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


@pytest.mark.parametrize("ranges", [1, 4, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(hot, ranges, descending):
    pdf, df = hot
    counts = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    got = order.running_totals(counts, "x", ["n", "p"], ["g"], descending, ranges=ranges).toPandas()
    want = pdf.groupby(["g", "x"]).agg(n=("y", "size"), p=("y", "sum")).reset_index()
    want = want.sort_values(["g", "x"], ascending=[True, not descending])
    want["run_n"] = want.groupby("g")["n"].cumsum()
    want["run_p"] = want.groupby("g")["p"].cumsum()
    both = got.merge(want, on=["g", "x"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(want)
    assert (both["run_n"] == both["run_n_w"]).all() and (both["run_p"] == both["run_p_w"]).all()
    assert (got.groupby("g")["all_n"].nunique() == 1).all() and got.groupby("g")["all_n"].first().sum() == 3000


@pytest.mark.parametrize("limit,accuracy", [(100_000, 10_000), (50, 100), (5, 10), (1, 3)])
def test_exact_quantiles_at_any_narrowing(hot, limit, accuracy):
    pdf, df = hot
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = order.exact_quantiles(df, ["x", "id"], probs, limit=limit, accuracy=accuracy)
    for c in ("x", "id"):
        assert np.allclose(got[c], np.quantile(pdf[c], probs))


def test_quantile_of_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert order.exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}


def test_wrong_guess_is_still_exact(hot):
    pdf, df = hot
    _, found = order.order_statistics(
        df, {"id": F.col("id")}, lambda _, n: [[1234]], "long", limit=100, guess=lambda a, b, n: (0, 10)
    )
    assert found["id"][1234] == 1234


def test_curves_do_not_depend_on_partitions(hot):
    _, df = hot
    scored = df.select(F.col("y").alias("label"), F.col("x").alias("score"))
    seen = set()
    for parts, ranges in ((1, 1), (4, 4), (64, 64)):
        rows = curves.sweep(scored.repartition(parts), ranges=ranges)
        r = rows.agg(curves._average_precision().alias("ap"), curves._roc_area().alias("auc")).first()
        t = rows.agg(curves._best_score(curves.curve_f_score(2.0))).first()
        seen.add((round(r["ap"], 12), round(r["auc"], 12), t[0]))
    assert len(seen) == 1


def test_cap_rows_is_exact_and_repeatable(hot):
    _, df = hot
    a = splits.cap_rows(df, 777, keys=["id"]).toPandas()["id"]
    b = splits.cap_rows(df.repartition(3), 777, keys=["id"]).toPandas()["id"]
    assert len(a) == 777 and set(a) == set(b)
    assert splits.cap_rows(df, 5000, keys=["id"]).count() == 3000


def test_stratified_split_counts(hot):
    _, df = hot
    df = df.withColumn("k", (F.col("id") < 20).cast("int"))
    got = splits.stratified_split(df, "k", keys=["id"]).groupBy("k", "split").count().collect()
    assert {(r["k"], r["split"]): r["count"] for r in got} == {
        (1, "train"): 14, (1, "val"): 3, (1, "test"): 3,
        (0, "train"): 2086, (0, "val"): 447, (0, "test"): 447,
    }
