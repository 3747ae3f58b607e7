"""Class weights as numbers and as a weight column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_weight_table(df: DataFrame, label: str) -> DataFrame:
    """Per class: rows, balanced weight n / (classes * rows), and other rows / rows."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    # One row per class from here on.
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("w")).scalar()
    return counts.select(
        "class",
        "n",
        (whole["n"] / (whole["k"] * F.col("n"))).alias("balanced"),
        ((whole["n"] - F.col("n")) / F.greatest(F.col("n"), F.lit(1))).alias("others_per_row"),
    )


def balanced_weights(df: DataFrame, label: str) -> dict[int, float]:
    return {r["class"]: r["balanced"] for r in class_weight_table(df, label).collect()}


def positive_weight(df: DataFrame, label: str, factor: float = 1.0) -> float:
    """Negatives per positive (at least one positive assumed), times ``factor``."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return row["n"] / max(row["p"], 1) * factor


def weight_column(label: str, weights: Mapping[int, float]) -> Column:
    out = F.lit(1.0)
    for c, w in weights.items():
        out = F.when(F.col(label) == c, F.lit(float(w))).otherwise(out)
    return out
