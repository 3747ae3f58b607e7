"""Forests whose trees have their own bags, with class weights of each bag.

How often a row is in a tree's bag is a Poisson number drawn from the row's hash, which comes near to drawing rows
with replacement, needs no row counts, and is the same on any cluster and partitioning. The rows per class of
all bags are counted in one pass, so each tree's rows weigh as much in every class of its bag.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.functions.columns import row_hash
from failcast.schema import KEYS, SEED

#: Bags that a row is hashed for at once: each takes a part of one hash.
_PER_HASH = 3
_BITS = 20


def _poisson_steps() -> list[int]:
    """Numbers of 20 bits from which on a Poisson number of mean 1 is at least 1, 2, ..."""
    steps, share = [], 0.0
    for k in range(20):
        share += math.exp(-1) / math.factorial(k)
        step = round(share * (1 << _BITS))
        if step >= 1 << _BITS:
            break
        steps.append(step)
    return steps


_STEPS = _poisson_steps()


def bag_count(tree: int, keys: Sequence[str] = KEYS, seed: int = SEED) -> Column:
    """How often a row is in the bag of ``tree``."""
    part = F.shiftright(row_hash(keys, seed * 1_000_003 + tree // _PER_HASH), _BITS * (tree % _PER_HASH))
    number = part.bitwiseAND((1 << _BITS) - 1)
    count = F.lit(0)
    for step in _STEPS:
        count = count + (number >= step).cast("int")
    return count


def bag_counts(trees: int, keys: Sequence[str] = KEYS, seed: int = SEED) -> Column:
    """How often a row is in each bag, as one array: every hash is taken once."""
    mask = (1 << _BITS) - 1

    def counted(h: Column, place: int) -> Column:
        number = F.shiftright(h, _BITS * place).bitwiseAND(mask)
        return sum(((number >= step).cast("int") for step in _STEPS), F.lit(0)).cast("byte")

    hashes = F.array(*[row_hash(keys, seed * 1_000_003 + g) for g in range(-(-trees // _PER_HASH))])
    parts = F.transform(hashes, lambda h: F.array(*[counted(h, i) for i in range(_PER_HASH)]))
    return F.slice(F.flatten(parts), 1, trees)


def _times(tree: int, keys: Sequence[str], seed: int, counts: str | None) -> Column:
    return F.get(counts, F.lit(tree)).cast("int") if counts else bag_count(tree, keys, seed)


def bag_sizes(
    df: DataFrame, label: str, trees: int, keys: Sequence[str] = KEYS, seed: int = SEED, counts: str | None = None
) -> dict[tuple[int, int], int]:
    """Rows per tree and class, repeats included: a pass over the data for every 60 trees.

    ``counts`` names a stored column of ``bag_counts``, which saves the hashes.
    """
    out: dict[tuple[int, int], int] = {}
    for first in range(0, trees, 60):
        some = range(first, min(trees, first + 60))
        sums = [F.sum(_times(t, keys, seed, counts)).alias(f"t{t}") for t in some]
        for row in df.groupBy(F.col(label).alias("_class")).agg(*sums).collect():
            out |= {(t, row["_class"]): row[f"t{t}"] for t in some}
    return out


def bag_weights(
    df: DataFrame,
    label: str,
    tree: int,
    sizes: dict[tuple[int, int], int],
    out: str = "weight",
    keys: Sequence[str] = KEYS,
    seed: int = SEED,
    counts: str | None = None,
) -> DataFrame:
    """Rows in the bag of ``tree`` with their weight: times drawn x bag / (classes x class in the bag)."""
    mine = {c: n for (t, c), n in sizes.items() if t == tree and n}
    factor = F.lit(0.0)
    for c, n in mine.items():
        factor = F.when(F.col(label) == c, F.lit(sum(mine.values()) / (len(mine) * n))).otherwise(factor)
    return df.withColumn(out, _times(tree, keys, seed, counts) * factor).where(F.col(out) > 0)


def joined_forest(models: Sequence[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest of the trees of several."""
    jvm_trees = [t for m in models for t in m._java_obj.trees()]
    context = SparkSession.builder.getOrCreate().sparkContext
    kinds = context._jvm.org.apache.spark.ml.classification
    array = context._gateway.new_array(kinds.DecisionTreeClassificationModel, len(jvm_trees))
    for i, tree in enumerate(jvm_trees):
        array[i] = tree
    first = models[0]._java_obj
    made = kinds.RandomForestClassificationModel(first.uid(), array, first.numFeatures(), first.numClasses())
    for name in ("featuresCol", "labelCol"):
        made.set(name, models[0].getOrDefault(name))
    made.set("numTrees", len(jvm_trees))
    return RandomForestClassificationModel(made)
