"""Random Fourier features: a linear model on them is close to one with the radial kernel.

The kernel exp(-gamma |a - b|^2) is the mean of cos(w(a - b)) over normal w, so cosines along random
directions, each with a random phase, have products that come near to it, the nearer the more there are. Each row
is mapped on its own, so fitting stays a linear model's work at any number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.operators.components import Rows
from failcast.schema import SEED


def scaled_gamma(df: DataFrame, column: str) -> float:
    """1 / (width x variance of all entries), 1 / width for constant data."""
    stats = df.select(Summarizer.metrics("mean", "normL2", "count").summary(F.col(column)).alias("s"))
    row = stats.select("s.mean", "s.normL2", "s.count").first()
    mean, norm, count = row[0].toArray(), row[1].toArray(), max(1, row[2])
    spread = float((norm**2).sum() / (count * len(mean)) - mean.mean() ** 2)
    return 1 / (len(mean) * spread) if spread > 1e-12 else 1 / len(mean)


class FourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Vector column to ``size`` cosines; the directions follow from the seed."""

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of cosines", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "entries of a vector", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "number of cosines", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel exp(-gamma |a - b|^2)", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of directions and phases", TypeConverters.toInt)

    def __init__(self, inputCol=None, outputCol=None, width=None, size=None, gamma=None, seed=SEED):
        super().__init__()
        if width is not None:
            self._set(inputCol=inputCol, outputCol=outputCol, width=width, size=size, gamma=gamma, seed=seed)

    def directions(self) -> tuple[np.ndarray, np.ndarray]:
        width, size, gamma = (self.getOrDefault(p) for p in (self.width, self.size, self.gamma))
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        return rng.normal(size=(width, size)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, size)

    def _transform(self, df: DataFrame) -> DataFrame:
        size = self.getOrDefault(self.size)
        shared = df.sparkSession.sparkContext.broadcast(self.directions())

        @F.arrow_udf("array<double>")
        def cosines(vectors: pa.Array) -> pa.Array:
            directions, phases = shared.value
            found = np.cos(Rows(vectors).times(directions) + phases) * np.sqrt(2 / size)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * size), pa.array(found.ravel()))

        source = F.unwrap_udt(F.col(self.getOrDefault(self.inputCol)))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(cosines(source)))
