"""Categories of any number: a distributed dictionary instead of a list on the driver.

Values are counted, then numbered in their order over all tasks: each task numbers its range of the
sorted values behind the counts of the ranges before. Rows meet their numbers in a join. A value
that a large share of the rows has would land in one task, so values with more than one row in ``HOT`` are
known to every task (there are fewer than ``HOT`` of them), and their rows stay out of the join's way.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from failcast.sources.storage import shared_folder, stored

#: A value with more than this part of all rows is sent to every task.
HOT = 256


def fit_dictionary(counts: DataFrame) -> DataFrame:
    """``value, n, position``: distinct values (``value, n``) numbered from 0 in their order."""
    dealt = counts.select("value", "n").repartitionByRange("value").sortWithinPartitions("value")
    # The ranges stay as they are once written.
    ranges = stored(dealt.withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A row per range.
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("value"))
    placed = ranges.join(F.broadcast(starts), "_range").withColumn("position", F.col("_start") + inside - 1)
    return placed.select("value", "n", "position")


def add_position(df: DataFrame, value: Column, dictionary: DataFrame, out: str) -> DataFrame:
    """``df`` with the number of each row's value; null where the dictionary lacks it."""
    taken = {c.lower() for c in df.columns}

    def fresh(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        return name

    text, quick, number, salt = (fresh(n) for n in ("_value", "_quick", "_number", "_salt"))
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    hot = dictionary.where(F.col("n") * HOT > total).select(F.col("value").alias(text), F.col("position").alias(quick))
    rows = df.withColumn(text, value.cast("string")).join(F.broadcast(hot), text, "left")
    # What has its number, and what has no value, is spread and meets nothing.
    settled = F.col(quick).isNotNull() | F.col(text).isNull()
    others = F.monotonically_increasing_id() % 65_536
    rows = rows.withColumn(salt, F.when(settled, others)).withColumn(text, F.when(~settled, F.col(text)).otherwise(F.lit("")))
    known = dictionary.select(
        F.col("value").alias(text), F.lit(-1).cast("long").alias(salt), F.col("position").alias(number)
    )
    rows = rows.withColumn(salt, F.coalesce(F.col(salt), F.lit(-1).cast("long")))
    joined = rows.join(known, [text, salt], "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(quick, number).alias(out))


def one_hot(position: Column, size: int) -> Column:
    """Sparse vector with a one at ``position``; null gives all zeros."""

    @F.arrow_udf(VectorUDT())
    def vectors(positions: pa.Array) -> pa.Array:
        known = positions.is_valid().to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(known)]).astype(np.int32))
        places = positions.drop_null().cast(pa.int32())
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(len(known), np.int8)),
                pa.array(np.full(len(known), size, np.int32)),
                pa.ListArray.from_arrays(ends, places),
                pa.ListArray.from_arrays(ends, pa.array(np.ones(len(places)))),
            ],
            names=["type", "size", "indices", "values"],
        )

    return vectors(position)


class CategoryEncoder(Transformer, MLWritable, MLReadable):
    """One-hot vectors of a column's values by a stored dictionary; unknown and null values give all zeros."""

    inputCol = Param(Params._dummy(), "inputCol", "column of values", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of vectors", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "values in the dictionary", TypeConverters.toInt)
    path = Param(Params._dummy(), "path", "folder of the dictionary, shared by all executors", TypeConverters.toString)

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, dictionary: DataFrame | None = None):
        super().__init__()
        if dictionary is None:
            return
        path = f"{shared_folder(dictionary.sparkSession)}/dictionary-{uuid.uuid4().hex}"
        dictionary.write.parquet(path)
        self._set(inputCol=inputCol, outputCol=outputCol, path=path)
        self._set(size=self.dictionary(dictionary.sparkSession).count())

    def dictionary(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("value string, n long, position long").parquet(self.getOrDefault(self.path))

    def _transform(self, df: DataFrame) -> DataFrame:
        out, size = self.getOrDefault(self.outputCol), self.getOrDefault(self.size)
        found = add_position(df, F.col(self.getOrDefault(self.inputCol)), self.dictionary(df.sparkSession), out)
        return found.withColumn(out, one_hot(F.col(out), size)).withMetadata(out, {"ml_attr": {"num_attrs": size}})

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader(cls)


class _EncoderWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.dictionary(self.sparkSession).write.parquet(f"{path}/values")


class _EncoderReader(DefaultParamsReader):
    def load(self, path: str) -> CategoryEncoder:
        return super().load(path)._set(path=f"{path}/values")
