"""Preparation fitted on train rows: impute, scale, encode, reduce.

``PanelEncoder.fit`` gathers a few numbers per column and returns a pipeline of
JVM stages, so a fitted preparation runs inside generated code; projections and the
dictionary of very many categories are stages of their own and are saved with it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.functions.order import exact_quantiles
from failcast.operators.components import Projection, principal_components
from failcast.operators.dictionary import CategoryEncoder, fit_dictionary
from failcast.schema import CATEGORICAL

VARIANTS = ("baseline", "pca_num", "svd_cat", "both")
# Categories up to this number are listed in the model, more are looked up in a stored dictionary.
INDEX_LIMIT = 10_000


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column."""
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column and text value, nulls left out; all columns in one pass."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.explode(cells).alias("c"))
        .select("c.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most common value per column, the smallest on ties, and the number of values."""
    return category_counts(df, columns).groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).getField("value").alias("value"),
        F.count(F.lit(1)).alias("n_values"),
    )


def scale_stats(df: DataFrame, fills: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each filled column; deviation 0 counts as 1."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()}
    row = df.agg(
        *[F.avg(x).alias(f"m_{c}") for c, x in filled.items()],
        *[F.stddev_pop(x).alias(f"s_{c}") for c, x in filled.items()],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in fills}


def _number(value: float) -> str:
    return f"{float(value)!r}D"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_pca(df: DataFrame, column: str, out: str, variance: float) -> PipelineModel:
    """Centred principal components that keep the wanted share of variance; ``df`` is a stored table."""
    directions, mean, _ = principal_components(df, column, variance)
    return PipelineModel([Projection(column, out, directions, mean @ directions)])


def fit_svd(df: DataFrame, column: str, out: str, components: int) -> Projection:
    """Uncentred projection on the leading right singular vectors."""
    rows = MLUtils.convertVectorColumnsFromML(df.select(column), column)
    matrix = RowMatrix(rows)
    width = matrix.numCols()
    # One-hot blocks depend on each other; directions without weight are left out.
    svd = matrix.computeSVD(min(components, width), rCond=1e-6)
    return Projection(column, out, np.asarray(svd.V.toArray()))


class PanelEncoder(Estimator):
    """Categorical and numeric columns to one ``features`` vector.

    ``reduce_all`` adds principal components over the whole vector; the variants
    reduce one branch each.
    """

    def __init__(
        self,
        categorical: Sequence[str] = CATEGORICAL,
        numeric: Sequence[str] = (),
        scale: bool = True,
        variant: str = "baseline",
        svd_components: int = 40,
        pca_variance: float = 0.95,
        reduce_all: bool = False,
        out: str = "features",
        index_limit: int = INDEX_LIMIT,
    ):
        super().__init__()
        if variant not in VARIANTS:
            raise ValueError(f"Unknown variant: {variant}")
        self.categorical = list(categorical)
        self.numeric = list(numeric)
        self.scale = scale
        self.variant = variant
        self.svd_components = svd_components
        self.pca_variance = pca_variance
        self.reduce_all = reduce_all
        self.out = out
        self.index_limit = index_limit

    def _fill_stage(self, df: DataFrame):
        found = medians(df, self.numeric) if self.numeric else {}
        # A column without any value carries nothing and is left out.
        fills = {c: v for c, v in found.items() if v is not None}
        stats = scale_stats(df, fills) if self.scale and fills else {c: (0.0, 1.0) for c in fills}
        exprs = []
        for c, v in fills.items():
            filled = f"coalesce(cast(`{c}` AS double), {_number(v)})"
            mean, dev = stats[c]
            if self.scale:
                filled = f"({filled} - {_number(mean)}) / {_number(dev)}"
            exprs.append(f"{filled} AS `{c}__z`")
        modes = {r["column"]: r for r in most_frequent(df, self.categorical).collect()} if self.categorical else {}
        for c, r in modes.items():
            exprs.append(f"coalesce(cast(`{c}` AS string), {_text(r['value'])}) AS `{c}__f`")
        statement = f"SELECT *, {', '.join(exprs)} FROM __THIS__"
        sizes = {c: modes[c]["n_values"] for c in self.categorical if c in modes}
        return SQLTransformer(statement=statement), list(fills), sizes

    def _fit(self, df: DataFrame) -> PipelineModel:
        fill, numeric, sizes = self._fill_stage(df)
        stages = [fill]
        data = fill.transform(df)
        spare = [f"{c}__z" for c in numeric] + [f"{c}__f" for c in sizes]

        def add(stage):
            nonlocal data
            stages.append(stage)
            data = stage.transform(data)

        listed = [c for c, n in sizes.items() if n <= self.index_limit]
        if listed:
            indexer = StringIndexer(
                inputCols=[f"{c}__f" for c in listed],
                outputCols=[f"{c}__i" for c in listed],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
            add(indexer.fit(data))
            encoder = OneHotEncoder(
                inputCols=[f"{c}__i" for c in listed], outputCols=[f"{c}__o" for c in listed], dropLast=True
            )
            add(encoder.fit(data))
            spare += [f"{c}__{k}" for c in listed for k in "io"]
        for c in sizes:
            if c not in listed:
                counts = data.groupBy(F.col(f"{c}__f").alias("value")).agg(F.count("*").alias("n"))
                add(CategoryEncoder(f"{c}__f", f"{c}__o", fit_dictionary(counts.where("value is not null"))))
                spare.append(f"{c}__o")
        branches = {"cat__v": [f"{c}__o" for c in sizes], "num__v": [f"{c}__z" for c in numeric]}
        reduced = {"svd_cat": ["cat__v"], "pca_num": ["num__v"], "both": ["cat__v", "num__v"]}.get(self.variant, [])
        # A branch that is reduced is a vector first; the others go into the joined vector as they are.
        parts = []
        for branch, columns in branches.items():
            if not columns:
                continue
            if branch not in reduced:
                parts += columns
                continue
            add(VectorAssembler(inputCols=columns, outputCol=branch))
            out = f"{branch[:3]}__r"
            if branch == "cat__v":
                add(fit_svd(data, branch, out, self.svd_components))
            else:
                add(fit_pca(data, branch, out, self.pca_variance))
            parts.append(out)
            spare += [branch, out]
        joined = "all__v" if self.reduce_all else self.out
        add(VectorAssembler(inputCols=parts, outputCol=joined))
        if self.reduce_all:
            add(fit_pca(data, "all__v", self.out, self.pca_variance))
            spare.append("all__v")
        quoted = ", ".join(f"`{c}`" for c in spare)
        add(SQLTransformer(statement=f"SELECT * EXCEPT ({quoted}) FROM __THIS__"))
        return PipelineModel(stages)


def make_preprocessor(
    variant: str,
    categorical: Sequence[str],
    numeric: Sequence[str],
    svd_components: int = 40,
    pca_variance: float = 0.95,
) -> PanelEncoder:
    """Preparation by name: baseline, pca_num, svd_cat or both."""
    return PanelEncoder(
        categorical, numeric, variant=variant, svd_components=svd_components, pca_variance=pca_variance
    )
