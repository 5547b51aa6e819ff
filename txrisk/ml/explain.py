"""Per-row feature contributions of a boosted tree model.

Exact path-dependent Shapley values on the margin scale (bias + sum =
margin), from the tree tables that the pipeline carries
(:mod:`txrisk.ml.tree_tables`). Small models are explained inside the row by
array functions; larger ones in Arrow batches over broadcast arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.ml import tree_tables as TT
from txrisk.operators.topk import top_abs, top_positive


def gbt_stage(model: PipelineModel) -> GBTClassificationModel:
    return [s for s in model.stages if isinstance(s, GBTClassificationModel)][-1]


def tree_model(model: PipelineModel | TT.TreeModel, names: list[str], spark) -> TT.TreeModel:
    """The model's tables: as given, from the pipeline's stage, or flattened now (a pipeline fitted elsewhere)."""
    if isinstance(model, TT.TreeModel):
        return model
    stored = [s for s in model.stages if isinstance(s, TT.TreeArrays)]
    return stored[-1].model() if stored else TT.from_gbt(gbt_stage(model), names, spark)


def explain(model: PipelineModel | TT.TreeModel, scored: DataFrame, names: list[str], keys: list[str], top_k: int = 5,
            features_col: str = "features", in_plan: bool | None = None) -> DataFrame:
    """keys + ``bias`` + ``margin_sum`` + ``top`` (array<struct<feature, value>>, |value| desc,
    then feature position, rounded to 4 digits). ``features_col``: a vector or an array of doubles."""
    trees = tree_model(model, names, scored.sparkSession)
    is_array = isinstance(scored.schema[features_col].dataType, T.ArrayType)
    values = F.col(features_col) if is_array else vector_to_array(F.col(features_col))
    if in_plan is None:
        in_plan = TT.cells(trees) <= TT.PLAN_CELLS
    if in_plan:
        out = TT.with_contributions(scored.select(*keys, values.alias("_values")), trees, F.col("_values"))
        return out.select(*keys, "bias", F.col("margin").alias("margin_sum"), top_abs(F.col("contribs"), top_k).alias("top"))
    return _explain_in_batches(trees, scored.select(*keys, values.alias("_x")), names, keys, top_k)


def _explain_in_batches(trees: TT.TreeModel, source: DataFrame, names: list[str], keys: list[str], top_k: int) -> DataFrame:
    tables = source.sparkSession.sparkContext.broadcast(TT.games(trees))       # bounded by the model
    n = len(names)
    schema = T.StructType([source.schema[k] for k in keys] + [
        T.StructField("bias", T.DoubleType()), T.StructField("margin_sum", T.DoubleType()),
        T.StructField("top", T.ArrayType(T.StructType([T.StructField("feature", T.StringType()),
                                                       T.StructField("value", T.DoubleType())])))])

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            phi, bias = TT.contributions(np.vstack(pdf["_x"].to_numpy()).astype(float), tables.value, n)
            order = np.lexsort((np.broadcast_to(np.arange(n), phi.shape), -np.abs(phi)), axis=1)[:, :top_k]
            out = pdf[keys].copy()
            out["bias"] = bias
            out["margin_sum"] = bias + phi.sum(axis=1)
            out["top"] = [[{"feature": names[i], "value": round(float(p[i]), 4)} for i in o] for p, o in zip(phi, order, strict=True)]
            yield out

    return source.mapInPandas(run, schema)


def importances(model: PipelineModel, names: list[str], top_k: int = 5) -> Column:
    """Fallback explanation as a constant array: top positive split-gain importances."""
    gains = gbt_stage(model).featureImportances.toArray()
    every = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(float(g)).alias("value")) for n, g in zip(names, gains, strict=False)])
    return top_positive(every, top_k)


def global_importances(model: PipelineModel, names: list[str], top_k: int = 5) -> list[tuple[str, float]]:
    """The same as a list, for a report."""
    gains = gbt_stage(model).featureImportances.toArray()
    order = np.argsort(-gains, kind="stable")[:top_k]
    return [(names[i], round(float(gains[i]), 4)) for i in order if gains[i] > 0]
