"""Evaluation jobs (M12, P8/P9, P12, F19-F24): messages -> one row per message.

A message is validated, its features are computed, the model scores and
explains it, and the policy grades it. Rejected messages stay in the result
with their reasons, so valid and rejected rows come out of one pass: nothing
is cached and nothing is read twice; write the result partitioned by
``is_valid`` or filter it. Two layouts are known: transfer requests
(:func:`judge_requests`) and the strict legacy payload
(:func:`judge_payloads`).

``model`` is a fitted pipeline or its tables (:class:`TreeModel`), which need
no Python. The explanation carries score and ids along: no join back.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions import scalars as S
from txrisk.ml.explain import explain, importances
from txrisk.ml.train import score
from txrisk.ml.tree_tables import TreeModel, with_contributions
from txrisk.operators.legacy import legacy_features
from txrisk.operators.topk import as_map, top_abs
from txrisk.operators.transfer import checked_timestamp, transfer_features
from txrisk.operators.validation import strict_payload, validate_requests, with_outcome
from txrisk.session import prepare

_NO_TOP = "array<struct<feature:string,value:double>>"


def _scored(model: PipelineModel | TreeModel, feats: DataFrame, names: list[str], keys: list[str],
            with_explanation: bool | str, digits: int | None = 4) -> DataFrame:
    """keys + ``risk_score`` + ``top`` (array<struct<feature, value>>)."""
    if isinstance(model, TreeModel):
        out = with_contributions(feats, model, model.values(feats))
        top = top_abs(F.col("contribs"), digits=digits) if with_explanation else F.lit(None).cast(_NO_TOP)
        return out.select(*keys, F.col("probability").alias("risk_score"), top.alias("top"))
    scored = score(model, feats)
    if with_explanation == "importances":
        return scored.select(*keys, "risk_score", importances(model, names).alias("top"))
    if with_explanation:
        return explain(model, scored, names, [*keys, "risk_score"]).select(*keys, "risk_score", "top")
    return scored.select(*keys, "risk_score", F.lit(None).cast(_NO_TOP).alias("top"))


def _decision(transaction_id: Column, top: Column, evaluated_at: Column | None) -> list[Column]:
    sc = F.col("risk_score")
    ts = evaluated_at if evaluated_at is not None else S.iso_utc(F.current_timestamp())
    return [transaction_id.alias("transactionId"), S.rounded_score(sc).alias("riskScore"), S.risk_level(sc).alias("riskLevel"),
            S.recommended_action(sc).alias("recommendedAction"), ts.alias("evaluatedAt"), as_map(top).alias("featureImportance")]


def evaluate(model: PipelineModel | TreeModel, requests: DataFrame, names: list[str], *, with_explanation: bool | str = True,
             evaluated_at: Column | None = None, keys: tuple[str, ...] = ("transaction_id",)) -> DataFrame:
    """Typed, valid requests -> decisions. ``with_explanation``: True = per-row contributions, "importances" =
    the model's top positive global importances (fallback), False = none."""
    prepare(requests.sparkSession)
    feats = transfer_features(requests, zero_mode="nonpositive", keep=keys)
    out = _scored(model, feats, names, list(keys), with_explanation)
    return out.select(*keys, *_decision(F.col("transaction_id"), F.col("top"), evaluated_at))


def _with_time_reason(validated: DataFrame) -> DataFrame:
    """Validation accepts any text as a time; one that cannot be parsed is a reason too, so it does not fail the job."""
    bad = (F.col("errors") == "") & checked_timestamp(validated, "timestamp", "keep").isNull()
    return (validated.withColumn("errors", F.when(bad, F.lit("timestamp:invalid")).otherwise(F.col("errors")))
            .withColumn("is_valid", F.col("errors") == ""))


def judge_requests(model: PipelineModel | TreeModel, messages: DataFrame, names: list[str], *, value: str = "value",
                   keep: tuple[str, ...] = (), with_explanation: bool | str = True, evaluated_at: Column | None = None) -> DataFrame:
    """One row per message: ``keep``, ``is_valid``, ``errors`` and the decision, which is null where the message is rejected."""
    prepare(messages.sparkSession)
    checked = _with_time_reason(validate_requests(messages.select(*keep, value), value))
    told = ["is_valid", "errors", "transaction_id"]
    feats = transfer_features(checked, zero_mode="nonpositive", on_invalid="keep", keep=[*keep, *told])
    out = _scored(model, feats, names, [*keep, *told], with_explanation)
    valid = F.col("is_valid")
    decision = _decision(F.col("transaction_id"), F.col("top"), evaluated_at)
    fields = dict(zip(RESULT_FIELDS, decision, strict=True))
    return out.select(*keep, "is_valid", "errors", *[F.when(valid, c).alias(n) for n, c in fields.items()])


def judge_payloads(model: PipelineModel | TreeModel, messages: DataFrame, names: list[str], *, value: str = "value",
                   keep: tuple[str, ...] = (), with_explanation: bool | str = True) -> DataFrame:
    """Strict legacy payloads: ``keep``, ``is_valid``, ``errors``, ``anomaly_score``, ``is_flagged`` and ``explain`` (feature ->
    contribution, unrounded, by falling size); null where the payload is rejected."""
    prepare(messages.sparkSession)
    checked = _with_time_reason(strict_payload(messages.select(*keep, value), value))
    told = ["is_valid", "errors"]
    feats = legacy_features(checked, on_invalid="keep", keep=(*keep, *told))
    out = _scored(model, feats, names, [*keep, *told], with_explanation, digits=None)
    valid = F.col("is_valid")
    return out.select(*keep, *told, F.when(valid, F.col("risk_score")).alias("anomaly_score"),
                      F.when(valid, S.is_flagged(F.col("risk_score"))).alias("is_flagged"),
                      F.when(valid, as_map(F.col("top"))).alias("explain"))


def valid_results(judged: DataFrame) -> DataFrame:
    """The rows with a decision."""
    return with_outcome(judged, True).drop("is_valid", "errors")


RESULT_FIELDS = ["transactionId", "riskScore", "riskLevel", "recommendedAction", "evaluatedAt", "featureImportance"]


def result_json(results: DataFrame) -> DataFrame:
    """key / value columns ready for a message sink (camelCase JSON)."""
    return results.select(F.col("transactionId").alias("key"),
                          F.to_json(F.struct(*RESULT_FIELDS)).alias("value"))
