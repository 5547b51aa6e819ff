"""Offline jobs as file-to-file Spark plans.

Each job is one lazy plan ending in a write (or a small fitted artefact);
nothing passes through the driver except the model and its metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.ml import train as TN
from txrisk.operators.legacy import legacy_training_table, load_transfer_dataset, subset_rename
from txrisk.schemas import L1_RAW, SUBSET_RENAME, TRANSFER_FEATURE_COLUMNS
from txrisk.session import prepare
from txrisk.sources.io import profile_csv, read_csv, write_csv, write_parquet
from pyspark.sql import types as T


def subset_schema() -> T.StructType:
    """L2: the L1 fields that the subset keeps, under their snake_case names."""
    return T.StructType([T.StructField(SUBSET_RENAME[f.name], f.dataType) for f in L1_RAW.fields
                         if f.name in SUBSET_RENAME])


def subset_job(spark: SparkSession, src_csv: str, dst_csv: str) -> None:
    """Raw CSV -> 13 renamed columns -> CSV (the scan reads only those columns)."""
    prepare(spark)
    kept = T.StructType([f for f in L1_RAW.fields if f.name in SUBSET_RENAME])
    write_csv(subset_rename(read_csv(spark, src_csv, kept)), dst_csv)


def build_train_set_job(spark: SparkSession, subset_csv: str, out_parquet: str) -> None:
    """Subset CSV -> legacy feature table with ``is_fraud`` -> Parquet."""
    prepare(spark)
    write_parquet(legacy_training_table(read_csv(spark, subset_csv, subset_schema())), out_parquet)


def summarize_job(spark: SparkSession, raw_csv: str, n: int = 5):
    """(profile DataFrame, first n rows by User_ID, Timestamp)."""
    prepare(spark)
    return profile_csv(spark, raw_csv, ["User_ID", "Timestamp"], n)


def train_transfer_job(spark: SparkSession, data: DataFrame, model_path: str, profile: str = "transfer",
                       id_col: str | None = None) -> dict:
    """Either training layout -> split, fit, hold-out metrics -> saved model.
    The row id is ``id_col``, or the column named Transaction_ID in any case,
    or else a hash of the row. Returns the metrics as a dict (one row)."""
    prepare(spark)
    if id_col is None:
        id_col = next((c for c in data.columns if c.lower() == "transaction_id"), None)
    if id_col is None:
        id_col = "_row_id"
        data = data.withColumn(id_col, F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in data.columns]))))
    table = load_transfer_dataset(data, row_id=id_col, keep=(id_col,))
    model, metrics, _ = TN.train_and_evaluate(table, TRANSFER_FEATURE_COLUMNS, id_col, profile)
    TN.save(model, model_path)
    return metrics.first().asDict()


def train_legacy_job(spark: SparkSession, features_parquet: str, model_path: str, profile: str = "legacy",
                     id_col: str | None = None) -> dict:
    """Legacy feature table (L3) -> target resolved (is_fraud / fraud_label /
    target) and checked binary -> split, fit (Top-30 categories), metrics -> saved model."""
    from txrisk.operators.aggregates import require_binary, resolve_target
    from txrisk.schemas import LEGACY_FEATURE_COLUMNS, require_columns
    prepare(spark)
    df = spark.read.parquet(features_parquet)
    target = resolve_target(df.columns)
    require_columns(df, LEGACY_FEATURE_COLUMNS, "processed dataset")
    if dict(df.dtypes)[target] == "boolean":
        df = df.withColumn(target, F.col(target).cast("int"))
    table = require_binary(df, target).withColumnRenamed(target, "label")
    if id_col is None:
        id_col = "_row_id"
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in LEGACY_FEATURE_COLUMNS])
        table = table.withColumn(id_col, F.md5(key))  # content hash: rerun-stable split key
    model, metrics, _ = TN.train_and_evaluate(table, LEGACY_FEATURE_COLUMNS, id_col, profile)
    TN.save(model, model_path)
    return metrics.first().asDict()
