"""File sources and sinks with explicit schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators.aggregates import dataset_profile, head_rows
from txrisk.schemas import require_columns

__all__ = ["read_csv", "write_csv", "read_parquet", "write_parquet", "profile_csv"]


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string, named and ordered as in the file."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, reasons: str | None = None) -> DataFrame:
    """The columns of ``schema``, found by name in the file's header, in whatever order and among whatever others.

    A missing column is an error. So is a cell that cannot be cast, when it is
    read; with ``reasons``, such cells are NULL and that column lists them as
    ``column:type``, joined by ``;`` (empty for clean rows). Only the selected
    columns are parsed.
    """
    raw = read_text_csv(spark, path)
    require_columns(raw, schema.fieldNames(), "CSV file")
    cells, faults = [], []
    for f in schema.fields:
        value = F.col(f"`{f.name}`").try_cast(f.dataType)
        bad = F.col(f"`{f.name}`").isNotNull() & value.isNull()
        said = F.concat(F.lit(f"cannot read {f.name}: "), F.col(f"`{f.name}`"))
        cells.append((value if reasons else F.when(bad, F.raise_error(said)).otherwise(value)).cast(f.dataType).alias(f.name))
        faults.append(F.when(bad, F.lit(f"{f.name}:type")))
    return raw.select(*cells, *([F.concat_ws(";", *faults).alias(reasons)] if reasons else []))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def profile_csv(spark: SparkSession, path: str, order_by: list[str], n: int = 5, schema: T.StructType | None = None):
    """(profile DataFrame: rows, columns, NULLs per column; first n rows by an explicit order), over
    whatever columns the file has, as text unless ``schema`` types some."""
    df = read_csv(spark, path, schema) if schema is not None else read_text_csv(spark, path)
    return dataset_profile(df), head_rows(df, order_by, n)
