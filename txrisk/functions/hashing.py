"""Deterministic hash helpers usable in Spark and reproducible in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(text: Column) -> Column:
    """First 8 hex digits of md5(text) as a non-negative bigint (0 .. 2^32-1)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def u01(text: Column) -> Column:
    """Uniform value in [0, 1) derived from md5(text)."""
    return hash32(text) / F.lit(4294967296.0)
