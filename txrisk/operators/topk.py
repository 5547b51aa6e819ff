"""Per-row top contributions (O4, O5, F21, F23): array work inside a row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_abs(arr: Column, k: int = 5, digits: int | None = 4) -> Column:
    """Top k (feature, value) structs by |value| desc, then position asc; values rounded to ``digits`` (None: as they are)."""
    shown = (lambda v: v) if digits is None else (lambda v: F.round(v, digits))
    keyed = F.transform(arr, lambda x, i: F.struct((-F.abs(x["value"])).alias("k"), i.alias("i"),
                                                   x["feature"].alias("feature"), x["value"].alias("value")))
    return F.transform(F.slice(F.sort_array(keyed), 1, k),
                       lambda x: F.struct(x["feature"].alias("feature"), shown(x["value"]).alias("value")))


def top_positive(arr: Column, k: int = 5, digits: int | None = 4) -> Column:
    """Fallback explanation: top k strictly positive values (global importances)."""
    return top_abs(F.filter(arr, lambda x: x["value"] > 0), k, digits)


def as_map(top: Column) -> Column:
    return F.map_from_entries(top)


def explode_ranked(df: DataFrame, top: str, keys: list[str], outer: bool = False) -> DataFrame:
    """One row per (keys, rank): ``inline`` of rank-tagged structs; ``outer`` keeps rows without any."""
    ranked = F.transform(F.col(top), lambda x, i: F.struct((i + 1).alias("rank"), x["feature"].alias("feature"),
                                                           x["value"].alias("contribution")))
    return df.select(*keys, F.inline_outer(ranked) if outer else F.inline(ranked))
