"""Aggregations (A1-A10, O3, O6): one pass each, partial aggregation by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.quantiles import exact_median
from txrisk.schemas import TARGET_CANDIDATES


def class_means(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"),
                                 *[F.avg(c).alias(f"mean_{c}") for c in columns])


def positive_rate(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """negatives / positives; fails at run time when there is no positive."""
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    neg = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    weight = F.when(pos == 0, F.raise_error(F.lit("class weight: no row has the label 1"))) \
              .otherwise(neg.cast("double") / pos)
    return df.agg(pos.alias("positives"), neg.alias("negatives"), weight.alias("scale_pos_weight"))


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) with NULLs excluded, all columns in one pass."""
    kv = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                       for c in columns])).alias("_kv")).select("_kv.*")
    return kv.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


SKETCH_BUCKETS = 65_536
FIRST_BUCKETS = 16          # buckets per wanted value that the first count takes


def _named_values(df: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """(column, value, ``_b``) of the non-null values, ``_b`` a hash bucket."""
    kv = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                       for c in columns])).alias("_kv")).select("_kv.*").filter(F.col("value").isNotNull())
    return kv.withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))


def _count_within(named: DataFrame, chosen: list[tuple[str, int]], k: int) -> list:
    """The k most frequent values per column among those in the ``chosen`` (column, bucket) pairs, counted exactly."""
    if not chosen:
        return []
    wanted = named.sparkSession.createDataFrame(chosen, "column string, _b int")      # columns x buckets at most
    counts = (named.join(F.broadcast(wanted), ["column", "_b"], "left_semi")
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))
    first = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).collect()      # k rows per column


def topk_categories(df: DataFrame, columns: list[str], k: int, buckets: int = SKETCH_BUCKETS) -> DataFrame:
    """k most frequent values per column (column, value, count, rank); ties by value ascending.

    The values of a column may be as many as its rows, so they are not all
    counted. A first pass counts hash buckets: a value is at most as frequent
    as its bucket. The values of the fullest buckets are counted exactly, which
    gives the k-th count found. Only a bucket at least that full can hold a
    value that belongs among the k; if any such bucket was left out, all of them
    are counted in one more pass, and the result is complete. What is shuffled is
    a row per bucket and task, and the candidates.
    """
    named = _named_values(df, columns, buckets)
    full = named.groupBy("column", "_b").agg(F.count(F.lit(1)).alias("n")).toPandas()        # columns x buckets rows at most
    full = full.sort_values(["column", "n", "_b"], ascending=[True, False, True])
    chosen = full.groupby("column").head(FIRST_BUCKETS * k)
    rows = _count_within(named, list(zip(chosen["column"], chosen["_b"].tolist(), strict=True)), k)
    again = []
    for c, part in full.groupby("column"):
        found = [r["count"] for r in rows if r["column"] == c]
        least = min(found) if len(found) == k else 1
        if (part["n"].iloc[FIRST_BUCKETS * k:] >= least).any():
            again += [(c, b) for b in part["_b"][part["n"] >= least].tolist()]
    if again:
        redone = {c for c, _ in again}
        rows = [r for r in rows if r["column"] not in redone] + _count_within(named, again, k)
    return df.sparkSession.createDataFrame([(r["column"], r["value"], r["count"], r["rank"]) for r in rows],
                                           "column string, value string, count long, rank int")


def mode_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent non-null value per column, smallest value on ties."""
    top = topk_categories(df, columns, 1)
    return top.select("column", F.col("value").alias("mode"), "count")


def numeric_fit(df: DataFrame, columns: list[str], medians: DataFrame | None = None) -> DataFrame:
    """Per column: exact median, then mean and population std of the
    median-imputed column (the scaler is fitted after imputation).
    ``medians``: optional (column, median) table from a fitted imputer."""
    medians = medians if medians is not None else exact_median(df, columns)
    # mean/std after imputation, from the moments of the non-null part plus the
    # imputed copies of the median: one wide aggregate, its row cut by column
    cells = {c: F.col(c).cast("double") for c in columns}
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var")).alias(f"_{i}")
                                                      for i, v in enumerate(cells.values())])
    part = wide.select("_rows", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}.n").alias("_n"), F.col(f"_{i}.mean").alias("_mean"),
                                                            F.col(f"_{i}.var").alias("_var")) for i, c in enumerate(columns)])))
    j = part.join(medians, on="column", how="left")
    n, rows, m, var, med = F.col("_n"), F.col("_rows"), F.col("_mean"), F.col("_var"), F.col("median")
    k = rows - n  # imputed cells
    mean_all = F.when(n == rows, m).otherwise((m * n + med * k) / rows)
    m2 = var * n + (m - med) * (m - med) * n * k / rows
    var_all = F.when(n == rows, var).otherwise(m2 / rows)
    return j.select("column", "median", mean_all.alias("mean"), F.sqrt(F.greatest(var_all, F.lit(0.0))).alias("std"))


def resolve_target(columns: list[str], candidates=TARGET_CANDIDATES) -> str:
    for c in candidates:
        if c in columns:
            return c
    raise ValueError(f"no target column: none of {', '.join(candidates)} is there")


def target_check(df: DataFrame, candidates=TARGET_CANDIDATES) -> DataFrame:
    """Resolve the target column and check it is binary (bool or {0,1})."""
    name = resolve_target(df.columns, candidates)
    y = F.col(name).cast("int") if dict(df.dtypes)[name] == "boolean" else F.col(name)
    bad = F.sum(F.when(~y.isin(0, 1) | y.isNull(), 1).otherwise(0))
    return df.agg(F.lit(name).alias("target_column"), F.count(F.lit(1)).alias("n_rows"),
                  F.sum(F.when(y == 1, 1).otherwise(0)).alias("positives"),
                  F.sum(F.when(y == 0, 1).otherwise(0)).alias("negatives"),
                  bad.alias("invalid"), (bad == 0).alias("is_binary"))


def require_binary(df: DataFrame, label: str) -> DataFrame:
    """Pass-through that fails at run time when a label is not 0/1."""
    y = F.col(label)
    return df.withColumn(label, F.when(y.isin(0, 1), y.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit(f"label '{label}' takes 0 and 1 only, not "), y.cast("string")))))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, columns and NULL count per column in one aggregate, unpivoted."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(f"_null_{i}") for i, c in enumerate(cols)])
    items = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                               F.col(f"_null_{i}").alias("null_count")) for i, c in enumerate(cols)])
    return agg.select(F.col("_rows").alias("n_rows"), F.lit(len(cols)).alias("n_columns"),
                      F.explode(items).alias("_c")).select("_c.position", "_c.column_name", "_c.null_count",
                                                            "n_rows", "n_columns")


def head_rows(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First n rows under an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)
