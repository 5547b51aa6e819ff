"""Per-user behaviour features.

Output = input columns plus
  amount_zscore        (amount - user mean) / user sample std, 0 when undefined
  user_mean_30d        mean of amounts in (t - 30 d, t]
  user_std_30d         sample std there, NULL for fewer than two values
  txn_count_7d         non-null amounts in (t - 7 d, t]
  hours_since_last_tx  hours since the user's previous row, -1 for the first

Equal instants are ordered by ``tiebreak`` (the input position in the
reference); a tied row only sees peers up to itself.

Plan: rows are cut into (user, time slice) and copied once per window length,
to the slices where they leave a frame; one shuffle on that key, however long
the windows are. Whole slices in between come from a table with one row per
(user, slice), joined back on the same key. A user with any share of the rows
is spread over as many tasks as slices it is active in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.scalars import nan_to_null, parse_timestamp, to_micros
from txrisk.operators import timeframes as tf
from txrisk.schemas import require_columns

DEFAULT_MEAN_DAYS = 30
DEFAULT_COUNT_DAYS = 7


def _checked_ts(df: DataFrame, timestamp: str, on_invalid: str):
    ts = parse_timestamp(F.col(timestamp), df.schema[timestamp].dataType)
    if on_invalid == "fail":
        return F.when(ts.isNull(), F.raise_error(F.lit("behaviour input: a time cannot be read"))).otherwise(ts)
    if on_invalid == "keep":
        return ts
    raise ValueError("on_invalid must be 'fail' or 'keep'")


def behavior_features(df: DataFrame, user: str = "user_id", amount: str = "amount",
                      timestamp: str = "timestamp", tiebreak: str | None = None,
                      mean_days: int = DEFAULT_MEAN_DAYS, count_days: int = DEFAULT_COUNT_DAYS,
                      slice_hours: float = 24, on_invalid: str = "fail",
                      keep_sums: bool = False) -> DataFrame:
    """``slice_hours``: width of a time slice, the unit of work of one user; it must divide both windows. ``keep_sums``
    adds the exact sum and the count behind the mean."""
    require_columns(df, [user, amount, timestamp], "behaviour input")
    if tiebreak is None:
        # input position of the scan; pass an explicit column for reruns
        tiebreak = "_position"
        df = df.withColumn(tiebreak, F.monotonically_increasing_id())
    # a NULL user has no group (pandas drops it and the reference then fails): refuse it
    df = df.withColumn(user, F.when(F.col(user).isNull(),
                                    F.raise_error(F.lit("user id contains NULL values"))).otherwise(F.col(user)))
    src = (df.withColumn("_amt", nan_to_null(F.col(amount).cast("double")))
             .withColumn("_us", to_micros(_checked_ts(df, timestamp, on_invalid))))
    if keep_sums:
        src = src.withColumn("_exact", F.col("_amt").cast(tf.EXACT))

    width = int(slice_hours * tf.DAY_US // 24)
    lengths = [mean_days * tf.DAY_US, count_days * tf.DAY_US]
    context = [user, "_amt"] + (["_exact"] if keep_sums else [])
    rows = tf.slice_copies(src, "_us", width, lengths, context)
    part = Window.partitionBy(user, tf.SLICE)
    before = part.orderBy(tf.AT, tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    mean_edges = tf.edge_moments("_amt", user, tiebreak, 1)
    count_edges = tf.edge_moments("_amt", user, tiebreak, 2)
    cells = {"_ln": mean_edges["left"]["n"], "_lmean": mean_edges["left"]["mean"], "_lm2": mean_edges["left"]["m2"],
             "_on": mean_edges["own"]["n"], "_omean": mean_edges["own"]["mean"], "_om2": mean_edges["own"]["m2"],
             "_l7": count_edges["left"]["n"], "_prev_us": F.max(F.when(F.col(tf.KIND) == 0, F.col(tf.AT))).over(before)}
    if keep_sums:
        exact = lambda kind, over: F.coalesce(F.sum(F.when(F.col(tf.KIND) == kind, F.col("_exact"))).over(over), F.lit(0).cast(tf.EXACT))
        cells["_edge_sum"] = (exact(1, part.orderBy(F.col(tf.AT).desc()).rangeBetween(Window.unboundedPreceding, -1))
                              + exact(0, part.orderBy(tf.AT, tiebreak).rowsBetween(Window.unboundedPreceding, 0))).cast(tf.EXACT)
    at_edges = rows.select("*", *[c.alias(n) for n, c in cells.items()]).filter(F.col(tf.KIND) == 0)

    # one row per (user, slice), with what the slices before it hold
    user_stats = src.groupBy(F.col(user).alias("_u")).agg(F.avg("_amt").alias("_u_mean"), F.stddev_samp("_amt").alias("_u_std"))
    summary = (src.withColumn(tf.SLICE, tf.slice_of("_us", width)).groupBy(user, tf.SLICE)
               .agg(F.count("_amt").alias("_n"), F.avg("_amt").alias("_mean"), (F.var_pop("_amt") * F.count("_amt")).alias("_m2"),
                    F.max("_us").alias("_last_us"), *([F.sum("_exact").alias("_sum")] if keep_sums else []))
               .join(user_stats, F.col(user) == F.col("_u")).drop("_u"))
    between = tf.whole_slices(summary, user, lengths[0] // width, "_u_mean")
    earlier = Window.partitionBy(user).orderBy(tf.SLICE).rowsBetween(Window.unboundedPreceding, -1)
    mids = {"_mn": between["n"], "_mmean": between["mean"], "_mm2": between["m2"],
            "_m7": tf.slice_sum(F.col("_n"), user, lengths[1] // width, F.lit(0).cast("long")),
            "_carry_us": F.max("_last_us").over(earlier)}
    if keep_sums:
        mids["_mid_sum"] = tf.slice_sum(F.col("_sum"), user, lengths[0] // width, F.lit(0).cast(tf.EXACT)).cast(tf.EXACT)
    carried = summary.select(F.col(user).alias("_su"), F.col(tf.SLICE).alias("_ss"), "_u_mean", "_u_std", *[c.alias(n) for n, c in mids.items()])

    out = at_edges.join(carried, (F.col(user) == F.col("_su")) & (F.col(tf.SLICE) == F.col("_ss")))
    known = lambda x: {"n": F.col(f"_{x}n"), "mean": F.col(f"_{x}mean"), "m2": F.col(f"_{x}m2")}
    window = tf.merge_moments(tf.merge_moments(known("l"), known("m")), known("o"))
    out = out.withColumns({"user_n_30d": window["n"], "user_mean_30d": window["mean"], "_m2": window["m2"],
                           "txn_count_7d": F.col("_l7") + F.col("_m7") + F.col("_on")})
    out = out.withColumn("user_std_30d", F.when(F.col("user_n_30d") > 1, F.sqrt(F.greatest(F.col("_m2"), F.lit(0.0)) / (F.col("user_n_30d") - 1))))
    if keep_sums:
        out = out.withColumn("user_sum_30d", (F.col("_edge_sum") + F.col("_mid_sum")).cast(tf.EXACT))
    z = (F.col("_amt") - F.col("_u_mean")) / F.when(F.col("_u_std") != 0, F.col("_u_std"))
    gap = F.col("_us") - F.coalesce(F.col("_prev_us"), F.col("_carry_us"))
    out = (out.withColumn("amount_zscore", F.coalesce(z, F.lit(0.0)))
              .withColumn("hours_since_last_tx", F.coalesce(gap / F.lit(3.6e9), F.lit(-1.0))))
    keep = [c for c in df.columns] + ["amount_zscore", "user_mean_30d", "user_std_30d",
                                      "txn_count_7d", "hours_since_last_tx"]
    if keep_sums:  # exact window sum and count behind user_mean_30d
        keep += ["user_sum_30d", "user_n_30d"]
    return out.select(*keep)
