"""Per-key trailing time windows that split hot keys.

A window partitioned by the key alone puts every row of a key into one
task; a key holding a third of the data would then be one task. Instead
rows are placed in time buckets of width ``bucket_us`` and partitioned by
``(key, bucket)``. A row whose look-back range reaches into later buckets
is *also* emitted into them as a context row (one copy when the width is
at least the look-back; narrower buckets split bursts of a hot key at the
cost of more copies). Trailing frames evaluated inside a
``(key, bucket)`` partition then see exactly the rows they would see in
the whole key partition, and only primary rows are kept afterwards.

Quantities that look arbitrarily far back (previous row, running "any")
are completed from a per-``(key, bucket)`` summary, which has one row per
bucket and is tiny compared with the rows.

Windows that are long against the time in which a key may be hot are cut into
slices instead (second half of this module): a slice may be far narrower than
the window at a fixed cost of one copy of each row per window length, since
whole slices enter as mergeable moments (n, mean, M2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_tb"
EXACT = "decimal(38,10)"
PRIMARY = "_tb_primary"
DAY_US = 86_400_000_000


def explode_buckets(df: DataFrame, us: str, bucket_us: int, lookback_us: int) -> DataFrame:
    """Tag rows with their bucket and add context copies where needed.

    A row at ``us`` is needed by every bucket whose rows can look back to
    it: buckets ``b .. floor((us + lookback) / width)``. With a width of at
    least the look-back that is at most one copy; a narrower width (to
    split a hot key's burst) costs ``ceil(lookback / width)`` copies.
    """
    width = F.lit(bucket_us).cast("long")
    b = _floor_div(F.col(us), width)
    last = _floor_div(F.col(us) + F.lit(lookback_us).cast("long"), width)
    return (df.withColumn("_tb_home", b)
              .withColumn(BUCKET, F.explode(F.sequence(b, F.greatest(b, last))))
              .withColumn(PRIMARY, F.col(BUCKET) == F.col("_tb_home"))
              .drop("_tb_home"))


def _floor_div(a: Column, width: Column) -> Column:
    """Exact floor division on integers (also for instants before 1970)."""
    return _int_div(a - F.pmod(a, width), width)


def frame_by_time(key: str, us: str, lo: int, hi: int):
    """Range frame over microseconds, inside (key, bucket)."""
    return Window.partitionBy(key, BUCKET).orderBy(us).rangeBetween(lo, hi)


def frame_rows(key: str, order: list[str], lo, hi):
    return Window.partitionBy(key, BUCKET).orderBy(*order).rowsBetween(lo, hi)


def bucket_carry(df: DataFrame, key: str, us: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per (key, bucket) summary of primary rows plus what earlier buckets carry.

    Output: key, bucket, ``prev_last_us`` (latest instant in any earlier
    bucket) and for each ``extra`` boolean ``prev_any_<name>``.
    """
    extra = extra or {}
    aggs = [F.max(us).alias("_last_us")] + [F.max(c.cast("int")).alias(f"_any_{n}") for n, c in extra.items()]
    summary = df.filter(F.col(PRIMARY)).groupBy(key, BUCKET).agg(*aggs)
    earlier = Window.partitionBy(key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.col(key), F.col(BUCKET), F.max("_last_us").over(earlier).alias("prev_last_us")]
    cols += [F.coalesce(F.max(f"_any_{n}").over(earlier), F.lit(0)).alias(f"prev_any_{n}") for n in extra]
    return summary.select(*cols)


# ---- long windows in slices: rows meet only at the two edges of their frame ----

SLICE = "_slice"
KIND = "_kind"              # 0: a row in its own slice; i: its copy, moved on by the i-th window length
AT = "_at"


def slice_of(us: str, slice_us: int) -> Column:
    """The number of the slice that an instant lies in."""
    return _floor_div(F.col(us), F.lit(slice_us).cast("long"))


def slice_copies(df: DataFrame, us: str, slice_us: int, lengths_us: list[int], context: list[str]) -> DataFrame:
    """Each row in its slice, and once more per window length, moved on by that length.

    A frame ``(t - length, t]`` is the end of the slice that ``t - length``
    falls into, the whole slices between, and the own slice up to the row.
    When the slice width divides the length, the row moved on by the length
    lands in the slice of the frame's right edge, and belongs to the frame of
    exactly the rows before it. Copies keep only the columns ``context``.
    """
    if any(n % slice_us for n in lengths_us):
        raise ValueError("the slice width must divide every window length")
    home = slice_of(us, slice_us)
    copies = [F.struct(F.lit(i).alias("kind"), (home + F.lit(n // slice_us)).alias("slice"), (F.col(us) + F.lit(n)).alias("at"))
              for i, n in enumerate([0, *lengths_us])]
    own = F.col("_c.kind") == 0
    kept = [F.col(c) if c in context else F.when(own, F.col(c)).alias(c) for c in df.columns]
    return (df.withColumn("_c", F.explode(F.array(*copies)))
            .select(*kept, F.col("_c.kind").alias(KIND), F.col("_c.slice").alias(SLICE), F.col("_c.at").alias(AT)))


def _moments(v: Column, over) -> dict[str, Column]:
    """Count, mean and sum of squared deviations of the non-null ``v``, ready to be merged."""
    n = F.count(v).over(over)
    return {"n": n, "mean": F.avg(v).over(over), "m2": F.var_pop(v).over(over) * n}


def edge_moments(value: str, key: str, tiebreak: str, window: int) -> dict[str, dict[str, Column]]:
    """Inside (key, slice): ``left``, the copies of window number ``window`` after this row, and ``own``, the slice's rows
    up to this one (equal instants in the order of ``tiebreak``)."""
    part = Window.partitionBy(key, SLICE)
    after = part.orderBy(F.col(AT).desc()).rangeBetween(Window.unboundedPreceding, -1)       # a running frame from the slice's end
    upto = part.orderBy(AT, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    only = lambda kind: F.when(F.col(KIND) == kind, F.col(value))
    return {"left": _moments(only(window), after), "own": _moments(only(0), upto)}


def merge_moments(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Moments of two disjoint sets of rows (pairwise update: no difference of large sums)."""
    n = a["n"] + b["n"]
    delta = F.coalesce(b["mean"] - a["mean"], F.lit(0.0))
    mean = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + delta * b["n"] / n)
    cross = F.when((a["n"] > 0) & (b["n"] > 0), delta * delta * a["n"] * b["n"] / n).otherwise(0.0)
    return {"n": n, "mean": mean, "m2": F.coalesce(a["m2"], F.lit(0.0)) + F.coalesce(b["m2"], F.lit(0.0)) + cross}


def slice_sum(value: Column, key: str, slices: int, zero: Column) -> Column:
    """The sum over the ``slices - 1`` slices before each slice of the key."""
    if slices < 2:
        return zero
    between = Window.partitionBy(key).orderBy(SLICE).rangeBetween(-(slices - 1), -1)
    return F.coalesce(F.sum(value).over(between), zero)


def whole_slices(summary: DataFrame, key: str, slices: int, centre: str) -> dict[str, Column]:
    """Per (key, slice) of ``summary`` (``_n``, ``_mean``, ``_m2``): the moments of the ``slices - 1`` slices before it.
    Means are taken about ``centre``, the key's overall mean, so that no large squares cancel."""
    off = F.col("_mean") - F.col(centre)
    n = slice_sum(F.col("_n"), key, slices, F.lit(0).cast("long"))
    first = slice_sum(F.col("_n") * off, key, slices, F.lit(0.0))
    second = slice_sum(F.col("_m2") + F.col("_n") * off * off, key, slices, F.lit(0.0))
    some = F.when(n > 0, n)
    return {"n": n, "mean": F.col(centre) + first / some, "m2": F.greatest(second - first * first / some, F.lit(0.0))}


def half_up_mean(total: Column, n: Column, digits: int = 6) -> Column:
    """sum / n rounded half away from zero at ``digits`` in exact integer
    arithmetic (no float summation or double rounding), as double."""
    scaled = (total * F.lit(10 ** 10)).cast("decimal(38,0)")
    unit = (n.cast("decimal(38,0)") * F.lit(10 ** (10 - digits))).cast("decimal(38,0)")
    units = (F.abs(scaled) * 2 + unit).cast("decimal(38,0)")
    q = F.when(n > 0, F.signum(scaled) * _int_div(units, (unit * 2).cast("decimal(38,0)")))
    return q / F.lit(float(10 ** digits))


def _int_div(a: Column, b: Column) -> Column:
    """Integral division (SQL ``div``) of two exact decimals -> bigint."""
    return F.call_function("div", a, b)
