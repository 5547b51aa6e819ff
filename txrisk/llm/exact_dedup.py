"""Exact duplicates by content sort.

Sampled splitters cut the order of (text prefix, id) into ranges; one shuffle
deals the normalised texts to their ranges, an external sort puts equal texts
next to each other, and each text is compared whole with its neighbour. The
smallest id of a run stays.

A text with so many copies that splitters fall inside it lies in several
neighbouring ranges, so no task gets a whole hot group. Each range reduces
its part to one row; those few rows meet by SHA-256 and go back to the
ranges. Texts cross the network once.

Defined results: a null text counts as empty. Null ids sort last, and such a
row stays only if its group has no other. Of rows that repeat text and id,
one stays. Other columns do not matter and may have any name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import I64_MAX, I64_MIN, SPACE_CLASS, scratch_table, shuffle_partitions

PREFIX_CHARS = 64           # of a splitter; longer common beginnings are told apart by id, then by the sort
SAMPLES_PER_RANGE = 8
MOST_RANGES = 50_000        # bounds the splitters held by the driver; ranges grow beyond that


def normalised(text) -> F.Column:
    """``text`` (null: empty) with each run of white space replaced by one space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", " ")


def choose_splitters(keys: DataFrame, ranges: int, rows: int) -> list[tuple[str, int]]:
    """Cut points (prefix, id) for about ``ranges`` even ranges, from a bounded sample of ``keys``(p, i).

    A cut falls inside a prefix, at an id, only if the prefix holds more than
    a range's share; all other cuts are moved to where the prefix begins.
    """
    fraction = min(1.0, SAMPLES_PER_RANGE * ranges / max(rows, 1))
    sample = sorted((r.p, r.i) for r in keys.sample(False, fraction, 17).collect())
    cuts = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []
    seen: dict[str, int] = {}
    for prefix, _ in cuts:
        seen[prefix] = seen.get(prefix, 0) + 1
    return sorted({(p, i if seen[p] > 1 else I64_MIN) for p, i in cuts} | {(p, I64_MIN) for p, n in seen.items() if n > 1})


def _range_of(prefix, ident, cuts: list[tuple[str, int]]):
    """Number of cuts at or below (prefix, ident): a binary search over one literal array."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"p": p, "i": i} for p, i in cuts])), "array<struct<p:string,i:bigint>>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def step(at, s):
        cut = F.element_at(table, at + s)
        below = (cut["p"] < prefix) | ((cut["p"] == prefix) & (cut["i"] <= ident))
        return F.when((at + s <= len(cuts)) & below, at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and
    ``same_rows`` (rows with this text and id, this one included)."""
    spark = docs.sparkSession
    rows = docs.count()
    ranges = max(1, min(MOST_RANGES, 4 * shuffle_partitions(spark), rows // 32))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(I64_MAX)).alias("i"),
                         F.col(text_col).alias("t"))
    cuts = choose_splitters(narrow.select(F.left(normalised("t"), F.lit(PREFIX_CHARS)).alias("p"), "i"), ranges, rows)
    inside = sorted({p for p, i in cuts if i != I64_MIN})

    keyed = (narrow.select("doc_id", "i", normalised("t").alias("norm"))
             .withColumn("p", F.left("norm", F.lit(PREFIX_CHARS)))
             .withColumn("bucket", _range_of(F.col("p"), F.col("i"), cuts))
             .withColumn("split", F.col("p").isin(inside) if inside else F.lit(False))
             .drop("p"))
    order = Window.partitionBy("bucket").orderBy("norm", "i")
    before = F.lag("norm").over(order)
    runs = (keyed.withColumn("starts", F.when(before.isNull() | (before != F.col("norm")), 1).otherwise(0))
            .withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .select("doc_id", "i", "bucket", "run", "split", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")))
    run = Window.partitionBy("bucket", "run")
    placed = scratch_table(
        runs.withColumn("pos", F.row_number().over(run.orderBy("i")))
        .withColumn("run_size", F.count(F.lit(1)).over(run))
        .withColumn("run_min", F.min("doc_id").over(run))
        .withColumn("same_rows", F.count(F.lit(1)).over(Window.partitionBy("bucket", "run", "i"))),
        "content-runs")

    keep_id, size = F.col("run_min"), F.col("run_size")
    if inside:
        # one row per range of each text that a splitter may have cut; few, whatever the copies
        parts = placed.filter("split and pos = 1").select("bucket", "run", "text_sha256", "run_min", "run_size")
        whole = parts.groupBy("text_sha256").agg(F.min("run_min").alias("all_min"), F.sum("run_size").alias("all_size"))
        back = parts.join(whole, "text_sha256").select("bucket", "run", "all_min", "all_size")
        placed = placed.join(back, ["bucket", "run"], "left")
        size = F.coalesce("all_size", size)
        keep_id = F.when(F.col("all_size").isNotNull(), F.col("all_min")).otherwise(keep_id)
    kept = (F.col("pos") == 1) & F.col("run_min").eqNullSafe(keep_id)
    return placed.select("doc_id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"),
                         "text_sha256", F.col("same_rows").cast("long").alias("same_rows"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names."""
    keep = (content_groups(docs, id_col, text_col).filter("kept")
            .select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("sha"), F.col("same_rows").alias("same")))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"),
                        F.sha2(normalised(text_col).cast("binary"), 256).alias("key"))
    joined = keyed.join(keep, (F.col("key") == F.col("sha")) & F.col("id").eqNullSafe(F.col("keep_id")))
    out = joined.filter("same = 1")
    if not keep.filter("same > 1").isEmpty():
        out = out.unionByName(joined.filter("same > 1").dropDuplicates(["keep_id", "sha"]))
    return out.select("row.*")
