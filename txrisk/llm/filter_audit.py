"""Interaction audit of document filters by the Hart-Mas-Colell potential.

Filters are players of a removal game: ``v(S)`` is the number of documents
that fail at least one filter of the coalition S. All that any order of the
filters removes follows from ``v`` over the 2^m coalitions: the step that
adds filter i to the coalition S removes ``v(S + i) - v(S)``. The potential is

    P(empty) = 0,   P(S) = (v(S) + sum over i in S of P(S - i)) / |S|

and the Shapley value of i is ``P(all) - P(all - i)``. It is computed here
times m!, which keeps every step of the recursion a whole number and makes
the difference the filter's removals summed over all m! orders.

One pass measures the texts and writes narrow facts (part, failures, digest)
to the shared folder. Copies meet by SHA-256 of the whole text; a group of
any size is reduced before each shuffle to a row per part, so the largest
group of copies costs no task more than the number of parts. What remains is
a count per (part, set of failed filters): at most 2^m rows per part.

Defined results: a null text counts as empty, a null part as ''. An empty
table gives no rows. Rows that repeat an id count each; rows of one id and
text are not copies of each other, and a row without an id is neither a copy
nor an original. Labels that repeat an id count once: quality 1 or toxic 1 in
any of them holds. Texts may have any length. Other columns do not matter and
may have any name.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import scratch_table, word_array

# The contract's filters. E, "a copy of an earlier text", is the one that needs the whole table.
FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
SIGNS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column, n_words: Column, n_distinct: Column) -> list[Column]:
    """The conditions under which a document fails the filters A, B, C and D."""
    length = F.char_length(text)
    capitals = length - F.char_length(F.translate(text, CAPITALS, ""))
    return [n_words < LEAST_WORDS, 100 * n_distinct < LEAST_DISTINCT_PERCENT * n_words,
            100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * length.cast("long"), text.rlike(SIGNS)]


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A narrow row per document: ``doc_id``, ``part``, ``mask`` (bit i: fails the i-th text filter) and the text's ``digest``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = (narrow.withColumn("words", word_array("text"))
               .select("doc_id", "part", "text", F.size("words").cast("long").alias("n"),
                       F.size(F.array_distinct("words")).cast("long").alias("d")))
    failed = text_failures(F.col("text"), F.col("n"), F.col("d"))
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)), F.lit(0))
    return scratch_table(counted.select("doc_id", "part", mask.cast("int").alias("mask"),
                                        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "filter-facts")


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per labelled id: ``good`` and ``toxic`` as 0 or 1."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return (labels.select(F.col(id_col).alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
            .groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic")))


def failure_counts(measured: DataFrame, flags: DataFrame, copy_bit: int) -> DataFrame:
    """Documents by (part, mask), the copy filter's bit included: ``n``, ``good`` and ``toxic``.

    The text filters depend on the text alone, so ``mask`` goes with ``digest``.
    """
    key = ["digest", "mask", "part"]
    by_id = (measured.groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("n"))
             .join(flags, "doc_id", "left")
             .select("doc_id", *key, "n", *[(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]))
    sums = ["n", "good", "toxic"]
    # the rows of the smallest id come along as a struct; each (id, part, text) is one row here
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *sums)))
    loose = [F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"loose_{c}") for c in sums]
    by_part = by_id.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], first.alias("first"), *loose)
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))        # a row per part of a text
    own = by_part.withColumn("is_first", F.coalesce(F.col("first.doc_id") == smallest, F.lit(False)))
    stay = [(F.when(F.col("is_first"), F.col(f"first.{c}")).otherwise(0) + F.col(f"loose_{c}")) for c in sums]
    both = F.array(F.struct(F.col("mask"), *[s.alias(c) for s, c in zip(stay, sums, strict=True)]),
                   F.struct((F.col("mask") + copy_bit).alias("mask"), *[(F.col(c) - s).alias(c) for s, c in zip(stay, sums, strict=True)]))
    return (own.select("part", F.explode(both).alias("x")).groupBy("part", "x.mask")
            .agg(*[F.sum(f"x.{c}").alias(c) for c in sums]).filter("n > 0"))


def removal_games(counts: DataFrame, m: int) -> DataFrame:
    """Per part: ``total`` and the games ``removed``, ``good`` and ``toxic``, arrays over the 2^m coalitions (bit i: filter i plays)."""
    rows = counts.groupBy("part").agg(F.sum("n").alias("total"),
                                      F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))   # 2^m rows at most

    def game(column):
        value = lambda s: F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + F.when(
            r["mask"].bitwiseAND(s) != 0, r[column]).otherwise(0))
        return F.transform(F.sequence(F.lit(0), F.lit(2**m - 1)), value)

    return rows.select("part", "total", game("n").alias("removed"), game("good").alias("good"), game("toxic").alias("toxic"))


def potentials(game: Column, m: int) -> Column:
    """The potential of every coalition times m!, as an array; a coalition follows all those it contains."""
    def add(p, s):
        rest = sum((F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(p, s - (1 << i))).otherwise(F.lit(0)) for i in range(m)), F.lit(0))
        whole = F.call_function("div", F.get(game, s) * math.factorial(m) + rest, F.bit_count(s))
        return F.concat(p, F.array(whole))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2**m - 1)), F.array(F.lit(0).cast("long")), add)


def _steps(names: str) -> list[dict]:
    """Every order of the filters and each of its steps, with the coalitions before and after it."""
    out = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append({"o": "".join(names[j] for j in order), "s": step, "b": before, "a": before | 1 << i})
            before |= 1 << i
    return out


def audit(games: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, from the games alone."""
    m = len(names)
    grand = 2**m - 1
    steps = F.from_json(F.lit(json.dumps(_steps(names))), "array<struct<o:string,s:int,b:int,a:int>>")
    rows = (games.withColumn("potential", potentials(F.col("removed"), m))
            .select("*", F.explode(steps).alias("x")))
    here = lambda g: F.get(F.col(g), F.col("x.a")) - F.get(F.col(g), F.col("x.b"))
    bit = F.col("x.a") - F.col("x.b")
    without = F.lit(grand) - bit
    return rows.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
        (F.col("total") - F.get("removed", F.col("x.a"))).alias("kept"), here("removed").alias("removed"),
        (F.get("removed", bit) - here("removed")).alias("redundant"),
        (F.get("removed", F.lit(grand)) - F.get("removed", without)).alias("unique_fails"),
        here("good").alias("good_lost"), here("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(grand)) - F.get("potential", without)).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the five filters over ``docs``; ``labels`` has ``id_col``, ``quality`` and ``toxic``."""
    counts = failure_counts(facts(docs, id_col, text_col, part_col), label_flags(labels, id_col), 1 << FILTERS.index("E"))
    return audit(removal_games(counts, len(FILTERS)))
