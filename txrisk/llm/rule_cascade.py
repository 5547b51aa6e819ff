"""Quality rules as a short-circuit cascade.

Each rule rejects documents by a condition over per-document measures. A
bounded sample gives every rule's cost (time over the sample) and selectivity
(share it rejects). The rules then run in descending order of rejections per
cost inside one CASE, which stops at the first rule that rejects. The order
changes the work, never the verdict: a document stays if no rule rejects it.
Everything is a projection: no shuffle, no Python.

Defined results: null or blank text has no words, and all measures are 0.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import SPACE_CLASS, WORD, free_name

SAMPLE_ROWS = 2000          # about so many rows estimate cost and selectivity
SYMBOLS = "[#*$%&|<>]+"     # fixed by the contract
_POS_BITS = 20              # a window's place, packed below 44 bits of its hash


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean Column over the measures and, if the rule needs it, the text."""

    name: str
    rejects: Column


def default_rules(text_col: str = "text") -> list[Rule]:
    """Thresholds after published web-corpus heuristics (word length, symbols, repeated lines and words)."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    text = F.col(text_col)
    letters = F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{L}+", ""))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}+", ""))
    bangs = F.char_length(text) - F.char_length(F.replace(text, F.lit("!!"), F.lit("")))
    return [
        Rule("word_length", ~(F.col("word_chars") / words).between(2.0, 12.0)),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("duplicate_lines", F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        Rule("repeated_words", F.col("n_repeat_words") * 10 > F.col("n_words") * 3),
        Rule("shouting", (bangs * 5 > F.col("n_words")) | (capitals * 2 > letters)),
        Rule("few_letters", letters * 10 < F.col("word_chars") * 5),
    ]


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside some 3-word window that occurs twice or more; ``words`` must be a plain column.

    Windows become longs (44 hash bits, place) and are sorted; equal
    neighbours are repeats. Should two different windows share a hash, or a
    text exceed the places, the same is done with the windows themselves.
    """
    places = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    low, high = (1 << _POS_BITS) - 1, ~((1 << _POS_BITS) - 1)

    def at(i, k=0):
        return F.get(words, (i + k).cast("int"))

    def place(x):
        return x.bitwiseAND(F.lit(low))

    def hashed(x):
        return x.bitwiseAND(F.lit(high))

    def twins(keys, of):
        return F.filter(keys, lambda x, j: of(F.get(keys, j - 1)).eqNullSafe(of(x)) | of(F.get(keys, j + 1)).eqNullSafe(of(x)))

    def covered(positions):
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).cast("long").alias("last"))
        return F.aggregate(F.sort_array(positions), start, lambda a, p: F.struct(
            (a["total"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("total"), p.alias("last")), lambda a: a["total"])

    def collides(s):
        """Whether two places with one hash hold different words."""
        def differ(i, j):
            return (at(i) != at(j)) | (at(i, 1) != at(j, 1)) | (at(i, 2) != at(j, 2))
        return F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda j: F.coalesce(
            (hashed(F.get(s, j)) == hashed(F.get(s, j - 1))) & differ(place(F.get(s, j)), place(F.get(s, j - 1))), F.lit(False)))

    windows = F.sort_array(F.transform(places, lambda i: F.struct(
        F.concat_ws(" ", at(i), at(i, 1), at(i, 2)).alias("w"), i.cast("long").alias("i"))))
    slow = _bind(windows, lambda e: covered(F.transform(twins(e, lambda x: x["w"]), lambda x: x["i"])))
    packed = F.sort_array(F.transform(places, lambda i: hashed(F.xxhash64(at(i), at(i, 1), at(i, 2))).bitwiseOR(i.cast("long"))))
    fast = _bind(packed, lambda keys: _bind(twins(keys, hashed), lambda s: F.when(F.size(s) == 0, F.lit(0).cast("long"))
                 .when(collides(s), slow).otherwise(covered(F.transform(s, place)))))
    return F.when(n < 3, F.lit(0).cast("long")).when(n > low, slow).otherwise(fast)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    Columns of ``docs`` with these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    words_at, lines_at = free_name(docs, "__words"), free_name(docs, "__lines")
    base = docs.drop(*names).withColumn(words_at, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    base = base.withColumns({
        "n_words": F.size(words_at).cast("long"),
        "word_chars": F.char_length(F.array_join(words_at, "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        lines_at: lines,
    })
    # after the words, so that no expression computes them again
    return base.withColumns({
        "n_lines": F.size(lines_at).cast("long"),
        "n_dup_lines": (F.size(lines_at) - F.size(F.array_distinct(lines_at))).cast("long"),
        "n_repeat_words": _repeat_words(F.col(words_at), F.col("n_words").cast("int")),
    }).drop(words_at, lines_at)


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """``rules`` by rejections per cost on ``sample`` (a measured one); equal ones by name."""
    sample = sample.persist()
    try:
        flags = [F.coalesce(r.rejects, F.lit(False)).cast("int") for r in rules]
        share = sample.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"s{k}") for k, f in enumerate(flags)]).first()

        def seconds(df: DataFrame) -> float:
            began = time.perf_counter()
            df.collect()
            return time.perf_counter() - began

        seconds(sample.agg(F.count(F.lit(1))))
        empty = seconds(sample.agg(F.count(F.lit(1))))
        cost = [max(seconds(sample.agg(F.sum(f))) - empty, 1e-3) for f in flags]
    finally:
        sample.unpersist()
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-share[k] / cost[k], rules[k].name))]


def cascade(measured: DataFrame, rules: list[Rule], sample: DataFrame) -> DataFrame:
    """``measured`` with ``rejected_by``: the first rule, in the order estimated on ``sample``, that rejects the row
    (null: it stays)."""
    verdict = None
    for rule in order_rules(sample, rules):
        hit = F.coalesce(rule.rejects, F.lit(False))
        verdict = F.when(hit, rule.name) if verdict is None else verdict.when(hit, rule.name)
    return measured.withColumn("rejected_by", verdict if verdict is not None else F.lit(None).cast("string"))


def judge(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``rejected_by`` and ``kept``."""
    # sampled before it is measured: only the sample's texts are
    sample = measures(docs.sample(False, min(1.0, SAMPLE_ROWS / max(docs.count(), 1)), 5), text_col)
    measured = measures(docs, text_col).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    judged = cascade(measured, default_rules(text_col) if rules is None else rules, sample)
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
