"""URL allow and block rules by hashed expressions.

Every URL is expanded into the host-suffix and path-prefix expressions that
some rule could equal (the label counts and path lengths that occur among
the rules). Expressions meet the rules in an equi-join on a 4-byte prefix of
their SHA-256; the full digest then confirms the match and precedence picks
one rule: the longest, then the longer host, then block before allow.

URLs are first reduced to distinct (host, path) pairs, so a URL that fills a
third of the table is expanded once. The rules are broadcast only when their
counted number is small; otherwise the join is an ordinary shuffle join.

Defined results: a null URL or one without ``://`` has empty host and path
and gets the default verdict, as does any URL that no rule fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import free_name

BROADCAST_RULES = 100_000   # more rules than this are joined by shuffle


def rules_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a DataFrame, for short lists; long ones are read from storage."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"))
                     for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # the zero byte keeps host and path apart
    return F.unhex(F.sha2(F.concat(host.cast("binary"), F.lit(b"\x00"), path.cast("binary")), 256))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names are replaced); one row per row.

    ``rules``: verdict (allow or block), rule_host, rule_path.
    """
    known = (rules.select("verdict", "rule_host", "rule_path").distinct()
             .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
             .withColumn("short", F.substring("digest", 1, 4)))
    labels = F.size(F.split("rule_host", r"\."))
    size = rules.agg(F.count(F.lit(1)).alias("n"),
                     F.collect_set(F.struct(labels.alias("labels"), F.char_length("rule_path").alias("chars"))).alias("shapes")).first()

    url = F.col(url_col)
    named = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(url), "path": path_of(url)})
    if size.n == 0:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = named.select("host", "path").filter("host != ''").distinct()

    # (label count, path length) pairs that rules have; a URL with too few labels or too short a path fits none
    shapes = F.array(*[F.struct(F.lit(s.labels).alias("labels"), F.lit(s.chars).alias("chars")) for s in sorted(size.shapes)])
    expanded = (keys.withColumn("parts", F.split("host", r"\.")).withColumn("shape", F.explode(shapes))
                .filter((F.size("parts") >= F.col("shape.labels")) & (F.char_length("path") >= F.col("shape.chars")))
                .select("host", "path",
                        _digest(F.array_join(F.slice("parts", F.size("parts") - F.col("shape.labels") + 1, F.col("shape.labels")), "."),
                                F.left("path", F.col("shape.chars"))).alias("full"))
                .withColumn("short", F.substring("full", 1, 4)))
    if size.n <= BROADCAST_RULES:
        known = F.broadcast(known)
    hits = expanded.join(known, "short").filter(F.col("full") == F.col("digest"))
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.char_length(rule).alias("chars"), F.char_length("rule_host").alias("host_chars"),
                    (F.col("verdict") == "block").alias("blocks"), rule.alias("rule"), F.col("verdict").alias("verdict"))
    found = free_name(named, "best")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias(found))
    return (named.join(best, ["host", "path"], "left")
            .select(*[c for c in named.columns if c not in ("host", "path")], "host", "path",
                    F.col(found)["rule"].alias("rule"), F.coalesce(F.col(found)["verdict"], F.lit(default)).alias("verdict")))
