"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are put in a pseudo-random order (a hash of id and
seed) that is cut into blocks of about equal word counts' worth of hash
space. A source whose target is e whole passes plus a rest takes all its
blocks e times and, for the rest, the first blocks of the order; the last of
these is cut before the document that would exceed the target, and up to
FILLERS later documents that fit the gap best join it. A tree then halves the output shards again and again; each node
deals its exact per-source block quotas to its two halves by a multivariate
hypergeometric draw, so every shard gets an exact, disjoint, random share of
blocks. Inside a shard the documents are ordered by another hash.

Words are counted in one pass into a narrow table. Sources, blocks and
shards are bounded in number, so only their totals reach the driver, and the
block plan is broadcast; the plan shuffles and collects no document, whatever
the skew of the sources. Writing the mix shuffles the documents it takes.

Defined results: null and empty texts have size 0 and are taken with their
block; sources go by code point, null last; a source of size 0 takes 0. With
no words at all every target is 0. Rows that repeat an id share their fate.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import WORD, scratch_table

WEIGHTS = (5.0, 2.0, 1.0)    # by source order, repeating
MOST_PASSES = 3              # no target above so many times its source
BLOCK_WORDS = 200_000
MOST_BLOCKS = 1024           # per source; blocks grow beyond that
FINE = 4096                  # parts of a block in which its cut is sought
BLOCKS_PER_SHARD = 16
MOST_SHARDS = 4096
FILLERS = 4                  # documents per source that close the gap left by the cut


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_PASSES) -> list[float]:
    """Each source's share of all words by weight, stopped at ``most`` times its size; excess goes to the rest by weight."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        share = left / sum(weight[k] for k in open_)
        over = [k for k in sorted(open_) if share * weight[k] > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = share * weight[k]
            break
        for k in over:
            out[k] = float(most * sizes[k])
            left -= out[k]
            open_.remove(k)
    return out


def hypergeometric_split(quotas: list[int], take: int, rng: random.Random) -> list[int]:
    """How many of each colour are among ``take`` balls drawn without replacement from ``quotas``."""
    left, drawn = sum(quotas), []
    for q in quotas:
        left -= q
        got = 0
        low, high = max(0, take - left), min(q, take)
        if low == high:
            got = low
        else:
            # the chance of each count, from the one at `low` upwards by its ratio to the next, in logs
            logp = [math.lgamma(q + 1) - math.lgamma(k + 1) - math.lgamma(q - k + 1) + math.lgamma(left + 1)
                    - math.lgamma(take - k + 1) - math.lgamma(left - take + k + 1) for k in range(low, high + 1)]
            top = max(logp)
            got = rng.choices(range(low, high + 1), [math.exp(x - top) for x in logp])[0]
        drawn.append(got)
        take -= got
    return drawn


def split_tree(quotas: list[int], shards: int, rng: random.Random) -> list[list[int]]:
    """Per shard, its number of blocks of each source; columns add up to ``quotas`` exactly."""
    if shards == 1:
        return [quotas]
    half = shards // 2
    first = hypergeometric_split(quotas, sum(quotas) * half // shards, rng)
    return split_tree(first, half, rng) + split_tree([q - f for q, f in zip(quotas, first)], shards - half, rng)


def _order_hash(id_col: str, source: Column, seed: int) -> Column:
    """A place in [0, 2^48) of the source's pseudo-random order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), source), 16)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, ``draws`` and ``taken``.

    ``draws``: one (shard, place) per time the document is taken, at most
    MOST_PASSES; ``place`` orders a shard's documents. Reruns agree.
    """
    space = 1 << 48
    source = F.col(source_col).cast("string")
    sized = scratch_table(docs.select(
        F.col(id_col).alias("doc_id"), source.alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        _order_hash(id_col, source, seed).alias("h")), "sized")

    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    size = [r.size for r in totals]
    goal = targets(size)
    blocks = [max(1, min(MOST_BLOCKS, math.ceil(s / BLOCK_WORDS))) for s in size]

    # words per (source, block): bounded by sources x MOST_BLOCKS
    facts = _constants(sized.sparkSession, "k int, source string, blocks int",
                       [(k, r.source, blocks[k]) for k, r in enumerate(totals)])
    tagged = (sized.join(F.broadcast(facts), sized["source"].eqNullSafe(facts["source"])).drop(facts["source"])
              .withColumn("block", F.floor(F.col("h") * F.col("blocks") / space).cast("int")))
    per_block: dict[tuple[int, int], int] = {
        (r.k, r.block): r.words for r in tagged.groupBy("k", "block").agg(F.sum("size").alias("words")).collect()}

    passes, rest_blocks, wanted = [], [], []
    for k in range(len(size)):
        e = min(MOST_PASSES, int(goal[k] // size[k])) if size[k] else 0
        rest, b = goal[k] - e * size[k], 0
        while b < blocks[k] - 1 and per_block.get((k, b), 0) <= rest:
            rest -= per_block.get((k, b), 0)
            b += 1
        passes.append(e)
        rest_blocks.append(b if e < MOST_PASSES and size[k] else 0)
        wanted.append(rest if e < MOST_PASSES and size[k] else 0.0)
    cut, gap = _cut_places(tagged, [(k, rest_blocks[k], wanted[k]) for k in range(len(size))], space)
    fillers = _fillers(tagged, rest_blocks, cut, gap)

    # quotas count every pass's blocks and the cut block; the tree deals them out
    drawn = [passes[k] * blocks[k] + rest_blocks[k] + 1 for k in range(len(size))]
    shards = max(1, min(MOST_SHARDS, sum(drawn) // BLOCKS_PER_SHARD))
    rng = random.Random(seed)
    given = split_tree(drawn, shards, rng)
    plan = []
    for k in range(len(size)):
        deck = [shard for shard, row in enumerate(given) for _ in range(row[k])]
        rng.shuffle(deck)          # the blocks a shard draws are a random, disjoint subset
        for b in range(blocks[k]):
            of = [deck[p * blocks[k] + b] for p in range(passes[k])]
            extra = deck[passes[k] * blocks[k] + min(b, rest_blocks[k])]     # fillers go with the cut block
            limit = space if b < rest_blocks[k] else cut.get(k, 0) if b == rest_blocks[k] else 0
            plan.append((k, b, size[k], goal[k], of, extra, limit, fillers.get(k, [])))
    table = _constants(sized.sparkSession, "k int, block int, source_size bigint, target double, whole array<int>, extra int, "
                                           "below bigint, fillers array<bigint>", plan)
    joined = tagged.join(F.broadcast(table), ["k", "block"])
    again = (F.col("h") < F.col("below")) | F.array_contains("fillers", F.col("h"))
    shard = F.when(again, F.concat("whole", F.array("extra"))).otherwise(F.col("whole"))
    draws = F.transform(shard, lambda s, i: F.struct(s.alias("shard"), F.xxhash64(F.lit(seed + 1), "doc_id", i).alias("place")))
    return joined.select("doc_id", "source", "size", "source_size", "target", draws.alias("draws"),
                         (F.col("size") * F.size(shard)).cast("long").alias("taken"))


def _cut_places(tagged: DataFrame, cuts: list[tuple[int, int, float]], space: int) -> tuple[dict[int, int], dict[int, float]]:
    """Per source k, the place h below which documents of its cut block are taken without exceeding what is wanted,
    and the words then still missing. Sought among FINE parts of the block, then among one part's documents."""
    spark = tagged.sparkSession
    gap = {k: w for k, _, w in cuts if w > 0}
    place = {k: space for k in gap}
    asked = _constants(spark, "k int, block int, wanted double", [c for c in cuts if c[2] > 0])
    rows = tagged.join(F.broadcast(asked), ["k", "block"])
    within = (F.col("h") - F.col("block") * F.lit(float(space)) / F.col("blocks")) * F.col("blocks") / F.lit(float(space))
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.lit(FINE - 1), F.floor(within * FINE))).cast("int"))
    fine = rows.groupBy("k", "block", "wanted", "part").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    edge = (fine.withColumn("before", running - F.col("words"))
            .filter((F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted")))
            .select("k", "part", (F.col("wanted") - F.col("before")).alias("still")))
    found = edge.collect()     # at most one per source
    taken = {r.k: r.words for r in fine.groupBy("k").agg(F.sum("words").alias("words")).collect()}
    cut_in = {r.k: r.still for r in found}
    for k in gap:
        gap[k] = cut_in[k] if k in cut_in else gap[k] - taken.get(k, 0)
    if not found:
        return place, gap
    edges = _constants(spark, "k int, part int, still double", [tuple(r) for r in found])
    order = Window.partitionBy("k").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = (rows.join(F.broadcast(edges), ["k", "part"]).withColumn("upto", F.sum("size").over(order))
            .groupBy("k").agg(F.min(F.when(F.col("upto") > F.col("still"), F.col("h"))).alias("h"),
                              F.coalesce(F.max(F.when(F.col("upto") <= F.col("still"), F.col("upto"))), F.lit(0)).alias("words")))
    for r in over.collect():
        place[r.k], gap[r.k] = r.h, gap[r.k] - r.words
    return place, gap


def _fillers(tagged: DataFrame, rest_blocks: list[int], cut: dict[int, int], gap: dict[int, float]) -> dict[int, list[int]]:
    """Per source, the places of at most FILLERS documents behind the cut that bring it nearer to its target, best first."""
    spark, picked = tagged.sparkSession, {k: [] for k in gap}
    left = {k: w for k, w in gap.items() if w >= 0.5}
    for _ in range(FILLERS):
        if not left:
            break
        asked = _constants(spark, "k int, at int, below bigint, gap double, picked array<bigint>",
                           [(k, rest_blocks[k], cut[k], w, picked[k]) for k, w in left.items()])
        behind = (tagged.join(F.broadcast(asked), "k")
                  .filter((F.col("block") > F.col("at")) | (F.col("block") == F.col("at")) & (F.col("h") >= F.col("below")))
                  .filter(~F.array_contains("picked", F.col("h"))))
        # rows that repeat an id and source share a place and are taken together
        fits = behind.groupBy("k", "h", "gap").agg(F.sum("size").alias("words")).filter(F.abs(F.col("words") - F.col("gap")) < F.col("gap"))
        best = fits.groupBy("k").agg(F.min(F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), "h", "words")).alias("best"))
        found = {r.k: r.best for r in best.collect()}
        left = {k: w - found[k].words for k, w in left.items() if k in found}
        for k, b in found.items():
            picked[k].append(b.h)
        left = {k: w for k, w in left.items() if w >= 0.5}
    return picked


def taken_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """The mix itself: a row of ``docs`` per draw, with all its columns, shard after shard and each in the order of ``place``.

    Ranges of (shard, place) are the partitions, so a shard larger than a task is cut, in order."""
    plan = (mix(docs, id_col, text_col, source_col, seed).filter(F.size("draws") > 0)
            .select(F.col("doc_id").alias("taken_id"), F.col("source").alias("taken_source"), "draws").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("from"))
    joined = rows.join(plan, F.col("id").eqNullSafe(F.col("taken_id")) & F.col("from").eqNullSafe(F.col("taken_source")))
    drawn = joined.select("row", F.explode("draws").alias("draw"))
    return (drawn.repartitionByRange("draw.shard", "draw.place").sortWithinPartitions("draw.shard", "draw.place")
            .select("row.*"))


def _constants(spark, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table from values held by the driver."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>>")))
