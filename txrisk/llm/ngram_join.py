"""N-gram Jaccard join with signature trees: groups of documents linked by word-shingle similarity.

1. Sets. One pass hashes each text's shingles to 64 bits and keeps the set's
   size, digest, a token bitmap (one to two bits per shingle) and the
   first hashes that a similar set must share one of (a prefix filter,
   lossless in any order of all hashes). The order is by hash, but shingles
   that are common in a sample of the documents come last: a line that many
   documents repeat would else put them all into one block. Equal sets become
   one class; only its representative goes on.
2. Blocks. Classes sharing a prefix hash form a block, which is parted where
   set sizes jump too far for a link; blocks with the same members are merged
   and members alone are dropped. A block is cut into chunks of bounded size
   and one bitmap width, ordered by set size, and every size-compatible pair of chunks is one unit of work.
   Small units are worked off many at a time, every pair of each; the others by trees.
3. Trees. A unit builds a signature tree per chunk: nodes hold the OR of
   their bitmaps, their range of set sizes, their bitmap slack and, once
   known, their common component. Dual traversal drops node pairs whose
   greatest possible overlap is too small, whose sizes cannot agree, or that
   are connected already. A first traversal looks only for each member's
   likeliest partners; the second, after these links are known, covers every
   pair that is not yet connected. So a family of copies costs about its
   size, not its square, and no connection between texts is lost.
4. Exact check. Likely pairs are compared shingle by shingle. The second
   traversal's surviving pairs are not handed out but which members they join:
   such a family is a block of its own, to whose units the whole sets travel. A
   unit compares its pairs and hands out the links that connect anything new,
   fewer than it has members. So pairs of a large family, whose number is a
   square, are never rows of a table. Links are joined into components by
   rounds in which every edge goes to both its nodes.

Defined results: texts without words, or null, have an empty set and are
linked with nothing; with fewer words than a shingle the whole sequence is
one. Repeated rows are members of one class. Null ids take part; a group's
id is its smallest id that is not null. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import scratch_table, ship_package, small_arrow_batches, without_shuffle_files, worker_cache

SHINGLE = 4
PERCENT = 85
CHUNK = 2048                # members of a block that one unit of work holds, twice at most
CHUNK_BITS = 21             # a chunk holds about 2^21 shingles at most, so fewer long sets
MATRIX = 64 << 20           # bytes of a unit's table of shared shingles; larger units compare set by set
PAIRS_AT_ONCE = 1 << 17
LEAF, FAN = 16, 8           # documents per leaf and children per node of a tree
SMALL_UNIT = 64             # members of a unit whose pairs are all compared, without a tree
COMMON = 8                  # sampled documents with a shingle that goes to the end of the order
SAMPLE_ROWS, SAMPLE_SHARE = 10_000, 1 / 64      # documents that show which shingles are common, at least; only the work depends on them
MOST_COMMON = 200_000
BROADCAST_IDS = 500_000     # more ids than this are joined by shuffle
_MEMO = 500_000

# Odd multipliers that mix word hashes into a shingle hash.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes (as signed) of UTF-8 text, A-Z lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.int64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64).view(np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - size + 1, dtype=np.uint64)
        for k in range(size):
            out = (out ^ h[k:len(h) - size + 1 + k]) * _MIX[k % len(_MIX)]
            out ^= out >> np.uint64(29)
        out *= _MIX[0]
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many smallest shingles two sets of the asked similarity must share one of."""
    return n - -(-percent * n // 100) + 1


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def prefix(s: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of the sorted set ``s`` in the order that puts ``common`` ones (sorted) last; two similar sets share one."""
    length = prefix_length(len(s), percent)
    head = s[:2 * length]
    rare = head[~_in(head, common)]
    if len(rare) < length:
        last = _in(s, common)
        rare = np.concatenate([s[~last], s[last]])
    return rare[:length]


def bitmap(s: np.ndarray) -> np.ndarray:
    """1 to 2 bits per shingle, a power of two and 64 at least, as 64-bit words."""
    bits = max(64, 1 << int(len(s) - 1).bit_length())
    out = np.zeros(bits, dtype=bool)
    out[(s.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as it would be with fewer bits: halves OR-ed together."""
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] | b[..., half:]
    return b


def _common_shingles(docs: DataFrame, size: int, percent: int) -> np.ndarray:
    """Shingles that COMMON or more sampled documents have, sorted. Only those whose hash is small enough for a prefix are counted."""
    share = max(SAMPLE_ROWS / max(docs.count(), 1), SAMPLE_SHARE)
    sampled = docs.filter(F.pmod(F.xxhash64("i", "h"), F.lit(1 << 20)) < F.lit(min(1.0, share) * (1 << 20)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("ngram_join")
        hashes = _WordHashes()
        for frame in frames:
            sets = [shingle_set(t, hashes, size) for t in frame["t"]]
            token, c = np.unique(np.concatenate([np.zeros(0, np.int64), *(s[:2 * prefix_length(len(s), percent)] for s in sets)]), return_counts=True)
            yield pd.DataFrame({"token": token, "c": c})

    found = (sampled.select("t").mapInPandas(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
             .filter(F.col("c") >= COMMON).orderBy(F.desc("c"), "token").limit(MOST_COMMON).select("token"))
    return np.sort(np.array([r.token for r in found.collect()], dtype=np.int64))


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, size, percent))      # MOST_COMMON numbers at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("ngram_join")
        hashes = _WordHashes()
        for frame in frames:
            out = []
            for i, h, text in zip(frame["i"], frame["h"], frame["t"]):
                s = shingle_set(text, hashes, size)
                if len(s):
                    out.append((i, h, len(s), xxhash.xxh128_digest(s.tobytes()), prefix(s, shared.value, percent), bitmap(s).tobytes()))
                else:
                    out.append((i, h, 0, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "text_hash", "n", "digest", "prefix", "bits"])

    made = docs.mapInPandas(run, "doc_id string, text_hash long, n long, digest binary, prefix array<long>, bits binary")
    return scratch_table(made.withColumn("uid", F.monotonically_increasing_id()), "shingle-sets")


# --- signature trees ---

class Tree:
    """Levels of nodes over members ordered by set size, leaves first; members are level 0."""

    def __init__(self, n: np.ndarray, bits: list[np.ndarray], comp: np.ndarray):
        words = min(len(b) for b in bits)
        self.n, self.comp = n, comp
        self.own = np.stack([fold(b, words) for b in bits])
        ones = np.bitwise_count(self.own).sum(axis=1).astype(np.int64)
        # slack: shingles that a bitmap cannot tell apart
        self.levels = [(self.own, n, n, n - ones, comp, None)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            union, low, high, slack, c, _ = self.levels[-1]
            starts = np.arange(0, len(union), fan)
            same = np.maximum.reduceat(c, starts) == np.minimum.reduceat(c, starts)
            self.levels.append((np.bitwise_or.reduceat(union, starts, axis=0), np.minimum.reduceat(low, starts),
                                np.maximum.reduceat(high, starts), np.maximum.reduceat(slack, starts),
                                np.where(same, np.maximum.reduceat(c, starts), -1), fan))
            fan = FAN


def _possible(a, i, b, j, percent: int) -> np.ndarray:
    """For node pairs (i of level a, j of level b): whether some two members may be similar enough and are not yet connected."""
    words = min(a[0].shape[1], b[0].shape[1])
    common = np.bitwise_count(fold(a[0], words)[i] & fold(b[0], words)[j]).sum(axis=1).astype(np.int64)
    # slack grows where bits were folded away
    fold_a = a[3] + (np.bitwise_count(a[0]).sum(axis=1).astype(np.int64) - np.bitwise_count(fold(a[0], words)).sum(axis=1).astype(np.int64))
    fold_b = b[3] + (np.bitwise_count(b[0]).sum(axis=1).astype(np.int64) - np.bitwise_count(fold(b[0], words)).sum(axis=1).astype(np.int64))
    most = np.minimum(common + np.minimum(fold_a[i], fold_b[j]), np.minimum(a[2][i], b[2][j]))
    need = -(-percent * (a[1][i] + b[1][j]) // (100 + percent))        # overlap that the smallest members would need
    sizes = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    apart = (a[4][i] < 0) | (a[4][i] != b[4][j])
    return sizes & (most >= need) & apart


def dual_traverse(a: Tree, b: Tree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Member pairs (index in a, index in b) that survive every node's bound; of one tree with itself, i < j."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        parts = [_possible(a.levels[la], i[s:s + PAIRS_AT_ONCE], b.levels[lb], j[s:s + PAIRS_AT_ONCE], percent)
                 for s in range(0, len(i), PAIRS_AT_ONCE)]
        ok = np.concatenate(parts) if parts else np.zeros(0, dtype=bool)
        i, j = i[ok], j[ok]
        if not len(i) or la == lb == 0:
            return i, j
        # open the higher level, or both
        if la >= lb:
            i, j = _open(a, la, i, j)
            la -= 1
            opened_both = lb == la + 1
        else:
            opened_both = False
        if lb > la or opened_both:
            j, i = _open(b, lb, j, i)
            lb -= 1
        if a is b and la == lb:
            keep = i <= j if la else i < j
            i, j = i[keep], j[keep]


def _open(t: Tree, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace node i by its children, repeating j."""
    fan, below = t.levels[level][5], len(t.levels[level - 1][0])
    kids = i[:, None] * fan + np.arange(fan)
    inside = kids < below
    return kids[inside], np.repeat(j, fan).reshape(-1, fan)[inside]


def likely_partners(a: Tree, b: Tree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs worth checking first: neighbours in the leaves' order, each leaf's members with its first, first leaves across."""
    if a is b:
        k = np.arange(1, len(a.n))
        i = np.concatenate([k - 1, k // LEAF * LEAF, np.zeros_like(k)])
        j = np.concatenate([k, k, k])
    else:
        i = np.concatenate([np.arange(0, len(a.n)), np.zeros(len(b.n), dtype=np.int64)])
        j = np.concatenate([np.zeros(len(a.n), dtype=np.int64), np.arange(0, len(b.n))])
    ok = i != j if a is b else np.ones(len(i), dtype=bool)
    ok[ok] = _possible(a.levels[0], i[ok], b.levels[0], j[ok], percent)
    return i[ok], j[ok]


def _overlaps(sets: list[np.ndarray]):
    """A function of index arrays (i, j): how many elements each two sets share."""
    values, seen = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[seen > 1]
    words = max(1, -(-len(shared) // 64))
    if len(sets) * words * 8 > MATRIX:
        return lambda i, j: np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], dtype=np.int64)
    table = np.zeros((len(sets), words), dtype=np.uint64)
    for k, s in enumerate(sets):
        own = np.zeros(words * 64, dtype=bool)
        own[np.searchsorted(shared, np.intersect1d(s, shared, assume_unique=True))] = True
        table[k] = np.packbits(own, bitorder="little").view(np.uint64)
    step = max(1, (1 << 22) // words)

    def counts(i, j):
        return np.concatenate([np.bitwise_count(table[i[s:s + step]] & table[j[s:s + step]]).sum(axis=1, dtype=np.int64)
                               for s in range(0, len(i), step)])

    return counts


def connecting_links(sets: list[np.ndarray], comp: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Of the pairs (i, j), likeliest first, links that connect what neither ``comp`` nor an earlier one connects: a spanning forest."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    overlaps = _overlaps(sets)
    place = np.unique(comp, return_inverse=True)[1].reshape(-1)
    root = np.arange(place.max() + 1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.argsort(np.abs(n[i] - n[j]), kind="stable")
    i, j = i[order], j[order]
    out, at, step = [], 0, 1024
    while at < len(i):
        x, y = i[at:at + step], j[at:at + step]
        at, step = at + step, min(2 * step, PAIRS_AT_ONCE)
        now = np.array([find(k) for k in range(len(root))])
        apart = now[place[x]] != now[place[y]]
        x, y = x[apart], y[apart]
        if not len(x):
            continue
        common = overlaps(x, y)
        linked = 100 * common >= percent * (n[x] + n[y] - common)
        for a, b in zip(x[linked].tolist(), y[linked].tolist()):
            ra, rb = find(place[a]), find(place[b])
            if ra != rb:
                root[rb] = ra
                out.append((a, b))
    return out


_UNIT = ["block", "c1", "c2"]


def _per_unit(rows: DataFrame, work, schema: str, many=None) -> DataFrame:
    """``work(left, right)`` for every unit; ``right`` is None for a chunk with itself. rows: block, c1, c2, side, rep, n, comp and more.
    With ``many``, units of up to SMALL_UNIT rows go there together: ``many(rows, unit)``, ``unit`` numbering each row's, ascending."""
    def each(frame: pd.DataFrame) -> pd.DataFrame | None:
        left = frame[frame["side"] == 0]
        right = frame[frame["side"] == 1]
        return work(left, right if len(right) else None) if len(left) else None

    def whole(frame: pd.DataFrame, starts: np.ndarray) -> list[pd.DataFrame]:
        sizes = np.diff(starts, append=len(frame))
        small = sizes <= (SMALL_UNIT if many else 0)
        found = [each(frame.iloc[s:s + k]) for s, k in zip(starts[~small].tolist(), sizes[~small].tolist())]
        if small.any():
            of = np.repeat(np.arange(len(starts)), sizes)
            mine = small[of]
            found.append(many(frame[mine], of[mine]))
        return [f for f in found if f is not None and len(f)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("ngram_join")
        held: list[pd.DataFrame] = []       # of the unit that the next frame may go on with
        key = None
        out, size = [], 0

        def take(frame, starts):
            nonlocal size
            found = whole(frame, starts)
            out.extend(found)
            size += sum(map(len, found))

        for frame in frames:
            if not len(frame):
                continue
            keys = frame[_UNIT].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if held and (keys[0] != key).any():
                take(pd.concat(held), np.zeros(1, dtype=np.int64))
                held.clear()
            key = keys[-1]
            if len(cuts):
                ended = pd.concat([*held, frame.iloc[:cuts[-1]]])
                take(ended, np.concatenate([[0], cuts[:-1] + (len(ended) - cuts[-1])]))
                held.clear()
            held.append(frame.iloc[cuts[-1] if len(cuts) else 0:])
            if size >= 100_000:
                yield pd.concat(out)
                out.clear()
                size = 0
        if held:
            take(pd.concat(held), np.zeros(1, dtype=np.int64))
        if out:
            yield pd.concat(out)

    return rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "side", "n", "rep").mapInPandas(run, schema)


def possible_pairs(rows: pd.DataFrame, unit: np.ndarray, percent: int = PERCENT, likely: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """What ``dual_traverse`` (or ``likely_partners``) gives unit by unit, as row numbers, for many small units at once."""
    n, comp, side = rows["n"].to_numpy(), rows["comp"].to_numpy(), rows["side"].to_numpy()
    first = np.searchsorted(unit, unit)
    crossed = side[np.searchsorted(unit, unit, side="right") - 1] == 1        # the unit has two chunks
    k = np.arange(len(rows))
    pos = k - first
    lefts = np.bincount(unit, weights=side == 0)[unit].astype(np.int64)
    pos = np.where(side == 1, pos - lefts, pos)
    found = []
    for d in range(1, int(np.bincount(unit).max(initial=1))):
        i, j = k[:-d], k[d:]
        ok = (unit[i] == unit[j]) & (~crossed[i] | (side[i] != side[j])) & ((comp[i] < 0) | (comp[i] != comp[j]))
        ok &= (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
        if likely:
            ok &= (pos[i] == 0) | np.where(crossed[i], pos[j] == 0, (d == 1) | (pos[i] == pos[j] // LEAF * LEAF))
        found.append((i[ok], j[ok]))
    if not found:
        return k[:0], k[:0]
    i, j = (np.concatenate(x) for x in zip(*found))
    bits = [np.frombuffer(x, dtype=np.uint64) for x in rows["bits"]]
    words = np.array([len(x) for x in bits])
    width, most = np.minimum(words[i], words[j]), np.zeros(len(i), dtype=np.int64)
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        used, place = np.unique(np.concatenate([i[of], j[of]]), return_inverse=True)
        own = np.stack([fold(bits[x], w) for x in used])
        slack = n[used] - np.bitwise_count(own).sum(axis=1, dtype=np.int64)
        x, y = place[:len(of)], place[len(of):]
        step = max(1, (1 << 20) // int(w))
        for s in range(0, len(of), step):
            a, b = x[s:s + step], y[s:s + step]
            most[of[s:s + step]] = np.bitwise_count(own[a] & own[b]).sum(axis=1, dtype=np.int64) + np.minimum(slack[a], slack[b])
    most = np.minimum(most, np.minimum(n[i], n[j]))
    ok = most >= -(-percent * (n[i] + n[j]) // (100 + percent))
    return i[ok], j[ok]


def _tree(members: pd.DataFrame, bits: list[np.ndarray]) -> Tree:
    return Tree(members["n"].to_numpy(), bits, members["comp"].to_numpy())


def _bitmap_tree(members: pd.DataFrame) -> Tree:
    return _tree(members, [np.frombuffer(x, dtype=np.uint64) for x in members["bits"]])


def _likely_pairs(units: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b, gap in size) worth checking first. Bitmaps travel once, to their units."""
    def work(left, right):
        ta = _bitmap_tree(left)
        i, j = likely_partners(ta, ta if right is None else _bitmap_tree(right), percent)
        other = left if right is None else right
        x, y = left["rep"].to_numpy()[i], other["rep"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "gap": np.abs(left["n"].to_numpy()[i] - other["n"].to_numpy()[j])})

    def many(rows, unit):
        i, j = possible_pairs(rows, unit, percent, likely=True)
        rep, n = rows["rep"].to_numpy(), rows["n"].to_numpy()
        return pd.DataFrame({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j]), "gap": np.abs(n[i] - n[j])})

    return _per_unit(units.join(bits, "rep"), work, "a long, b long, gap long", many).groupBy("a", "b").agg(F.min("gap").alias("gap"))


def forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest one that the pairs (i, j) connect it with."""
    low = np.arange(size)
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            return low


def _possible_families(units: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b), fewer than a unit's members, that join every pair which the bitmaps do not rule out."""
    def work(left, right):
        ta = _bitmap_tree(left)
        i, j = dual_traverse(ta, ta if right is None else _bitmap_tree(right), percent)
        rep = left["rep"].to_numpy() if right is None else np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()])
        low = forest(len(rep), i, j if right is None else j + len(left))
        joined = np.flatnonzero(low != np.arange(len(rep)))
        return pd.DataFrame({"a": rep[low[joined]], "b": rep[joined]})

    def many(rows, unit):
        rep = rows["rep"].to_numpy()
        low = forest(len(rep), *possible_pairs(rows, unit, percent))
        joined = np.flatnonzero(low != np.arange(len(rep)))
        return pd.DataFrame({"a": rep[low[joined]], "b": rep[joined]})

    return _per_unit(units.join(bits, "rep"), work, "a long, b long", many).distinct()


def _unit_links(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect members of a unit not yet connected, by their whole sets."""
    def work(left, right):
        both = left if right is None else pd.concat([left, right])
        held = [np.asarray(x, dtype=np.int64) for x in both["s"]]
        maps = [bitmap(x) for x in held]
        ta = _tree(left, maps[:len(left)])
        i, j = dual_traverse(ta, ta if right is None else _tree(right, maps[len(left):]), percent)
        links = connecting_links(held, both["comp"].to_numpy(), i, j if right is None else j + len(left), percent)
        rep = both["rep"].to_numpy()
        return pd.DataFrame([(min(rep[x], rep[y]), max(rep[x], rep[y])) for x, y in links], columns=["a", "b"], dtype=np.int64)

    return _per_unit(units.join(sets, "rep"), work, "a long, b long").distinct()


def _units(blocks: DataFrame, percent: int) -> DataFrame:
    """Each member row once per unit of its block: pairs of chunks whose set sizes may agree."""
    # one bitmap width per chunk, so that a small set does not coarsen the others' bitmaps
    width = F.greatest(F.lit(6), F.length(F.bin(F.col("n") - 1)))
    place = Window.partitionBy("block", width).orderBy("n", "rep")
    most = F.least(F.lit(CHUNK), F.greatest(F.lit(64), F.floor(F.lit(1 << CHUNK_BITS) / F.pow(F.lit(2.0), width))))
    chunked = blocks.withColumn("chunk", width.cast("long") * (1 << 40) + F.floor((F.row_number().over(place) - 1) / most))
    spans = chunked.groupBy("block", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x = spans.select("block", F.col("chunk").alias("c1"), F.col("high").alias("high1"))
    y = spans.select("block", F.col("chunk").alias("c2"), F.col("low").alias("low2"))
    # chunks are in size order, so a later one is too large once its smallest member is
    pairs = x.join(y, "block").filter((F.col("c1") <= F.col("c2")) & (100 * F.col("high1") >= percent * F.col("low2"))).drop("high1", "low2")
    sides = pairs.select("block", "c1", "c2", F.explode(F.when(F.col("c1") == F.col("c2"), F.array(F.struct(F.lit(0).alias("side"), F.col("c1").alias("chunk"))))
                                                        .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("c1").alias("chunk")),
                                                                           F.struct(F.lit(1).alias("side"), F.col("c2").alias("chunk"))))).alias("s"))
    return chunked.join(sides.select("block", "c1", "c2", "s.side", "s.chunk"), ["block", "chunk"]).drop("chunk")


def contract(at: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One task's part of a round: edges u > v, each in the task of either node ``at``, become edges to the smallest node they connect with.

    An edge of a node that is not this task's own is left out where it was there before: its own task has it too.
    """
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = place[:len(u)], place[len(u):]
    low = forest(len(nodes), i, j)
    x = np.flatnonzero(low != np.arange(len(nodes)))
    known = np.isin(x * len(nodes) + low[x], i * len(nodes) + j)
    x = x[np.isin(nodes[x], at) | ~known]
    return nodes[x], nodes[low[x]]


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges``(a, b). In each round the edges of a node meet and point to
    the smallest of their nodes, so that chains halve; it ends when a round changes nothing, and every component is a star."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("ngram_join")
        held = [f for f in frames if len(f)]
        if held:
            u, v = contract(*(np.concatenate([f[c].to_numpy() for f in held]) for c in ("at", "u", "v")))
            yield pd.DataFrame({"u": u, "v": v})

    now = scratch_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen.n == 0 or tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        mark = tuple(seen)
        both = now.select(F.explode(F.array("u", "v")).alias("at"), "u", "v")
        now = scratch_table(both.repartition("at").mapInPandas(run, "u long, v long"), "edges")


def _whole_sets(reps: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """rep, s: the whole shingle sets of ``reps``; their texts are hashed anew."""
    wanted = classes.join(reps.distinct(), "rep").select("rep", "digest", "any_id")
    ids = wanted.select(F.col("any_id").alias("i")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids.withColumnRenamed("i", "j"), F.col("i").eqNullSafe(F.col("j")), "left_semi").select("t")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("ngram_join")
        hashes = _WordHashes()
        for frame in frames:
            sets = [shingle_set(t, hashes, size) for t in frame["t"]]
            yield pd.DataFrame({"digest": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "s": sets})

    made = texts.mapInPandas(run, "digest binary, s array<long>")
    return scratch_table(made.join(wanted.select("rep", "digest"), "digest").select("rep", "s").dropDuplicates(["rep"]), "sets")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, shingle by shingle."""
    sets = _whole_sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), classes, docs, size)
    left = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _group(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    ship_package(docs.sparkSession)
    small_arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("binary").alias("t"))
    sets = _sets(rows, size, percent).withColumn("id", F.col("doc_id").cast(kind))
    # a class: the rows with one set; its representative is its first row
    classes = scratch_table(sets.filter("n > 0").groupBy("digest").agg(
        F.min("uid").alias("rep"), F.min("id").alias("low_id"), F.min_by("doc_id", "uid").alias("any_id")), "classes")

    reps = sets.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
    tokens = reps.select(F.col("uid").alias("rep"), "n", F.explode("prefix").alias("token"))
    # members of a token in size order, parted where the next set is too large for a link
    by_size = Window.partitionBy("token").orderBy("n", "rep")
    jump = F.coalesce((100 * F.lag("n").over(by_size) < percent * F.col("n")).cast("int"), F.lit(0))
    parted = tokens.withColumn("jump", jump).withColumn("part", F.sum("jump").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    of = Window.partitionBy("token", "part")
    shared = scratch_table(parted.withColumns({"members": F.count(F.lit(1)).over(of), "mark": F.bit_xor(F.xxhash64("rep")).over(of),
                                               "hub": F.min("rep").over(of)}).filter("members > 1").drop("jump"), "shared-tokens")
    # parts with the same members are one block
    once = (shared.filter("rep = hub").groupBy("members", "mark", "hub").agg(F.min(F.struct("token", "part")).alias("of"))
            .select(F.col("of.token").alias("token"), F.col("of.part").alias("part"), F.xxhash64("of.token", "of.part").alias("block")))
    blocks = scratch_table(shared.join(once, ["token", "part"]).select("block", "rep", "n"), "blocks")
    bits = sets.select(F.col("uid").alias("rep"), "bits")

    first = _likely_pairs(_units(blocks.withColumn("comp", F.lit(-1).cast("long")), percent), bits, percent)
    # each member's two likeliest partners; the rest is for the second traversal
    by = Window.partitionBy("b").orderBy("gap", "a")
    tried = scratch_table(first.withColumn("k", F.row_number().over(by)).filter("k <= 2").select("a", "b"), "first-pairs")
    found = scratch_table(_links(tried, classes, rows, size, percent), "first-links")
    known = scratch_table(components(found), "first-components")

    labelled = blocks.join(known.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
    apart = labelled.groupBy("block").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("block")
    edges = _possible_families(_units(labelled.join(apart, "block", "left_semi"), percent), bits, percent)
    # a family of possible partners is a block of its own, where each set travels once
    family = scratch_table(components(edges).select(F.col("node").alias("rep"), F.col("root").alias("block")), "families")
    members = (family.join(reps.select(F.col("uid").alias("rep"), "n"), "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left")
               .select("block", "rep", "n", F.coalesce("root", "rep").alias("comp")))
    links = found.union(_unit_links(_units(members, percent), _whole_sets(family.select("rep"), classes, rows, size), percent))
    roots = components(links)

    named = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    low = named.groupBy("root").agg(F.min("low_id").alias("component_id"), F.min("rep").alias("first"))
    by_set = named.join(low, "root").select("digest", "component_id", "first")
    out = sets.select("uid", "id", "n", "digest", "text_hash").join(by_set, "digest", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
                      "uid", "text_hash", F.coalesce(F.col("uid") == F.col("first"), F.lit(True)).alias("stays"))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, ``uid`` (a row number), ``text_hash`` and ``stays`` (the group's first row), one per row of ``docs``."""
    with without_shuffle_files(docs.sparkSession):       # each step's shuffle files go when its table is written
        return _group(docs, id_col, text_col, size, percent)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each linked group stays: the group's first row.

    Documents without words are linked with nothing and all stay.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    stay = (group(docs, id_col, text_col, size, percent).filter("stays")
            .groupBy(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_h")).agg(F.count(F.lit(1)).alias("n")))
    joined = keyed.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("h") == F.col("stay_h")))
    # rows that repeat id and text: as many stay as the groups kept
    many = keyed.groupBy(F.col("id").alias("many_id"), F.col("h").alias("many_h")).count().filter("count > 1").drop("count")
    if many.isEmpty():
        return joined.select("row.*")
    repeats = F.col("id").eqNullSafe(F.col("many_id")) & (F.col("h") == F.col("many_h"))
    nth = Window.partitionBy("id", "h").orderBy(F.lit(0))
    kept = joined.join(many, repeats, "left_semi").withColumn("k", F.row_number().over(nth)).filter("k <= n")
    return joined.join(many, repeats, "left_anti").select("row.*").unionByName(kept.select("row.*"))
