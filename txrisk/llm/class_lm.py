"""Language-model scoring with Brown class n-grams.

Counts cover every training text. One pass turns texts into blocks: token
numbers of a few megabytes of text plus the block's own dictionary. The
dictionaries (not the tokens) are dealt into buckets by a hash of the word,
where every word gets its corpus count and a place; afterwards blocks and
buckets exchange packed numbers only, and no task ever holds the whole
vocabulary.

Classes: every training word is a symbol of its own, and the number of classes
grows with the cube root of the vocabulary. A start comes from the driver: the
most frequent words and groups of words with the same ending are exchanged one
after another until a sweep moves none. Each of its classes then has an empty
twin, and the other words start in their ending's class or its twin at random,
so that words of one ending can part by their neighbours. Then rounds over all words: each block
learns its words' classes and counts, per word, the classes before and after
it; these are summed per word into a table, and half of the words (by a hash,
the other half next) move to the class that raises the class-bigram likelihood
most (the two classes of a word's ending are left only for a gain above
log(classes), or words seen once would follow chance). Words move at the same time, so the likelihood is measured after each
round: a round that does not raise it is taken back, and the rounds end when
both halves failed or two rounds gain less than LEAST_GAIN. The score of a word after another is P(class | class
before) * P(word | class), both smoothed; a word unseen in training takes the
class most training words of its ending have, and that class's unseen share.

Defined results: a null text is empty and has the end token alone. A null id
is never held out. Without training texts the base score is 0.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import drop_table, light_arrow_batches, scratch_table, ship_package, shuffle_partitions, small_arrow_batches, without_shuffle_files

BLOCK_BYTES = 16 << 20
TOKENS_AT_ONCE = 1 << 18            # a block's documents are worked off in slices of about so many tokens
CELLS_AT_ONCE = 1 << 19             # word-by-class gains held at once
CORE, SUFFIXES = 512, 255          # least symbols of the start: frequent words, and groups by ending
CLASSES = 32                       # at least; the last is the end token's own
CORE_PER_CLASS = 4
SWEEPS = 100                       # a sweep that moves none ends the start long before
LEAST_GAIN = 0.03                  # of the class-bigram likelihood, by two rounds
BUCKET_ENTRIES = 100_000           # dictionary entries of a bucket, on average
SMALL = 16                         # counts whose likelihood gains are looked up
ADD = 0.1                          # fixed by the contract for the base, used for emissions too
BACKOFF = 2.0                      # weight of the class frequencies in a class's transitions
_SALT = 64


def tokens(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased; bytes.split() cuts at exactly space and U+0009..U+000D."""
    return text.lower().split() if text else []


def suffix_group(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIXES


def class_count(vocabulary: int) -> int:
    return max(CLASSES, round(vocabulary ** (1 / 3))) // 2 * 2 + 1


def _pack(ids: np.ndarray) -> bytes:
    """Byte planes, which compress far better than mixed bytes."""
    return np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def slices(n: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, end, first token, end) of slices of about TOKENS_AT_ONCE tokens; a document is never cut."""
    stop = np.cumsum(n)
    at = begin = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(stop, begin + TOKENS_AT_ONCE, side="right")))
        yield at, end, begin, int(stop[end - 1])
        at, begin = end, int(stop[end - 1])


def neighbour_counts(n: np.ndarray, held: np.ndarray, ids: np.ndarray, k: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of documents with ``n`` tokens each, those not ``held``: keys word * 2 * classes + side, ascending, and how often each occurs.
    k: class by word; side: the class before, or classes + the class after."""
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, end, start, stop in slices(n):
        size = n[first:end]
        last = np.cumsum(size)
        own = ids[start:stop].astype(np.int64)
        if not len(own):
            continue
        now = k[own]
        before, after = np.roll(now, 1), np.roll(now, -1)
        before[(last - size)[size > 0]] = after[last[size > 0] - 1] = classes - 1
        train = np.repeat(~held[first:end], size)
        key, c = np.unique(np.concatenate([(own * (2 * classes) + before)[train], (own * (2 * classes) + classes + after)[train]]), return_counts=True)
        keys.append(key)
        times.append(c)
    if len(keys) == 2:
        return keys[1], times[1]
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds, stored once: a block's documents, and its dictionary entries (``word`` not null)."""
    names = ["block", "doc_id", "held", "n", "ids", "local", "word", "train"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, serial = TaskContext.get().partitionId(), itertools.count()

        def flush(doc_id, held, parts, local):
            block, n = (part << 32) + next(serial), [len(p) for p in parts]
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            train = np.bincount(ids[np.repeat(~np.array(held, dtype=bool), n)], minlength=len(local))
            yield pd.DataFrame([(block, doc_id, held, n, _pack(ids), None, None, None)], columns=names)
            words = list(local)
            for at in range(0, len(words), 50_000):
                some = words[at:at + 50_000]
                out = pd.DataFrame({"block": block, "word": some, "local": np.arange(at, at + len(some)), "train": train[at:at + len(some)]})
                yield out.reindex(columns=names).astype({"doc_id": object, "held": object, "n": object, "ids": object}).replace({np.nan: None})

        def fresh():
            return [], [], [], defaultdict(itertools.count().__next__)

        doc_id, held, parts, local = fresh()
        size = 0
        for frame in frames:
            for i, h, text in zip(frame["i"], frame["held"], frame["t"]):
                found = tokens(text)
                parts.append(np.fromiter(map(local.__getitem__, found), np.int32, len(found)))
                doc_id.append(i)
                held.append(bool(h))
                size += len(text or b"")
                if size >= BLOCK_BYTES:
                    yield from flush(doc_id, held, parts, local)
                    (doc_id, held, parts, local), size = fresh(), 0
        if doc_id:
            yield from flush(doc_id, held, parts, local)

    return scratch_table(docs.mapInPandas(run, "block long, doc_id array<string>, held array<boolean>, n array<int>, ids binary, "
                                               "local int, word binary, train long"), "lm-blocks")


def _symbol_bigrams(train: DataFrame, core: list[bytes]) -> np.ndarray:
    """Counts of neighbouring symbols over all training texts, the end token before the first word and after the last.
    Symbols: the words of ``core``, SUFFIXES groups of the others, the end token."""
    shared = train.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(core)})
    end = len(core) + SUFFIXES
    size = end + 1

    class Symbols(dict):
        def __missing__(self, word):
            if len(self) > 500_000:
                self.clear()
                self.update(shared.value)
            self[word] = s = end - SUFFIXES + suffix_group(word)
            return s

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols, table = Symbols(shared.value), np.zeros(size * size, dtype=np.int64)
        for frame in frames:
            seq = [np.array([end], dtype=np.int64)]
            for text in frame["t"]:
                found = tokens(text)
                seq += [np.fromiter(map(symbols.__getitem__, found), np.int64, len(found)), seq[0]]
            s = np.concatenate(seq)
            np.add.at(table, *np.unique(s[:-1] * size + s[1:], return_counts=True))
        yield _table_rows(table.reshape(size, size))

    return _sum_tables(train.mapInPandas(count, _ROWS), (size, size))


_ROWS = "symbol int, salt int, row binary"


def _table_rows(table: np.ndarray) -> pd.DataFrame:
    from pyspark import TaskContext
    used = np.flatnonzero(table.any(axis=1))
    return pd.DataFrame({"symbol": used, "salt": TaskContext.get().partitionId() % _SALT, "row": [table[k].tobytes() for k in used]})


def _sum_tables(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the tasks' tables, on the driver."""
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(r, dtype=np.int64) for r in frame["row"]], axis=0)
        return pd.DataFrame({"symbol": frame["symbol"][:1], "salt": 0, "row": [total.tobytes()]})

    some = parts.groupBy("symbol", "salt").applyInPandas(add, _ROWS)
    out = np.zeros(shape, dtype=np.int64)
    for r in some.groupBy("symbol").applyInPandas(add, _ROWS).collect():       # a table's rows
        out[r.symbol] = np.frombuffer(r.row, dtype=np.int64)
    return out


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol: starting from frequency order, each symbol moves to the class that raises the
    class-bigram likelihood most, until a sweep moves none. The last symbol keeps the last class to itself."""
    s = len(bigrams)
    b = bigrams.astype(np.float64)
    free = classes - 1
    weight = b.sum(axis=0) + b.sum(axis=1)
    order = [k for k in np.argsort(-weight, kind="stable") if k != s - 1]
    cls = np.empty(s, dtype=np.int64)
    cls[order] = np.arange(len(order)) % free
    cls[s - 1] = classes - 1
    member = np.zeros((s, classes))
    member[np.arange(s), cls] = 1
    n = member.T @ b @ member

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for w in order:
            if weight[w] == 0:
                continue
            a, own = cls[w], b[w, w]
            member[w, a] = 0
            left, right = b[:, w] @ member, b[w] @ member
            left_sum, right_sum = left.sum() + own, right.sum() + own
            n[a] -= right
            n[:, a] -= left
            n[a, a] -= own
            rows, cols = n.sum(axis=1), n.sum(axis=0)
            gain = (f(n + right) - f(n)).sum(axis=1) + (f(n + left[:, None]) - f(n)).sum(axis=0)
            d = np.diag(n)
            gain += f(d + right + left + own) - f(d + right) - f(d + left) + f(d)
            gain -= f(rows + right_sum) - f(rows) + f(cols + left_sum) - f(cols)
            k = int(np.argmax(gain[:free]))
            if gain[k] <= gain[a] + 1e-9:
                k = a
            moved += k != a
            cls[w] = k
            member[w, k] = 1
            n[k] += right
            n[:, k] += left
            n[k, k] += own
        if not moved:
            break
    return cls


def transitions(bigrams: np.ndarray, cls: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """log10 P(class | class before), backed off to the class frequencies; each row sums to one."""
    member = np.zeros((len(cls), classes))
    member[np.arange(len(cls)), cls] = 1
    n = member.T @ bigrams @ member
    share = (n.sum(axis=0) + 1) / (n.sum() + classes)
    return np.log10((n + BACKOFF * share) / (n.sum(axis=1, keepdims=True) + BACKOFF))


def likelihood(n: np.ndarray) -> float:
    """The class-bigram log likelihood's part that depends on the classes: the mutual information of neighbours, times the tokens."""
    def f(x):
        return float((x * np.log(np.maximum(x, 1))).sum())
    return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1)) + f(n.sum())


def _buckets(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, vocabulary): each block's dictionary as (bucket, block, local numbers, places), and (bucket, place, word, count)
    of every word, count 0 if it is in no training text. A bucket holds all entries of its words."""
    entries = blocks.filter(F.col("word").isNotNull()).select("block", "local", "word", "train")
    many = max(shuffle_partitions(blocks.sparkSession), -(-entries.count() // BUCKET_ENTRIES))
    names = ["bucket", "block", "locals", "places", "place", "word", "c"]

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        place, words = pd.factorize(frame["word"])
        c = np.bincount(place, weights=frame["train"], minlength=len(words)).astype(np.int64)
        bucket = int(frame["bucket"].iloc[0])
        rows = [(bucket, None, None, None, k, w, n) for k, (w, n) in enumerate(zip(words, c.tolist()))]
        block, local = frame["block"].to_numpy(), frame["local"].to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        rows += [(bucket, int(block[o[0]]), _pack(local[o]), _pack(place[o]), None, None, None) for o in np.split(order, cuts)]
        return pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in ("block", "place", "c")})

    made = scratch_table(entries.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(many)).cast("int")).groupBy("bucket").applyInPandas(
        number, "bucket int, block long, locals binary, places binary, place int, word binary, c long"), "lm-places")
    return (made.filter(F.col("word").isNull()).select("bucket", "block", "locals", "places"),
            made.filter(F.col("word").isNotNull()).select("bucket", "place", "word", "c"))


_STATE = "bucket int, c binary, tail binary, half binary, home binary, cls binary"


def _start(vocabulary: DataFrame, core: list[bytes], cls: np.ndarray, classes: int) -> DataFrame:
    """Per bucket, by place: count, group of the ending, a random bit, the class of the word's symbol and the word's own."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(({w: k for k, w in enumerate(core)}, cls))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        known, cls = shared.value
        frame = frame.sort_values("place")
        tail = np.array([suffix_group(w) for w in frame["word"]])
        symbol = np.array([known.get(bytes(w), len(known) + t) for w, t in zip(frame["word"], tail)])
        mixed = np.array([zlib.crc32(w) for w in frame["word"]])
        half, twin = mixed >> 7 & 1, np.where(symbol < len(known), 0, mixed >> 8 & 1)
        home = cls[symbol]
        return pd.DataFrame([(frame["bucket"].iloc[0], frame["c"].to_numpy(np.int64).tobytes(), _pack(tail), _pack(half), _pack(home),
                              _pack(home + twin * (classes // 2)))],
                            columns=["bucket", "c", "tail", "half", "home", "cls"])

    return scratch_table(vocabulary.groupBy("bucket").applyInPandas(pack, _STATE), "lm-classes")


def _deliver(state: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` with the counts and classes of the places."""
    def run(words: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        c, cls = np.frombuffer(words["c"].iloc[0], dtype=np.int64), _unpack(words["cls"].iloc[0])
        at = [_unpack(p) for p in rows["places"]]
        return rows.assign(c=[c[p].tobytes() for p in at], cls=[_pack(cls[p]) for p in at])

    return state.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInPandas(
        run, "bucket int, block long, locals binary, places binary, c binary, cls binary")


def _by_local(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Count and class by local number, from a block's delivered rows."""
    if not len(rows):
        return np.zeros(0), np.zeros(0, dtype=np.int64)
    local = np.concatenate([_unpack(x) for x in rows["locals"]])
    c, k = np.zeros(len(local)), np.zeros(len(local), dtype=np.int64)
    c[local] = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["c"]])
    k[local] = np.concatenate([_unpack(x) for x in rows["cls"]])
    return c, k


_COUNTS = _STATE + ", at binary, side binary, n binary"


def _neighbours(texts: DataFrame, placed: DataFrame, state: DataFrame, classes: int) -> DataFrame:
    """``state`` with every word's counts of classes before it (side = class) and after it (side = classes + class)."""
    def count(docs_of: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        _, k = _by_local(rows)
        found = [neighbour_counts(np.array(r.n, dtype=np.int64), np.array(r.held, dtype=bool), _unpack(r.ids), k, classes)
                 for r in docs_of.itertuples(index=False)]          # one row
        key, times = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        row_of, place_of = np.zeros(len(k), dtype=np.int32), np.zeros(len(k), dtype=np.int32)
        for i, (local, place) in enumerate(zip(rows["locals"], rows["places"])):
            row_of[_unpack(local)], place_of[_unpack(local)] = i, _unpack(place)
        word, side = np.divmod(key, 2 * classes)
        order = np.argsort(row_of[word], kind="stable")
        cuts = np.searchsorted(row_of[word][order], np.arange(1, len(rows)))
        return pd.DataFrame([(b, _pack(place_of[word[o]]), _pack(side[o]), _pack(times[o]))
                             for b, o in zip(rows["bucket"], np.split(order, cuts)) if len(o)], columns=["bucket", "at", "side", "n"])

    def add(words: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        key = [np.zeros(0, np.int64), *(_unpack(a).astype(np.int64) * (2 * classes) + _unpack(s) for a, s in zip(rows["at"], rows["side"]))]
        key, back = np.unique(np.concatenate(key), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([np.zeros(0), *map(_unpack, rows["n"])]), minlength=len(key)).astype(np.int64)
        return words.assign(at=[_pack(key // (2 * classes))], side=[_pack(key % (2 * classes))], n=[n.tobytes()])

    some = texts.groupBy("block").cogroup(_deliver(state, placed).groupBy("block")).applyInPandas(
        count, "bucket int, at binary, side binary, n binary")
    return scratch_table(state.groupBy("bucket").cogroup(some.groupBy("bucket")).applyInPandas(add, _COUNTS), "lm-neighbours")


def _class_bigrams(counts: DataFrame, classes: int, empty: int) -> np.ndarray:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, end = np.zeros((classes, classes), dtype=np.int64), classes - 1
        for frame in frames:
            for r in frame.itertuples(index=False):
                k, side, n = _unpack(r.cls)[_unpack(r.at)], _unpack(r.side), np.frombuffer(r.n, dtype=np.int64)
                after, first = side >= classes, side == end
                table += np.bincount(k[after] * classes + (side[after] - classes), weights=n[after], minlength=classes * classes).astype(np.int64).reshape(classes, classes)
                np.add.at(table[end], k[first], n[first])
        yield _table_rows(table)

    out = _sum_tables(counts.select("cls", "at", "side", "n").mapInPandas(run, _ROWS), (classes, classes))
    out[-1, -1] += empty
    return out


def best_classes(table: np.ndarray, cls: np.ndarray, c: np.ndarray, at: np.ndarray, side: np.ndarray, n: np.ndarray,
                 home: np.ndarray | None = None) -> np.ndarray:
    """For each word (``at`` ascending), the class that raises the likelihood most, all other words staying as they are
    (without the terms of cells that a word's leaving and joining both change).
    With ``home``, any class but that and its twin must raise it by log(classes) more, the price of naming one."""
    classes, out = len(table), cls.copy()

    def f(x):
        return x * np.log(np.maximum(x, 1))

    # grid[side] is what a class k has on that side: before k column-wise, after k row-wise
    grid = np.concatenate([table, table.T]).astype(np.float64)
    base = f(grid)
    small = np.stack([f(grid + r) - base for r in range(1, SMALL + 1)])
    rows, cols = table.sum(axis=1).astype(np.float64), table.sum(axis=0).astype(np.float64)
    step = max(1, CELLS_AT_ONCE // classes)
    cuts, here = [0], 0
    begin = np.flatnonzero(np.diff(at, prepend=-1))        # first entry of each word
    while here < len(begin):                               # words of about `step` entries at a time
        here = max(here + 1, int(np.searchsorted(begin, begin[here] + step)))
        cuts.append(here)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        first, last = begin[lo], begin[hi] if hi < len(begin) else len(at)
        s, r, word = side[first:last], n[first:last].astype(np.float64), at[begin[lo:hi]]
        gain = np.empty((len(s), classes))
        few = r <= SMALL
        gain[few] = small[r[few].astype(int) - 1, s[few]]
        gain[~few] = f(grid[s[~few]] + r[~few, None]) - base[s[~few]]
        old = cls[at[first:last]]                          # the word's own class counts it already
        here_n = grid[s, old]
        gain[np.arange(len(s)), old] = f(here_n) - f(np.maximum(here_n - r, 0))
        total = np.add.reduceat(gain, begin[lo:hi] - first, axis=0)
        times, back = np.unique(c[word], return_inverse=True)
        t = times[:, None].astype(np.float64)
        total -= (f(rows + t) - f(rows) + f(cols + t) - f(cols))[back]
        a, w = cls[word], c[word].astype(np.float64)
        i = np.arange(len(word))
        total[i, a] = np.add.reduceat(gain[np.arange(len(s)), old], begin[lo:hi] - first) - (
            f(rows[a]) - f(rows[a] - w) + f(cols[a]) - f(cols[a] - w))
        total[:, -1] = -np.inf                             # the end token's class
        total[:, rows == 0] = -np.inf                      # many words at once would take an empty class, each as if alone
        if home is not None:
            total[i, home[word]] += np.log(classes)
            total[i, home[word] + classes // 2] += np.log(classes)
        k = total.argmax(axis=1)
        out[word] = np.where(total[i, k] > total[i, a] + 1e-9, k, a)
    return out


def _moved(counts: DataFrame, table: np.ndarray, half: int) -> DataFrame:
    shared = counts.sparkSession.sparkContext.broadcast(table)        # classes x classes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                cls, turn = _unpack(r.cls), _unpack(r.half) == half
                at = _unpack(r.at)
                mine = turn[at]
                best = best_classes(shared.value, cls, np.frombuffer(r.c, dtype=np.int64), at[mine], _unpack(r.side)[mine],
                                    np.frombuffer(r.n, dtype=np.int64)[mine], _unpack(r.home))
                yield pd.DataFrame([(r.bucket, r.c, r.tail, r.half, r.home, _pack(np.where(turn, best, cls)))],
                                   columns=["bucket", "c", "tail", "half", "home", "cls"])

    return scratch_table(counts.mapInPandas(run, _STATE), "lm-classes")


def cluster(texts: DataFrame, placed: DataFrame, state: DataFrame, classes: int, empty: int) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(state, class bigrams, likelihood after each round) once the rounds no longer pay."""
    counts = _neighbours(texts, placed, state, classes)
    table = _class_bigrams(counts, classes, empty)
    reached, turn, lost = [likelihood(table)], 0, 0
    while lost < 2 and (len(reached) < 3 or reached[-1] - reached[-3] >= LEAST_GAIN * reached[-1]):
        turn += 1
        new = _moved(counts, table, turn % 2)
        counts_new = _neighbours(texts, placed, new, classes)
        table_new = _class_bigrams(counts_new, classes, empty)
        if (now := likelihood(table_new)) <= reached[-1]:
            lost += 1                                      # the other half may still gain
            drop_table(new)
            drop_table(counts_new)
            continue
        drop_table(state)
        drop_table(counts)
        state, counts, table, lost = new, counts_new, table_new, 0
        reached.append(now)
    drop_table(counts)
    return state, table, reached


def _class_sizes(state: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and words of each class, and the class of most training words by group of endings."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((SUFFIXES + 1, classes), dtype=np.int64)      # words by ending; the last row counts tokens
        for frame in frames:
            for r in frame.itertuples(index=False):
                c, tail, cls = np.frombuffer(r.c, dtype=np.int64), _unpack(r.tail), _unpack(r.cls)
                np.add.at(sums, (tail[c > 0], cls[c > 0]), 1)
                np.add.at(sums[SUFFIXES], cls, c)
        yield _table_rows(sums)

    sums = _sum_tables(state.mapInPandas(run, _ROWS), (SUFFIXES + 1, classes))
    words = sums[:-1]
    usual = np.where(words.any(axis=1), words.argmax(axis=1), words.sum(axis=0).argmax())
    return sums[-1].astype(np.float64), words.sum(axis=0).astype(np.float64), usual


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``."""
    spark = docs.sparkSession
    with light_arrow_batches(spark), without_shuffle_files(spark):       # each step's shuffle files go when its table is written
        return _score(docs, held_out, id_col, text_col)


def _score(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    small_arrow_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.coalesce(held_out, F.lit(False)).alias("held"),
                       F.col(text_col).cast("binary").alias("t"))
    blocks = _blocks(rows)
    texts = blocks.filter(F.col("word").isNull()).select("block", "doc_id", "held", "n", "ids")
    placed, vocabulary = _buckets(blocks)
    trained = texts.select(F.explode(F.arrays_zip("held", "n")).alias("d")).filter("not d.held")
    ends, empty = trained.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("d.n") == 0).cast("long")), F.lit(0))).first()
    words = vocabulary.filter("c > 0")
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = seen.n + ends, seen.v + (ends > 0)

    classes = class_count(seen.v)
    end_class = classes - 1
    core = [bytes(r.word) for r in words.orderBy(F.desc("c"), "word").limit(max(CORE, CORE_PER_CLASS * classes)).collect()]
    start = exchange(_symbol_bigrams(rows.filter(~F.col("held")).select("t"), core), classes // 2 + 1)
    state, bigrams, _ = cluster(texts, placed, _start(vocabulary, core, start, classes), classes, empty)
    trans = transitions(bigrams, np.arange(classes), classes)
    tokens_in, words_in, usual = _class_sizes(state, classes)
    tokens_in[end_class] += ends
    words_in[end_class] += ends > 0
    emit = np.log10(tokens_in + ADD * (words_in + 1))
    model = spark.sparkContext.broadcast((trans, emit, total, distinct, ends))     # classes x classes numbers

    def unseen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["cls"] = [_pack(np.where(np.frombuffer(c, dtype=np.int64) > 0, _unpack(k), usual[_unpack(t)]))
                            for c, t, k in zip(frame["c"], frame["tail"], frame["cls"])]
            yield frame

    def run(docs_of: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        trans, emit, total, distinct, ends = model.value
        c, k = _by_local(entry)
        base = np.log10((c + ADD) / (total + ADD * (distinct + 1)))
        own = np.log10(c + ADD) - emit[k]
        base_end = np.log10((ends + ADD) / (total + ADD * (distinct + 1)))
        own_end = np.log10(ends + ADD) - emit[end_class]

        def scored(doc_id, held, n, ids):
            doc = np.repeat(np.arange(len(n)), n)
            now = k[ids]
            stop = np.cumsum(n)
            before = np.concatenate([[end_class], now])[:-1] if len(now) else now
            before[(stop - n)[n > 0]] = end_class
            last = np.full(len(n), end_class)
            last[n > 0] = now[stop[n > 0] - 1]

            def per_doc(x):
                return np.bincount(doc, weights=x, minlength=len(n))
            return pd.DataFrame({
                "doc_id": list(doc_id), "held_out": list(held), "n_tokens": n + 1,
                "n_known": per_doc((c[ids] > 0).astype(float)).astype(np.int64) + (ends > 0), "train_tokens": total,
                "base_score": per_doc(base[ids]) + base_end,
                "score": per_doc(own[ids] + trans[before, now]) + own_end + trans[last, end_class]})

        out = []
        for r in docs_of.itertuples(index=False):
            n, ids = np.array(r.n, dtype=np.int64), _unpack(r.ids)
            for first, end, begin, last in slices(n):
                out.append(scored(r.doc_id[first:end], r.held[first:end], n[first:end], ids[begin:last]))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    made = texts.groupBy("block").cogroup(_deliver(state.mapInPandas(unseen, _STATE), placed).groupBy("block")).applyInPandas(
        run, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))
