"""Removal of repeated passages, located by sharded Aho-Corasick automata.

A window is ``size`` consecutive words of one document. Each distinct window
belongs to where it starts first, by (id, start); every later occurrence is
removed. The steps, each a Spark job whose result is written to the shared
folder:

1. Anchors. Of the short shingles inside a window the one with the smallest
   hash is its anchor, so equal windows have equal anchors and only one word
   in seven starts one. Anchors are counted over the corpus; those that occur
   once end here, and with them all windows they stand for.
2. Runs. The recurring anchors go back to their documents, which cut out the
   runs of windows that have one. All later steps see these runs alone.
3. Passages. Windows of the runs are counted, first by the stretches between
   two anchors, then singly; what occurs twice is confirmed, with its first
   place. There the windows join into passages again.
4. Automata. A shard holds the passages whose anchors were first seen in the
   same documents, so copies of a document need few shards. A task compiles the
   shard's passages, as tiles of half a window, into an Aho-Corasick automaton
   over words and streams the runs of all documents that have an anchor of
   the shard. Every window of a passage holds a whole tile; around each tile
   found, windows are compared with the passage word by word.
5. The removed stretches meet their documents, which are written without them.

A passage shared by any part of the corpus is never gathered: counts are
reduced before they are shuffled, and a shard's runs are dealt over as many
tasks as their bytes need, each with a copy of the shard's (bounded) passages.
Words are compared as 64-bit hashes while counting and as themselves in the
automata.

Defined results: a null or blank text has no words; the digest is that of the
empty text. Texts under ``size`` words lose nothing. Rows of one id count as
one document: what starts at the same place in two of them stays in both. Rows
without an id come after all ids, ordered by a hash of their text, and equal
ones count as one document. Ids must be whole numbers. Texts may have any
length; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import remove_path, scratch_path, scratch_table, ship_package, small_arrow_batches, without_shuffle_files

SIZE = 20
SHARD_ANCHORS = 4_000           # recurring anchors per shard: some 30,000 words of passages
STREAM_BYTES = 1 << 20          # of runs that one compiled shard streams before another task takes over
BOOK_WORDS = 500_000            # passage words compiled into one automaton; larger shards have several

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_OTHER = chr(0x10FFFF)          # a word that no passage of the shard has
_PLACE = 2**32                  # a place is id * _PLACE + start


# words, hashes and anchors of a batch of texts ------------------------------------------------------------------

def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words, one text after the other, and where each text begins (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()]
    known = words.filter(pa.array(real)).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in known.dictionary.to_pylist()], dtype=_U)
    return hashes[known.indices.to_numpy()], begin


def _later(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[:len(x) - by] = x[by:]
    return out


def _power(n: int) -> np.uint64:
    return _U(pow(int(_BASE), n, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def rolling(x: np.ndarray, length: int) -> np.ndarray:
    """At each position the hash of the next ``length`` values, by doubling."""
    total, done, part, span = np.zeros_like(x), 0, x, 1
    while True:
        if length & span:
            total = total + _power(done) * _later(part, done)
            done += span
        if span * 2 > length:
            return _mixed(total)
        part, span = part + _power(span) * _later(part, span), span * 2


def _least(x: np.ndarray, length: int) -> np.ndarray:
    """At each position the smallest of the next ``length`` values."""
    span = 1
    while span * 2 <= length:
        x, span = np.minimum(x, _later(x, span)), span * 2
    return np.minimum(x, _later(x, length - span))


class Windows:
    """The windows of a batch of texts: ``starts`` (flat positions), their ``text``, ``hash`` and ``anchor``."""

    def __init__(self, words: np.ndarray, begin: np.ndarray, size: int):
        self.begin, self.size, self.short = begin, size, anchor_words(size)
        lengths = np.diff(begin)
        left = np.repeat(begin[1:], lengths) - np.arange(len(words))
        self.shingle = rolling(words, self.short)
        self.starts = np.flatnonzero(left >= size)
        self.text = np.repeat(np.arange(len(lengths)), lengths)[self.starts]
        self.hash = rolling(words, size)[self.starts]
        self.anchor = _least(self.shingle, size - self.short + 1)[self.starts]

    def place(self) -> np.ndarray:
        """Where each window starts in its text."""
        return self.starts - self.begin[:-1][self.text]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, shingle) that anchor a window, and how often the shingle does so in the text."""
        most = np.zeros(len(self.shingle), _U)
        for by in range(self.size - self.short + 1):        # the shingle at s + by anchors the window at s
            at = self.starts + by
            most[at] |= np.where(self.anchor == self.shingle[at], _U(1), _U(0))
        at = np.flatnonzero(most)
        text = np.searchsorted(self.begin, at, side="right") - 1
        order = np.lexsort((self.shingle[at], text))
        text, shingle = text[order], self.shingle[at][order]
        new = np.ones(len(at), bool)
        new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
        first = np.flatnonzero(new)
        return text[first], shingle[first], np.diff(np.append(first, len(at)))

    def runs(self, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last index of each stretch of windows that follow one another word by word with equal ``same``."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = (np.diff(self.starts) != 1) | (np.diff(self.text) != 0)
        for x in same:
            cut |= x[1:] != x[:-1]
        at = np.flatnonzero(cut)
        return np.append(0, at + 1), np.append(at, len(self.starts) - 1)

    def only(self, chosen: np.ndarray) -> Windows:
        self.starts, self.text, self.hash, self.anchor = (x[chosen] for x in (self.starts, self.text, self.hash, self.anchor))
        return self


def anchor_words(size: int) -> int:
    return max(1, size * 2 // 5)


def tile_words(size: int) -> int:
    return (size + 1) // 2


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _int(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


# the tasks --------------------------------------------------------------------------------------------------------

def _anchor_task(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, shingle, n = Windows(*word_hashes(b.column("text")), size).anchors()
            yield pa.RecordBatch.from_arrays([pa.array(_signed(shingle)), pa.array(_int(b.column("key"))[text]), pa.array(n, pa.int64())], ["h", "key", "n"])
    return run


_RUN = pa.struct([("shard", pa.int32()), ("first", pa.int32()), ("words", pa.string())])


def _run_task(size: int):
    """Rows of documents -> digests of those without recurring anchors, runs of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, begin = word_hashes(b.column("text"))
            texts = b.column("text").to_pylist()
            marks = b.column("marks").flatten()
            h, shard = marks.field("h").to_numpy().view(_U), marks.field("shard").to_numpy()
            order = np.argsort(h)
            h, shard = h[order], shard[order]
            w = Windows(hashes, begin, size)
            at = np.minimum(np.searchsorted(h, w.anchor), max(len(h) - 1, 0))
            w.only(h[at] == w.anchor if len(h) else np.zeros(len(at), bool))
            of = shard[np.searchsorted(h, w.anchor)]
            first, last = w.runs(of)
            place, text, of = w.place(), w.text[first], of[first]
            runs: list[list[dict] | None] = [None] * len(texts)
            split: dict[int, list[bytes]] = {}
            for t, s, a, z in zip(text.tolist(), of.tolist(), place[first].tolist(), place[last].tolist(), strict=True):
                if t not in split:
                    split = {t: texts[t].encode().split()}
                    runs[t] = []
                runs[t].append({"shard": s, "first": a, "words": b" ".join(split[t][a:z + size]).decode()})
            whole = [None if r else hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest() for x, r in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("ord"), b.column("key"), pa.array(np.diff(begin), pa.int64()), pa.array(whole, pa.string()),
                pa.array([x if r else None for x, r in zip(texts, runs, strict=True)], pa.string()),
                pa.array(runs, pa.list_(_RUN))], ["doc_id", "ord", "key", "n_words", "whole", "text", "runs"])
    return run


def _stretch_task(size: int):
    """Runs -> their windows, a row for each stretch that one anchor stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Windows(*word_hashes(b.column("words")), size)
            first, last = w.runs(w.anchor)
            text, start = w.text[first], _int(b.column("first")).astype(np.int64)[w.text[first]] + w.place()[first]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(w.hash)).astype(np.int32)), pa.array(_signed(w.hash)))
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([b.column("ord").take(take), b.column("shard").take(take), pa.array(start, pa.int64()), lists],
                                             ["ord", "shard", "start", "windows"])
    return run


def _passage_task(size: int):
    """Documents' runs with the windows that start first in them -> passages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, found = b.column("runs"), b.column("found")
            of_doc = np.repeat(np.arange(b.num_rows), np.diff(runs.offsets.to_numpy()))
            flat, known = runs.flatten(), found.flatten()
            words, first = flat.field("words"), flat.field("first").to_numpy().astype(np.int64)
            have = np.repeat(np.arange(b.num_rows), np.diff(found.offsets.to_numpy())) * _PLACE + known.field("start").to_numpy()
            order = np.argsort(have)
            have, have_hash = have[order], known.field("w").to_numpy().view(_U)[order]
            w = Windows(*word_hashes(words), size)
            place = of_doc[w.text] * _PLACE + first[w.text] + w.place() if len(w.text) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(have, place), len(have) - 1)
            w.only((have[at] == place) & (have_hash[at] == w.hash))
            a, z = w.runs()
            place, run_of, out = w.place(), w.text[a], []
            split: dict[int, list[str]] = {}
            for r, i, j in zip(run_of.tolist(), place[a].tolist(), place[z].tolist(), strict=True):
                if r not in split:
                    split = {r: words[r].as_py().split(" ")}
                out.append(" ".join(split[r][i:j + size]))
            take = pa.array(run_of)
            yield pa.RecordBatch.from_arrays([flat.field("shard").take(take), b.column("ord").take(pa.array(of_doc[run_of])),
                                              pa.array(first[run_of] + place[a], pa.int64()), pa.array(out, pa.string())], ["shard", "ord", "first", "words"])
    return run


class Book:
    """Passages of a shard, compiled."""

    def __init__(self, passages: list[tuple[str, int, str]], size: int):
        import ahocorasick
        self.size, self.tile = size, tile_words(size)
        self.letter: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        coded, first, ident = [], [], []
        for ordinal, start, words in passages:
            letters = "".join(self.letter.setdefault(w, chr(len(self.letter) + 1)) for w in words.split(" "))
            for i in range(0, len(letters) - self.tile + 1, self.tile):
                self.automaton.add_word(letters[i:i + self.tile], True)
            coded.append(_letters(letters))
            first.append(start)
            ident.append(ordinal)
        self.automaton.make_automaton()
        lengths = np.array([len(c) for c in coded])
        begin = np.concatenate([[0], np.cumsum(lengths)])
        self.letters = np.concatenate(coded)
        at = np.flatnonzero(np.repeat(begin[1:], lengths) - np.arange(len(self.letters)) >= size)
        passage = np.searchsorted(begin, at, side="right") - 1
        hashes = rolling(self.letters.astype(_U), size)[at]
        order = np.argsort(hashes, kind="stable")
        self.hash, self.at, passage = hashes[order], at[order], passage[order]
        self.start = np.array(first, np.int64)[passage] + self.at - begin[passage]
        self.number = {o: i for i, o in enumerate(dict.fromkeys(ident))}
        self.ordinal = np.array([self.number[o] for o in ident])[passage]

    def repeats(self, runs: list[tuple[str, int, str]]) -> list[tuple[int, int, int]]:
        """(run, from, to): the words of the runs (id, start, words) covered by windows that start earlier elsewhere."""
        get = self.letter.get
        lines = ["".join(map(get, words.split(" "), repeat(_OTHER))) for _, _, words in runs]
        text = _OTHER.join(lines)
        ends = np.fromiter((end for end, _ in self.automaton.iter(text)), np.int64)
        if not len(ends) or len(text) < self.size:
            return []
        near = np.zeros(len(text) + 1, np.int64)        # windows that hold a tile that was found
        tile = ends - self.tile + 1
        np.add.at(near, np.maximum(tile - (self.size - self.tile), 0), 1)
        np.add.at(near, tile + 1, -1)
        at = np.flatnonzero(np.cumsum(near)[:len(text) - self.size + 1] > 0)
        letters = _letters(text)
        hashes = rolling(letters.astype(_U), self.size)[at]
        hit = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        same = self.hash[hit] == hashes
        at, hit = at[same], hit[same]
        span = np.arange(self.size)
        equal = (letters[at[:, None] + span] == self.letters[self.at[hit][:, None] + span]).all(axis=1)
        at, hit = at[equal], hit[equal]
        begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
        run = np.searchsorted(begin, at, side="right") - 1
        place = np.array([r[1] for r in runs], np.int64)[run] + at - begin[run]
        own = (self.ordinal[hit] == np.array([self.number.get(r[0], -1) for r in runs])[run]) & (self.start[hit] == place)
        at = at[~own]
        gone = np.zeros(len(text) + 1, np.int64)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + self.size, -1)
        covered = np.diff((np.cumsum(gone) > 0).astype(np.int8), prepend=0)
        a, z = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
        run = np.searchsorted(begin, a, side="right") - 1
        shift = np.array([r[1] for r in runs], np.int64)[run] - begin[run]
        return list(zip(run.tolist(), (a + shift).tolist(), (z + shift).tolist(), strict=True))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def books(passages: list[tuple[str, int, str]], size: int) -> list[Book]:
    """Automata of at most about BOOK_WORDS words each."""
    out, part, n = [], [], 0
    for p in passages:
        part.append(p)
        n += p[2].count(" ") + 1
        if n >= BOOK_WORDS:
            out, part, n = [*out, Book(part, size)], [], 0
    return out + ([Book(part, size)] if part else [])


def _stream_task(size: int):
    """Sorted rows, a shard's passages before its runs -> removed stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, passages, compiled = None, [], None
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("shard", "salt", "kind", "ord", "first", "words", "key")), strict=True))
            keys, lo, hi, i = [], [], [], 0
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j][:3] == rows[i][:3]:
                    j += 1
                if rows[i][:2] != group:
                    group, passages, compiled = rows[i][:2], [], None
                part = [r[3:6] for r in rows[i:j]]
                if rows[i][2] == 0:
                    passages += part
                else:
                    if compiled is None:
                        compiled, passages = books(passages, size), []
                    for book in compiled:
                        for r, a, z in book.repeats(part):
                            keys.append(rows[i + r][6])
                            lo.append(a)
                            hi.append(z)
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["key", "lo", "hi"])
    return run


def _rest_task():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, kept_texts = [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                words = text.encode().split()
                stays = bytearray(b"\x01") * len(words)
                for g in gone or ():
                    stays[g["lo"]:g["hi"]] = bytes(g["hi"] - g["lo"])
                kept = list(compress(words, stays))
                left.append(len(words) - len(kept))
                kept_texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(left, pa.int64()), pa.array(kept_texts, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_text"])
    return run


# the jobs -----------------------------------------------------------------------------------------------------------

def _ordinal(ident: Column, key: Column) -> Column:
    """The order of documents: ids, then rows without one by ``key``."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.coalesce(wide(ident), wide(F.lit(Decimal(2**64)) + wide(key)))


def _place(ordinal: Column, start: Column) -> Column:
    return (ordinal * F.lit(_PLACE).cast("decimal(10,0)") + start.cast("decimal(10,0)")).cast("decimal(38,0)")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    with without_shuffle_files(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(documents, removed): ``documents`` has ``doc_id``, ``key``, ``n_words`` and either ``whole`` (the digest of a text that
    repeats nothing) or ``text``; ``removed`` has ``key`` and ``gone``, word ranges [lo, hi) of that text."""
    spark = docs.sparkSession
    ship_package(spark)
    small_arrow_batches(spark)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = (docs.select(F.col(id_col).alias("doc_id"), _ordinal(F.col(id_col).cast("long"), key).cast("decimal(20,0)").alias("ord"),
                        key.alias("key"), F.col(text_col).alias("text")))

    # 1. anchors that recur, with the shard of the documents that had them first
    pairs, pairs_path = _written(rows.select("key", "text").mapInArrow(_anchor_task(size), "h bigint, key bigint, n bigint"), "anchors")
    recurring, recurring_path = _written(pairs.groupBy("h").agg(F.sum("n").alias("n"), F.min("key").alias("owner")).filter("n >= 2")
                                         .select("h", "owner"), "recurring-anchors")
    shards = max(1, math.ceil(recurring.count() / SHARD_ANCHORS))
    marks, marks_path = _written(pairs.join(recurring, "h").groupBy("key").agg(
        F.collect_set(F.struct("h", F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int").alias("shard"))).alias("marks")), "marks")
    remove_path(spark, pairs_path)
    remove_path(spark, recurring_path)

    # 2. runs of windows that have one
    none = F.array().cast("array<struct<h:bigint,shard:int>>")
    run_type = "array<struct<shard:int,first:int,words:string>>"
    parted, _ = _written(rows.join(marks, "key", "left").select("doc_id", "ord", "key", "text", F.coalesce("marks", none).alias("marks")).mapInArrow(
        _run_task(size), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ord decimal(20,0), key bigint, n_words bigint, "
                         f"whole string, text string, runs {run_type}"), "runs")
    remove_path(spark, marks_path)
    runs = parted.filter("runs IS NOT NULL").select("ord", "key", F.explode("runs").alias("r")).select("ord", "key", "r.shard", "r.first", "r.words")

    # 3. windows that occur twice, where they start first, as passages
    stretches = (runs.select("ord", "shard", "first", "words")
                 .mapInArrow(_stretch_task(size), "ord decimal(20,0), shard int, start bigint, windows array<bigint>")
                 .select("shard", "windows", _place(F.col("ord"), F.col("start")).alias("place"))
                 .groupBy("shard", "windows").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n")))
    start = F.pmod("place", F.lit(_PLACE).cast("decimal(38,0)"))
    confirmed, confirmed_path = _written(
        stretches.select("n", "place", F.posexplode("windows").alias("i", "w"))
        .select("n", "w", (F.col("place") + F.col("i").cast("decimal(10,0)")).cast("decimal(38,0)").alias("place"))
        .groupBy("w").agg(F.sum("n").alias("n"), F.min("place").alias("place")).filter("n >= 2")
        .select("w", start.cast("int").alias("start"),
                ((F.col("place") - start) / F.lit(_PLACE).cast("decimal(10,0)")).cast("decimal(20,0)").alias("ord")), "windows")
    found = confirmed.groupBy("ord").agg(F.collect_list(F.struct("start", "w")).alias("found"))        # of one document
    passages, passages_path = _written(
        parted.filter("runs IS NOT NULL").select("ord", "runs").join(found, "ord").select("ord", "runs", "found")
        .mapInArrow(_passage_task(size), "shard int, ord decimal(20,0), first bigint, words string"), "passages")
    remove_path(spark, confirmed_path)

    # 4. runs streamed through the automata of their shards
    load = runs.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("words") + 32) / STREAM_BYTES).cast("int").alias("salts"))
    load, load_path = _written(load, "shard-load")
    salted_runs = (runs.join(load.withColumnRenamed("shard", "s"), F.col("shard") == F.col("s"))
                   .select("shard", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"),
                           F.col("ord").cast("string").alias("ord"), F.col("first").cast("bigint").alias("first"), "words", "key"))
    salted_passages = (passages.join(load, "shard")
                       .select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"),
                               F.col("ord").cast("string").alias("ord"), "first", "words", F.lit(None).cast("bigint").alias("key")))
    dealt = salted_runs.unionByName(salted_passages).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    removed, _ = _written(dealt.mapInArrow(_stream_task(size), "key bigint, lo int, hi int")
                          .groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("gone")), "removed")
    remove_path(spark, passages_path)
    remove_path(spark, load_path)
    return parted.select("doc_id", "key", "n_words", "whole", "text"), removed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (the kept words joined by one space; null for a
    text without recurring anchors, which stays as it is) and ``kept_sha256`` of the kept words either way."""
    parted, removed = find_repeats(docs, id_col, text_col, size)
    ident = parted.schema["doc_id"].dataType.simpleString()
    untouched = parted.filter("whole IS NOT NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"),
                                                          F.lit(None).cast("string").alias("kept_text"), F.col("whole").alias("kept_sha256"))
    rest = (parted.filter("whole IS NULL").select("doc_id", "key", "n_words", "text").join(removed, "key", "left")
            .select("doc_id", "n_words", "text", "gone")
            .mapInArrow(_rest_task(), f"doc_id {ident}, n_words bigint, n_removed bigint, kept_text string")
            .withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256)))
    return untouched.unionByName(rest)
