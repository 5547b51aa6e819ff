"""Best-fit packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm.

1. Tokenise. Each document becomes its token ids and one end id. Only a
   document longer than a sequence is cut, into full pieces; its first piece
   takes the remainder. Full pieces are sequences already.
2. Evolve. The other pieces are dealt evenly into pools of bounded size. Each
   pool is evolved on several islands: an individual is a whole assignment of
   pieces to sequences. Crossover injects one parent's well-filled sequences
   whole into the other, removes the sequences that then hold duplicates and
   best-fits the displaced pieces, longest first. Fitness is the number of
   sequences, then how unevenly they are filled.
3. Migrate. Between epochs each island's elite travels to its neighbour on a
   ring (a Spark shuffle). After the last epoch the pool keeps its best.
4. Pool the rest. Sequences left poorly filled are dissolved; their pieces
   form new, fewer pools for the next round.

Every task handles one pool, so memory is bounded at any input size.

Defined results: null and empty texts are one piece, the end id alone.
Repeated rows and ids are packed as they are, once per row.
"""

from __future__ import annotations

import random
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import scratch_table, ship_package, small_arrow_batches, worker_cache

CAPACITY = 2048
END_ID = 0
POOL_ITEMS = 1500
ISLANDS = 2
POPULATION = 4
GENERATIONS = 6              # per epoch
EPOCHS = 2
WELL_FILLED = 0.985          # sequences this full are injected by crossover and stay between rounds
ROUNDS = 3
MEMO_WORDS = 2_000_000         # encoded words a Python worker remembers before it starts anew

_TAIL = ".,;:!?)&%$*#|"       # may follow a word's letters; apostrophes are left to the tokenizer


class _OtherSpace(Exception):
    """The text has white space, or a token of its own, that words alone do not tell apart."""


class Encoder(dict):
    """Token ids as little-endian uint32 bytes; a dictionary that remembers the ids of words.

    Pre-tokenisation of a byte-level BPE always starts a token at a single
    space, makes a single line feed one token, and ends a run of letters at
    other characters; so a text without other white space is the
    concatenation of its words, and a word of its letters and what follows.
    Texts with any other white space, or with the string of an added token
    such as <|endoftext|>, are encoded whole.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # strings that the tokenizer takes for tokens of their own, wherever they stand
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [x for x in range(256) if x not in printable]
        self.written = {x: 256 + k for k, x in enumerate(others)}
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        """``word``: as in the text, with the space before it if there is one; a line feed is written as \\x00."""
        head, tail = word, b""
        body = word[2:] if word[:2] == " \x00" else word[1:] if word[:1] == " " else word
        if body.split() != [body]:
            raise _OtherSpace
        if word[:2] == " \x00":
            ids = self.newline + self[body]
        else:
            stem = word.rstrip(_TAIL)
            if stem != word and stem[-1:].isalpha():
                head, tail = stem, self[word[len(stem):]]
            if head.strip(" ").isalpha():     # one pre-token: no need for the whole pipeline
                found = [t.id for t in self.tokenizer.model.tokenize(head.encode().decode("latin-1").translate(self.written))]
            else:
                found = self.tokenizer.encode(head, add_special_tokens=False).ids
            ids = array("I", found).tobytes() + tail
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > MEMO_WORDS:
            self.clear()
        out = []
        for text in texts:
            try:
                if "\x00" in text or "\x01" in text or any(s in text for s in self.added):
                    raise _OtherSpace
                # a marker keeps each later word's space, and line feeds, as units of their own
                words = text.replace("\n", " \x00").replace(" ", "\x01 ").split("\x01")
                out.append(b"".join(map(self.__getitem__, words)))
            except _OtherSpace:
                out.append(self._whole(text))
        return out


def _encoder(path: str) -> Encoder:
    encoders = worker_cache("packing")
    if path not in encoders:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoders[path] = Encoder(path)
    return encoders[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than ``capacity``."""
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked, ``ids`` (array<int>)."""
    ship_package(docs.sparkSession)
    small_arrow_batches(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_path)
        for frame in frames:
            for at in range(0, len(frame), 64):
                part, out = frame.iloc[at:at + 64], []
                texts = ["" if t is None else t for t in part["t"]]
                for doc_id, raw in zip(part["i"], encoder.encode(texts)):
                    raw += end
                    for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                        ids = raw[4 * start:4 * (start + length)]
                        row = (doc_id, k, start, length, zlib.crc32(ids))
                        out.append(row + (np.frombuffer(ids, dtype="<i4"),) if with_ids else row)
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    # nullable ids stay exact as strings between pandas and Spark
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    made = rows.mapInPandas(run, schema.replace(f"doc_id {kind}", "doc_id string"))
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


# --- the genetic algorithm on one pool: a solution is a list of bins, a bin a list of item numbers ---

def best_fit(bins: list[list[int]], items: list[int], size: list[int], capacity: int) -> list[list[int]]:
    """Put ``items`` (in order) into the fullest bin that has room, opening bins as needed."""
    rooms: dict[int, list[int]] = {}
    mask = 0
    for k, b in enumerate(bins):
        room = capacity - sum(size[i] for i in b)
        if room:
            rooms.setdefault(room, []).append(k)
            mask |= 1 << room
    for i in items:
        s = size[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            k = stack.pop()
            if not stack:
                mask &= ~(1 << room)
            bins[k].append(i)
        else:
            k, room = len(bins), capacity
            bins.append([i])
        if room > s:
            rooms.setdefault(room - s, []).append(k)
            mask |= 1 << (room - s)
    return bins


def fitness(bins: list[list[int]], size: list[int]) -> tuple[int, int]:
    """Smaller is better: sequences, then minus the sum of squared fills."""
    return len(bins), -sum(sum(size[i] for i in b) ** 2 for b in bins)


def cross(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of ``b`` whole into ``a``; bins of ``a`` that share their items are dissolved
    and the displaced items best-fitted, longest first."""
    good = [x for x in b if sum(size[i] for i in x) >= WELL_FILLED * capacity]
    injected = [x for x in good if rng.random() < 0.5]
    moved = {i for x in injected for i in x}
    kept, displaced = [], []
    poor = WELL_FILLED * capacity
    for x in a:
        if moved.isdisjoint(x) and (sum(size[i] for i in x) >= poor or rng.random() < 0.7):
            kept.append(list(x))
        else:
            displaced.extend(i for i in x if i not in moved)
    displaced.sort(key=lambda i: size[i] * (1 + 0.05 * rng.random()), reverse=True)
    return best_fit(kept + [list(x) for x in injected], displaced, size, capacity)


def evolve(size: list[int], population: list[list[list[int]]], capacity: int, seed: int) -> list[list[int]]:
    """The best solution after GENERATIONS generations from ``population``, filled up with noisy best-fit-decreasing."""
    rng = random.Random(seed)
    while len(population) < POPULATION:
        noise = 0.0 if not population else 0.15
        order = sorted(range(len(size)), key=lambda i: size[i] * (1 + noise * rng.random()), reverse=True)
        population.append(best_fit([], order, size, capacity))
    ranked = sorted(((fitness(p, size), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    bound = -(-sum(size) // capacity)
    births = len(ranked)
    for _ in range(GENERATIONS):
        if ranked[0][0][0] == bound:
            break
        a, b = rng.sample(range(len(ranked)), 2)
        child = cross(ranked[min(a, b)][2], ranked[max(a, b)][2], size, capacity, rng)
        births += 1
        ranked = sorted([*ranked, (fitness(child, size), births, child)], key=lambda x: x[:2])[:POPULATION]
    return ranked[0][2]


def _epoch(pool: DataFrame, capacity: int, seed: int) -> DataFrame:
    """Evolve each (pool, island) once. Rows: pool, island, uid, length, bin (of the elite it starts from), origin."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.drop_duplicates("uid").sort_values("uid")
        uid, size = own["uid"].tolist(), own["length"].tolist()
        number = {u: k for k, u in enumerate(uid)}
        population = []
        for _, elite in frame[frame["bin"] >= 0].groupby("origin", sort=True):
            bins: dict[int, list[int]] = {}
            for u, b in zip(elite["uid"], elite["bin"]):
                bins.setdefault(b, []).append(number[u])
            population.append(list(bins.values()))
        island, number_of = int(frame["island"].iloc[0]), int(frame["pool"].iloc[0])
        best = evolve(size, population, capacity, seed * 1_000_003 + number_of * 101 + island)
        out, score = [], fitness(best, size)
        for k, b in enumerate(best):
            at = 0
            fill = sum(size[i] for i in b)
            for i in b:
                out.append((number_of, island, uid[i], size[i], k, island, at, fill, score[0], score[1]))
                at += size[i]
        return pd.DataFrame(out, columns=["pool", "island", "uid", "length", "bin", "origin", "offset", "fill", "bins", "score"])

    return pool.groupBy("pool", "island").applyInPandas(
        run, "pool long, island int, uid long, length long, bin int, origin int, offset long, fill long, bins int, score long")


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (from :func:`pieces`) with sequence_id and offset."""
    stored = scratch_table(made.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    full = stored.filter(F.col("length") == capacity).select(
        F.col("__uid"), (-1 - F.col("__uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = stored.filter(F.col("length") < capacity).select(F.col("__uid").alias("uid"), "length")
    placed = [full]
    count = open_.count()
    for turn in range(ROUNDS):
        if not count:
            break
        pools = -(-count // POOL_ITEMS)
        last = turn == ROUNDS - 1 or pools == 1
        dealt = open_.withColumn("pool", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(pools)))
        state = (dealt.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])))
                 .withColumns({"bin": F.lit(-1), "origin": F.lit(-1)}))
        for epoch in range(EPOCHS):
            elite = scratch_table(_epoch(state, capacity, 7 + turn * EPOCHS + epoch), f"elite-{turn}-{epoch}")
            travels = elite.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
            state = elite.unionByName(travels).select("pool", "island", "uid", "length", "bin", "origin")
        best = (elite.groupBy("pool").agg(F.min(F.struct("bins", "score", "island")).alias("best"))
                .select("pool", F.col("best.island").alias("island")))
        chosen = elite.join(best, ["pool", "island"])
        done = F.lit(True) if last else F.col("fill") >= WELL_FILLED * capacity
        number = ((F.lit(turn) * F.lit(1 << 38) + F.col("pool")) * F.lit(1 << 20) + F.col("bin")).cast("long")
        placed.append(chosen.filter(done).select(F.col("uid").alias("__uid"), number.alias("sequence_id"), "offset"))
        if last:
            break
        open_ = chosen.filter(~done).select("uid", "length")
        count = open_.count()
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    return stored.join(where, "__uid").drop("__uid")


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences of :func:`pack` over pieces with ids: sequence_id, ids, doc_ids; at most a capacity each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
