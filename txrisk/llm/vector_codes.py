"""Vector codes of a few bytes by product quantisation, trained exactly with Drake-Hamerly adaptive bounds.

Vectors become whole numbers and are cut into equal parts; each part position
has a codebook of a few entries. A round assigns every part to its nearest
entry and moves each entry to the floor of its parts' mean. Rounds run on a
state table in the shared folder with, per vector and part,

* the entry it is assigned to and an upper bound on the distance to it,
* its ``b`` next closest entries with lower bounds in order, and
* one outer bound for all entries that are not listed.

When entries move, the bounds give way by as much. A part whose upper bound
stays under its first lower bound keeps its entry and no distance is
computed. Otherwise the distance to its own entry is computed; then those to
the listed entries whose bounds it reaches; and to all only if it reaches the
outer bound. These distances are whole numbers, so ties fall to the lower
index exactly; bounds are floats widened by more than their rounding and
decide strict cases only. ``b`` starts at a quarter of the entries and shrinks,
per part position, to what all but a few of a round's open parts had to ask;
an eighth of the entries stays listed.

A task writes the new state and, as its last row, the sums of its parts by
entry: one pass per round, and what reaches the driver is the sums of
parts x entries x width numbers, whatever the number of vectors. A lost
executor costs the re-reading of the round before; a state is deleted when
the next one is written.

Defined results: rows whose vector is null or holds a null, NaN or infinite
component are left out. Null ids come after all others; rows that repeat an
id are kept as they are, and where they stand among the smallest ids, the
smaller vector comes first. With fewer rows than entries, the codebooks are
that small. No kept row: no result. All kept vectors must have one length
that the parts divide, and components small enough that distances fit 64
bits (for 64 dimensions, below 32768 in size); others raise ValueError. Null
labels count as one label. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import remove_path, scratch_path, scratch_table, ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LABEL_SALTS = 16            # a label may hold any share of the rows
FEW = 20                    # b is cut so that one in FEW of a round's open parts may ask beyond it
MARGIN = 1e-6               # relative; float32 rounds by less than 1e-7
_NEVER = np.iinfo(np.int64).max
_CHUNK = 4096               # vectors worked on at once

_STATE = "vec array<int>, code binary, upper array<float>, near binary, low array<float>, outer array<float>, totals array<bigint>"


@dataclass
class Codebooks:
    """``entries``[part, entry, position]; ``history`` has, per round, the parts decided by bounds, by some distances, by all."""
    entries: np.ndarray
    history: list[dict] = field(default_factory=list)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def quantised(df: DataFrame, id_col: str, vec_col: str, label_col: str | None, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label`` and ``vec``, floor(scale * x) of every component, of the rows whose components are all finite."""
    fine = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return (df.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(F.col("v").isNotNull() & F.forall("v", fine))
            .select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("vec")))


def _squared(diff: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", diff, diff)


class Assigner:
    """Assigns batches of vectors to ``book``, given the state that ``old`` left."""

    def __init__(self, book: np.ndarray, old: np.ndarray | None, listed: np.ndarray, keep: np.ndarray):
        # listed[p]: entries listed per part position in the state read; keep[p]: in the state written
        self.book, self.listed, self.keep = book, listed, keep
        self.parts, self.k, self.width = book.shape
        self.drift = None if old is None else np.sqrt(_squared(book - old).astype(float)) * (1 + MARGIN)
        self.sums = np.zeros(book.shape, np.int64)
        self.counts = np.zeros(book.shape[:2], np.int64)
        self.asked = np.zeros((self.parts, self.k), np.int64)   # parts by the number of listed entries they asked
        self.by = np.zeros(3, np.int64)         # parts decided by bounds, by some distances, by all

    def _ranked(self, p: int, x: np.ndarray):
        """All entries by (distance, index): entries, squared distances."""
        d = np.stack([_squared(x - e) for e in self.book[p]], axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        return order, np.take_along_axis(d, order, 1)

    def _whole(self, p: int, x: np.ndarray, b: int):
        """code, upper, near, low and outer from all distances."""
        order, d = self._ranked(p, x)
        root = np.sqrt(d.astype(float))
        outer = root[:, b + 1] * (1 - MARGIN) if b + 1 < self.k else np.full(len(x), np.inf)
        return order[:, 0], root[:, 0] * (1 + MARGIN), order[:, 1:b + 1], root[:, 1:b + 1] * (1 - MARGIN), outer

    def part(self, p: int, x: np.ndarray, state):
        """The new state of part position ``p`` of the vectors ``x``."""
        b = int(self.keep[p])
        if state is None:
            self.by[2] += len(x)
            return self._whole(p, x, b)
        code, upper, near, low, outer = state
        if near.shape[1] > b:                       # entries no longer listed fall to the outer bound
            far = (low[:, b:] - self.drift[p][near[:, b:]]).min(axis=1)
            near, low = near[:, :b], low[:, :b]
        else:
            far = np.inf
        upper = upper + self.drift[p][code]
        low = low - self.drift[p][near]
        outer = np.minimum(outer - self.drift[p].max(), far)
        bounds = np.minimum.accumulate(np.column_stack([low, outer])[:, ::-1], axis=1)[:, ::-1]
        low, outer = bounds[:, :-1].copy(), bounds[:, -1].copy()
        code, near, upper = code.copy(), near.copy(), upper.copy()

        open_ = np.flatnonzero(~(upper < bounds[:, 0]))
        self.by[0] += len(x) - len(open_)
        if not len(open_):
            return code, upper, near, low, outer
        own = _squared(x[open_] - self.book[p][code[open_]])
        reach = np.sqrt(own.astype(float)) * (1 + MARGIN)
        upper[open_] = reach
        full = ~(reach < outer[open_])
        some = np.flatnonzero(~full)
        self.by[1] += len(some)
        self.by[2] += int(full.sum())
        if len(some):
            at = open_[some]
            asked = ~(reach[some][:, None] < low[at])               # a prefix of the list, as the bounds are in order
            self.asked[p] += np.bincount(asked.sum(axis=1), minlength=self.k)
            d = np.full((len(at), b + 1), _NEVER)
            d[:, 0] = own[some]
            row, z = np.nonzero(asked)
            d[row, z + 1] = _squared(x[at[row]] - self.book[p][near[at[row], z]])
            entry = np.column_stack([code[at], near[at]])
            bound = np.column_stack([reach[some], low[at]])
            bound[row, z + 1] = np.sqrt(d[row, z + 1].astype(float)) * (1 - MARGIN)
            bound[:, 0] = np.sqrt(own[some].astype(float)) * (1 - MARGIN)
            by_index = np.argsort(entry, axis=1, kind="stable")
            order = np.take_along_axis(by_index, np.argsort(np.take_along_axis(d, by_index, 1), axis=1, kind="stable"), 1)
            entry, bound, d = (np.take_along_axis(a, order, 1) for a in (entry, bound, d))
            code[at], near[at], low[at] = entry[:, 0], entry[:, 1:], bound[:, 1:]
            upper[at] = np.sqrt(d[:, 0].astype(float)) * (1 + MARGIN)
        if full.any():
            at = open_[full]
            code[at], upper[at], near[at], low[at], outer[at] = self._whole(p, x[at], b)
        return code, upper, near, low, outer

    def batch(self, vec: np.ndarray, state):
        """``vec``[row, part, position] and its state per part position -> the new states; sums are kept up."""
        out = []
        for p in range(self.parts):
            new = self.part(p, vec[:, p], None if state is None else state[p])
            np.add.at(self.sums[p], new[0], vec[:, p])
            self.counts[p] += np.bincount(new[0], minlength=self.k)
            out.append(new)
        return out

    def totals(self) -> np.ndarray:
        return np.concatenate([self.sums.ravel(), self.counts.ravel(), self.asked.ravel(), self.by])


def _matrix(column: pa.Array, width: int, what: str) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError(f"vector_codes: every {what} must have {width} components")
    return flat.reshape(len(column), width)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width).astype(np.int64)


def _lists(values: np.ndarray, kind) -> pa.Array:
    n, w = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(values.ravel(), kind))


def _blobs(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values.astype(np.uint8)], pa.binary())


def _vectors(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    vec = _matrix(batch.column("vec"), parts * width, "vector").astype(np.int64)
    if len(vec) and np.abs(vec).max() > most_component(parts * width):
        raise ValueError("vector_codes: components too large for distances in 64 bits")
    return vec.reshape(len(vec), parts, width)


def most_component(dimensions: int) -> int:
    """The size of a quantised component up to which squared distances surely fit a long."""
    return min(2**30, int(np.sqrt(2.0**60 / dimensions)))


def _states(batch: pa.RecordBatch, listed: np.ndarray):
    code, upper = _bytes(batch.column("code"), len(listed)), _matrix(batch.column("upper"), len(listed), "bound").astype(float)
    near, low = _bytes(batch.column("near"), int(listed.sum())), _matrix(batch.column("low"), int(listed.sum()), "bound").astype(float)
    outer = _matrix(batch.column("outer"), len(listed), "bound").astype(float)
    cuts = np.cumsum(listed)[:-1]
    return list(zip(code.T, upper.T, np.split(near, cuts, axis=1), np.split(low, cuts, axis=1), outer.T, strict=True))


def _round(book: np.ndarray, old: np.ndarray | None, listed: np.ndarray, keep: np.ndarray):
    """The task of a round: batches of vectors with their state in, with the new state out, then a row of totals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "label", "vec", "code", "upper", "near", "low", "outer", "totals"]
        work, kinds = Assigner(book, old, listed, keep), None
        for whole in batches:
            for i in range(0, whole.num_rows, _CHUNK):
                b = whole.slice(i, _CHUNK)
                kinds = [b.column("vec_id").type, b.column("label").type]
                vec = _vectors(b, *book.shape[::2])
                new = work.batch(vec, None if old is None else _states(b, listed))
                code, upper, near, low, outer = zip(*new, strict=True)
                yield pa.RecordBatch.from_arrays([
                    b.column("vec_id"), b.column("label"), _lists(vec.reshape(len(vec), -1).astype(np.int32), pa.int32()),
                    _blobs(np.column_stack(code)), _lists(np.column_stack(upper).astype(np.float32), pa.float32()),
                    _blobs(np.column_stack(near)), _lists(np.column_stack(low).astype(np.float32), pa.float32()),
                    _lists(np.column_stack(outer).astype(np.float32), pa.float32()),
                    pa.nulls(len(vec), pa.list_(pa.int64()))], names)
        if kinds:
            null = lambda t: pa.nulls(1, t)
            yield pa.RecordBatch.from_arrays([
                null(kinds[0]), null(kinds[1]), null(pa.list_(pa.int32())), null(pa.binary()), null(pa.list_(pa.float32())),
                null(pa.binary()), null(pa.list_(pa.float32())), null(pa.list_(pa.float32())), _lists(work.totals()[None], pa.int64())], names)
    return run


def _final(book: np.ndarray, old: np.ndarray | None, listed: np.ndarray, keep: np.ndarray):
    """The task of the last assignment: the code in hex and the exact error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Assigner(book, old, listed, keep)
        for whole in batches:
            for i in range(0, whole.num_rows, _CHUNK):
                b = whole.slice(i, _CHUNK)
                vec = _vectors(b, *book.shape[::2])
                code = np.column_stack([s[0] for s in work.batch(vec, None if old is None else _states(b, listed))])
                error = _squared(vec - book[np.arange(len(book)), code]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code.astype(np.uint8)]),
                                                  pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
    return run


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids; None without vectors."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()
    if not first:
        return None
    length = len(first[0].vec)
    if not length or length % parts or any(len(r.vec) != length for r in first):
        raise ValueError(f"vector_codes: all vectors must have one length that {parts} parts divide")
    if max(abs(x) for r in first for x in r.vec) > most_component(length):
        raise ValueError("vector_codes: components too large for distances in 64 bits")
    return np.array([r.vec for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()


def _summed(state: DataFrame) -> np.ndarray:
    """The tasks' totals added up."""
    rows = (state.filter("totals IS NOT NULL").select(F.posexplode("totals").alias("at", "x"))
            .groupBy("at").agg(F.sum("x").alias("s")).collect())
    out = np.zeros(len(rows), np.int64)
    for r in rows:
        out[r["at"]] = r["s"]
    return out


def _shorter(listed: np.ndarray, asked: np.ndarray, least: int) -> np.ndarray:
    """Entries to list per part position: as few as served all but one in FEW of the parts that asked listed entries."""
    served = np.cumsum(asked, axis=1)
    enough = (served * FEW >= served[:, -1:] * (FEW - 1)).argmax(axis=1)
    return np.where(served[:, -1] > 0, np.clip(enough, least, listed), listed)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(state, codebooks, listed, old): ``state`` belongs to the codebooks ``old``; None without vectors."""
    spark = vectors.sparkSession
    ship_package(spark)
    book = first_codebooks(vectors, parts, entries)
    if book is None:
        return None
    k = book.shape[1]
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, {_STATE}"
    least, listed = min(max(1, k // 8), k - 1), np.full(parts, min(max(1, k // 4), k - 1))
    old, keep, state, path, made = None, listed, vectors, None, Codebooks(book)
    for _ in range(rounds):
        written = scratch_path(spark, "vector-state")
        state.mapInArrow(_round(made.entries, old, listed, keep), schema).write.parquet(written)
        if path:
            remove_path(spark, path)
        path, listed = written, keep
        state = spark.read.schema(schema).parquet(path)
        sums, counts, asked, by = np.split(_summed(state), np.cumsum([book.size, parts * k, parts * k]))
        old, moved = made.entries, made.entries.copy()
        used = counts.reshape(parts, k) > 0
        moved[used] = sums.reshape(book.shape)[used] // counts.reshape(parts, k)[used][:, None]
        made.entries = moved
        made.history.append({"by_bounds": int(by[0]), "by_some": int(by[1]), "by_all": int(by[2]), "listed": listed.tolist()})
        keep = _shorter(listed, asked.reshape(parts, k), least)
        state = state.filter("totals IS NULL")
    return state, made, listed, old


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """A row per kept vector: ``vec_id``, ``label``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``."""
    spark = df.sparkSession
    vectors = quantised(df, id_col, vec_col, label_col, scale)
    types = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    trained = train(vectors, parts, entries, rounds)
    if trained is None:
        return spark.createDataFrame([], f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    state, books, listed, old = trained
    coded = scratch_table(state.mapInArrow(_final(books.entries, old, listed, listed),
                                           f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint"), "vector-codes")
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(books.sha256()))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of the label; a hot label's rows are dealt over salts."""
    sums = (coded.groupBy("label").agg(F.sum("error").alias("label_error"))
            .select(F.col("label").alias("sum_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))).alias("sum_salt")))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_SALTS)).cast("int"))
    return (salted.join(sums, F.col("label").eqNullSafe(F.col("sum_label")) & (F.col("salt") == F.col("sum_salt")))
            .select("vec_id", "label", "code", "error", "label_error"))
