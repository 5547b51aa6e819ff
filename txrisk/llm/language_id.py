"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1..3, letters
and word ends only) present in both, normalised by the two texts' own counts.
Nystroem landmarks -- training texts of every language -- stand for the whole
training set; one-versus-rest kernel ridge regression on them gives one
score per language. A text is scored by two matrix products per batch: its
n-gram presence against the landmarks', and the kernel values against the
ridge coefficients. The feature space is the n-grams of the landmarks.

The model is fitted on a bounded, documented sample of labelled rows (at most
TRAIN_ROWS texts); its n-gram sets are computed on the executors and only
they reach the driver. Scoring is one pass over whole texts, in Arrow batches.

Defined results: null texts and texts without a letter are ``und`` with
score 0, as is everything when no labelled row was given. Ties go to the
first language by code point. Other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import free_name, ship_package, small_arrow_batches, worker_cache

TRAIN_PER_LANGUAGE, TRAIN_ROWS = 300, 4096      # the bounds of the training sample
LANDMARKS_PER_LANGUAGE, LANDMARKS = 32, 512
RIDGE = 1e-3
UNKNOWN = "und"
MIN_SCORE = 0.2                                 # below this a document counts as in no known language

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_BITS = 21                                      # a code point
_TABLE_CELLS = 1 << 22                          # larger n-gram spaces are looked up by binary search
_BATCH = 128                                    # texts per matrix product


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters one space, a space at both ends."""
    flat = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def grams_of(text: str) -> np.ndarray:
    """Sorted distinct n-grams (n = 1..3), each three code points in one integer."""
    c = letters_of(text)
    pairs = c[:-1] | (c[1:] << _BITS)
    return np.unique(np.concatenate([c, pairs, pairs[:-1] | (c[2:] << 2 * _BITS)]))


@dataclass
class Model:
    """Presence lookup of the landmark n-grams, landmark matrix and ridge coefficients."""

    languages: list[str]
    chars: np.ndarray        # alphabet, sorted code points
    grams: np.ndarray        # landmark n-grams, sorted
    landmarks: np.ndarray    # landmarks x grams, rows divided by the square root of their count
    alpha: np.ndarray        # landmarks x languages

    def __post_init__(self):
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[self.chars] = np.arange(1, len(self.chars) + 1)
        self.base = len(self.chars) + 1
        parts = [self.grams & ((1 << _BITS) - 1), (self.grams >> _BITS) & ((1 << _BITS) - 1), self.grams >> 2 * _BITS]
        one, two, three = (self.classes[p] for p in parts)
        length = 1 + (two > 0).astype(int) + (three > 0)
        code = one.astype(np.int64)
        code[length >= 2] = code[length >= 2] * self.base + two[length >= 2]
        code[length == 3] = code[length == 3] * self.base + three[length == 3]
        self.lookup = []
        for n in (1, 2, 3):
            where = np.flatnonzero(length == n)
            if self.base**n <= _TABLE_CELLS:
                table = np.full(self.base**n, len(self.grams), dtype=np.int32)
                table[code[where]] = where
                self.lookup.append((table, None))
            else:
                order = where[np.argsort(code[where])]
                self.lookup.append((code[order], order.astype(np.int32)))

    def _features(self, n: int, codes: np.ndarray) -> np.ndarray:
        first, second = self.lookup[n - 1]
        if second is None:
            return first[codes]
        at = np.minimum(np.searchsorted(first, codes), len(first) - 1)
        return np.where(first[at] == codes, second[at], len(self.grams)) if len(first) else np.full(len(codes), len(self.grams))

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.grams) + 1), dtype=bool)
        for row, text in zip(out, texts):
            # pieces of a very long text overlap by two characters, so no n-gram is lost
            c = letters_of(text)
            for at in range(0, len(c), 1 << 20):
                one = self.classes[c[at:at + (1 << 20) + 2]].astype(np.int64)
                two = one[:-1] * self.base + one[1:]
                row[self._features(1, one)] = True
                row[self._features(2, two)] = True
                row[self._features(3, two[:-1] * self.base + one[2:])] = True
        return out[:, :-1]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts x languages; batched matrix products."""
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), _BATCH):
            x = self.presence(texts[at:at + _BATCH]).astype(np.float32)
            own = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            out[at:at + _BATCH] = ((x @ self.landmarks.T) / own) @ self.alpha
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a bounded sample of ``docs`` (rows with a label and a text); None if there is none."""
    ship_package(docs.sparkSession)
    small_arrow_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in docs.filter(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    most = max(1, min(TRAIN_PER_LANGUAGE, TRAIN_ROWS // len(languages)))
    lucky = F.shiftrightunsigned(F.xxhash64(F.lit(23), F.col(id_col)), 33).cast("double") / float(1 << 31)
    share = F.element_at(F.create_map(*[x for la in languages for x in (F.lit(la), F.lit(min(1.0, 1.5 * most / counts[la])))]),
                         F.col(lang_col))

    @F.pandas_udf("binary")
    def grams(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: grams_of(t).tobytes())

    sample = (rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), lucky.alias("u"), share.alias("share"))
              .filter("u <= share").select("lang", "u", grams("text").alias("grams")).collect())
    by: dict[str, list[np.ndarray]] = {la: [] for la in languages}
    for r in sorted(sample, key=lambda r: (r.lang, r.u, bytes(r.grams))):
        if len(by[r.lang]) < most:
            by[r.lang].append(np.frombuffer(r.grams, dtype=np.int64))
    return solve(by)


def solve(by: dict[str, list[np.ndarray]]) -> Model | None:
    """Kernel ridge regression from each language's n-gram sets; the first of each are the landmarks."""
    languages = sorted(la for la, sets in by.items() if sets)
    if not languages:
        return None
    per = max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // len(languages)))
    marks = [s for la in languages for s in by[la][:per]]
    vocabulary = np.unique(np.concatenate(marks))

    def rows(sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(vocabulary)), dtype=np.float32)
        for row, s in zip(x, sets):
            at = np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)
            row[at[vocabulary[at] == s]] = 1
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    train = rows([s for la in languages for s in by[la]])
    y = np.concatenate([np.eye(len(languages))[[k] * len(by[la])] for k, la in enumerate(languages)])
    landmarks = rows(marks)
    k_nm = (train @ landmarks.T).astype(np.float64)
    k_mm = (landmarks @ landmarks.T).astype(np.float64)
    weight = 1 / np.maximum(y.sum(axis=0), 1)           # every language counts alike
    w = (y @ weight)[:, None]
    a = k_nm.T @ (w * k_nm) + RIDGE * k_mm + 1e-8 * np.eye(len(marks))
    alpha = np.linalg.solve(a, k_nm.T @ (w * y))
    code = np.unique(np.concatenate([(vocabulary >> s) & ((1 << _BITS) - 1) for s in (0, _BITS, 2 * _BITS)]))
    return Model(languages, code[code > 0], vocabulary, landmarks, alpha)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    ship_package(docs.sparkSession)
    small_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)       # bounded by the landmarks

    @F.pandas_udf("lang string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_cache("language_id")
        m = shared.value
        names = np.array(m.languages, dtype=object)
        for texts in batches:
            known = texts.notna().to_numpy()
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if known.any():
                f = m.scores(texts[known].tolist())
                top = f.argmax(axis=1)
                lang[known], score[known] = names[top], np.clip(f[np.arange(len(f)), top], 0, 1)
            yield pd.DataFrame({"lang": lang, "score": score})

    spot = free_name(docs, "_p")
    told: Column = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    return docs.withColumn(spot, classify(told)).withColumns(
        {"lang_pred": F.col(f"{spot}.lang"), "score": F.col(f"{spot}.score")}).drop(spot)


def in_known_language(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is recognised: not ``und`` and scored at least ``min_score``."""
    judged = predict(docs.select(*[F.col(c) for c in docs.columns]), model, text_col)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*docs.columns)
