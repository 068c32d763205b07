"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of its own, drawn by its code
point. A letter trigram is bound from the three, the first permuted twice and
the second once; a text is the bundle (sum) of its trigrams, a language the
bundle of its training texts. A text has the language whose profile is nearest
by cosine.

Letters are taken in lower case, whatever their script; everything else is a
word boundary, a symbol with a vector as well; trigrams have a letter in the
middle. Texts are reduced to counts of trigrams first.

Defined results. A text that is null or has no letter is ``und`` with score 0,
as is every text when nothing could be learned. Ties go to the language that
sorts first. Texts are taken whole: long ones add up by pieces. Repeated rows
are judged, and in training counted, each for itself. An empty table gives no
row and teaches nothing. Training reads every row with a language outside the
held-out fold; each task bundles what it reads into one vector a language, and
the driver sees their sums. Further columns pass through; columns that have the
names of the results give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from newsloom.llm.arrow import portions, settled
from newsloom.llm.names import without

DIMENSIONS = 1024
SEED = 20
PIECE = 1 << 20
#: Trigrams whose vectors a task keeps at hand (16 MB), and whose counts it keeps apart for a language.
GRAMS_HELD = 1 << 14
_BITS, _LOW = np.int64(21), np.int64((1 << 21) - 1)


def symbol(point: int) -> int:
    """The code point of a letter in lower case; 0, the boundary, for what is no letter."""
    letter = chr(point)
    return ord(letter.lower()[0]) if letter.isalpha() else 0


@lru_cache(maxsize=1)
def _plane() -> np.ndarray:
    return np.fromiter(map(symbol, range(0x10000)), np.int32, 0x10000)


@lru_cache(maxsize=4096)
def letter_vector(point: int) -> np.ndarray:
    return np.random.default_rng([SEED, point]).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams, a row each."""
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for place in range(3):
        points, at = np.unique((grams >> (_BITS * np.int64(2 - place))) & _LOW, return_inverse=True)
        letters = np.array([np.roll(letter_vector(int(p)), 2 - place) for p in points], np.int8).reshape(-1, DIMENSIONS)
        out *= letters[at]
    return out


class Grams:
    """The vectors of trigrams, kept while a task runs; as many as ``GRAMS_HELD``."""

    def __init__(self):
        self.known, self.rows = np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.int8)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The rows of sorted distinct trigrams."""
        new = grams[~np.isin(grams, self.known, assume_unique=True)]
        if len(new):
            if len(self.known) + len(new) > GRAMS_HELD:
                self.__init__()
                new = grams
            if len(new) > GRAMS_HELD:
                return gram_vectors(new)
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.rows = known[order], np.concatenate([self.rows, gram_vectors(new)])[order]
        return self.rows[np.searchsorted(self.known, grams)]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text, sorted, and how often each occurs."""
    found, times, carry = [], [], np.zeros(1, np.int32)
    for at in range(0, len(text or ""), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _plane()[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF):
            codes[i] = symbol(int(points[i]))
        codes = np.concatenate([carry, codes, np.zeros(int(at + PIECE >= len(text)), np.int32)])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        wide = codes.astype(np.int64)
        grams = ((wide[:-2] << (2 * _BITS)) | (wide[1:-1] << _BITS) | wide[2:])[wide[1:-1] != 0]
        some, n = np.unique(grams, return_counts=True)
        found.append(some)
        times.append(n)
        carry = codes[-2:]
    if len(found) == 1:
        return found[0], times[0]
    return _summed(found, times)


def _summed(grams: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    some, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(len(some), np.int64)
    np.add.at(total, at, np.concatenate(times))
    return some, total


def bundle(grams: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sum of trigram vectors, each as often as it occurs; whole numbers, so any order of adding gives the same."""
    out = np.zeros(DIMENSIONS, np.int64)
    for lo in range(0, len(grams), 2048):
        out += (times[lo : lo + 2048].astype(float) @ gram_vectors(grams[lo : lo + 2048]).astype(float)).astype(np.int64)
    return out


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def train(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages and their profiles, a row each of length one."""

    def run(batches):
        waiting: dict[str, tuple[list, list]] = {}
        bundles: dict[str, np.ndarray] = {}

        def close(lang):
            some, total = _summed(*waiting.pop(lang))
            bundles[lang] = bundles.get(lang, 0) + bundle(some, total)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                some, n = counts(text)
                if len(some):
                    own = waiting.setdefault(lang, ([], []))
                    own[0].append(some)
                    own[1].append(n)
                    if len(own[0]) == 256:
                        waiting[lang] = tuple([x] for x in _summed(*own))
                        if len(waiting[lang][0][0]) > GRAMS_HELD:
                            close(lang)
        for lang in list(waiting):
            close(lang)
        for lang, total in bundles.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], names=["lang", "at", "n"])

    rows = documents.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).where("lang is not null and t is not null").mapInArrow(settled(run), "lang string, at int, n long")
    table = rows.groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(table["lang"].unique())
    profiles = np.zeros((len(langs), DIMENSIONS))
    for k, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        profiles[k, own["at"].to_numpy()] = own["n"].to_numpy(float)
        profiles[k] /= np.linalg.norm(profiles[k]) or 1
    return langs, profiles.astype(np.float32)


def nearest(texts: list[str | None], langs: list[str], profiles: np.ndarray, grams: Grams) -> tuple[list[str], list[float]]:
    found = [counts(t) for t in texts]
    some = [k for k, (g, _) in enumerate(found) if len(g) and langs]
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if some:
        used, at = np.unique(np.concatenate([found[k][0] for k in some]), return_inverse=True)
        bundles = np.zeros((len(some), DIMENSIONS), np.float32)
        dense = np.zeros((len(some), len(used)), np.float32)
        dense[np.repeat(np.arange(len(some)), [len(found[k][0]) for k in some]), at] = np.concatenate([found[k][1] for k in some])
        for lo in range(0, len(used), 4096):
            bundles += dense[:, lo : lo + 4096] @ grams(used[lo : lo + 4096]).astype(np.float32)
        cosines = bundles @ profiles.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
        best = cosines.argmax(axis=1)
        for row, k in enumerate(some):
            names[k], scores[k] = langs[best[row]], float(min(1.0, max(0.0, cosines[row, best[row]])))
    return names, scores


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``documents`` with lang_pred and score (or other names) behind its columns; nothing but the text is an input."""
    langs, profiles = model
    held = documents.sparkSession.sparkContext.broadcast((langs, profiles))
    documents = documents.select(*[F.col(f"`{c}`") for c in without(documents.columns, [lang_name, score_name])])
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        (known, rows), grams = held.value, Grams()
        for batch in batches:
            for part in portions(batch, 128):
                names, scores = nearest(part.column(at).to_pylist(), known, rows, grams)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang_name, score_name])

    return documents.mapInArrow(settled(run), StructType([*documents.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())]))


def digest(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    rows = documents.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train(rows.where("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
