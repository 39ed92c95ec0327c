"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1, made from its code point
by rule, so there is no alphabet to learn. An n-gram's vector is the product of
its letters' vectors, each rotated by its place; a document's is the sum over
all its n-grams, and a language's prototype the sum over its training
documents, each scaled to length one so that no long text outweighs others.
Documents are compared with prototypes by cosine, after what all languages have
in common (their mean) is taken from both. The greatest cosine decides, and is
the score (0 if it is negative).

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and trains nothing; a null lang trains nothing; a null doc_id reads as an empty
string (remainder 0: it trains); without any prototype all are ``und``; ties
go to the first language in order; every row is predicted, repeated rows too;
very long texts are read whole; columns other than doc_id, text and lang are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require
from .lm_scoring import fold

DIMENSIONS = 1024
GRAM = 3
#: Languages whose prototypes are sent to a task at once, 4 KB each; more are compared in several passes.
MAX_LANGUAGES = 4096
#: n-gram vectors that a worker keeps: 1 KB each.
CACHE = 100_000


class Encoder:
    """Texts to document vectors; keeps the vectors of n-grams it has met, CACHE at most."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, bool)
        self.seen = np.zeros(0x110000, bool)
        self.forget()

    def forget(self) -> None:
        self.codes = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([7, code]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the n-grams of the lower-cased letters and how often each stands there; runs of other characters are one space."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        new = code[~self.seen[code]]
        for c in np.unique(new):
            self.seen[c], self.is_letter[c] = True, chr(c).isalpha()
        letter = self.is_letter[code]
        if not letter.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.concatenate([[32], np.where(letter, code, 32), [32]])
        code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
        n = len(code) - GRAM + 1
        gram = np.zeros(n, np.int64)
        for i in range(GRAM):
            gram = (gram << 21) | code[i : i + n]
        return np.unique(gram, return_counts=True)

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of these n-grams."""
        i = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = i < len(self.codes)
        known[inside] = self.codes[i[inside]] == codes[inside]
        if not known.all():
            new = codes[~known]
            if len(self.codes) + len(new) > CACHE:
                self.forget()
                new = codes
            made = np.ones((len(new), self.dimensions), np.int8)
            for k in range(GRAM):
                part = (new >> (21 * (GRAM - 1 - k))) & 0x1FFFFF
                distinct, at = np.unique(part, return_inverse=True)
                made *= np.stack([np.roll(self.letter(int(c)), GRAM - 1 - k) for c in distinct])[at]
            order = np.argsort(all_codes := np.concatenate([self.codes, new]), kind="stable")
            rows = np.concatenate([self.rows, np.arange(len(self.vectors), len(self.vectors) + len(new))])
            self.codes, self.rows = all_codes[order], rows[order]
            self.vectors = np.concatenate([self.vectors, made])
            i = np.searchsorted(self.codes, codes)
        return self.vectors[self.rows[i]]

    def vector(self, text: str | None) -> np.ndarray | None:
        """The document's vector, or None without a letter."""
        codes, n = self.grams(text or "")
        if not len(codes):
            return None
        out = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(codes), 4096):
            out += n[at : at + 4096].astype(np.float32) @ self.matrix(codes[at : at + 4096]).astype(np.float32)
        return out


def prototypes(train: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The summed vectors of each language's documents. Each task sends one vector per language; they are added up by a shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                v = encoder.vector(text.as_py())
                if v is not None and (length := float(np.linalg.norm(v))):
                    sums[lang] = sums.get(lang, 0) + v.astype(float) / length
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions), pa.int32()), pa.array(np.round(v * 1e9).astype(np.int64))], names=["lang", "i", "v"])

    parts = train.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(task, "lang string, i int, v long")
    # Whole numbers, so that the order of adding changes nothing.
    summed = parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v"))
    found = summed.select("lang", F.transform("v", lambda x: x["v"]).alias("v")).toArrow()  # one vector per language
    return dict(sorted((lang, v.values.to_numpy().astype(float)) for lang, v in zip(found.column("lang").to_pylist(), found.column("v"), strict=True)))


def identify(docs: DataFrame, folds: int = 4, held: int = 2, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows of the other folds that have a lang."""
    require(docs, "doc_id", "text", "lang")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), (fold(F.col("doc_id"), folds) == held).alias("held_out"))
    learned = prototypes(rows.filter(~F.col("held_out")), dimensions)
    names = list(learned)
    raw = np.array([learned[x] / (np.linalg.norm(learned[x]) or 1) for x in names]).reshape(-1, dimensions)
    mean = raw.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    apart = raw - mean
    apart /= np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)
    out = rows.select("doc_id", "text", "held_out", F.lit("und").alias("lang_pred"), F.lit(-1.0).alias("score"))
    for at in range(0, len(names), MAX_LANGUAGES):
        out = _compared(out, names[at : at + MAX_LANGUAGES], apart[at : at + MAX_LANGUAGES], mean, at + MAX_LANGUAGES < len(names))
    return out.select("doc_id", "held_out", "lang_pred", F.greatest("score", F.lit(0.0)).alias("score"))


def _compared(rows: DataFrame, names: list[str], apart: np.ndarray, mean: np.ndarray, more: bool) -> DataFrame:
    """rows, with lang_pred and score where one of these languages is nearer than what they have; without texts if there are no more languages."""
    dimensions = apart.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((apart.astype(np.float32), (mean / max(float(np.linalg.norm(mean)), 1e-12)).astype(np.float32)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions)
        away, common = shared.value
        for batch in batches:
            langs, scores = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for k, text in enumerate(batch.column(1)):
                v = encoder.vector(text.as_py())
                if v is None:
                    continue
                v = v - common * float(common @ v)
                cosines = away @ (v / max(float(np.linalg.norm(v)), 1e-12))
                best = int(np.argmax(cosines))
                if cosines[best] > scores[k]:
                    langs[k], scores[k] = names[best], min(1.0, float(cosines[best]))
            found = {"doc_id": batch.column(0), "text": batch.column(1), "held_out": batch.column(2), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([v for k, v in found.items() if more or k != "text"], names=[k for k in found if more or k != "text"])

    return rows.mapInArrow(task, f"doc_id long, {'text string, ' if more else ''}held_out boolean, lang_pred string, score double")
