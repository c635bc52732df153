"""Language identification with string kernels.

The kernel is the blended spectrum of presence: two texts' n-grams of one to three
characters, each counted once, cosine-normalised. A few landmark texts span a Nyström
approximation, in which one ridge regression per language is solved at once; a text's
scores are the product of its kernel row with the landmarks and the solved weights,
taken for a batch of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Learning rows: at most this many texts of each language, the first by hashed text; of these the first are landmarks.
ROWS, LANDMARKS = 400, 48
#: Learning rows and landmarks of all languages together, as long as each language has one: with many languages each has fewer.
ALL_ROWS, ALL_LANDMARKS = 100_000, 512
#: Characters of a text whose n-grams are numbered at once.
CHUNK = 1 << 20
BLANK, BITS = 1, 21


def presence(text: str) -> np.ndarray:
    """The sorted numbers of a whole text's distinct n-grams, n from 1 to 3 characters, in lower case; runs of ASCII that is no letter count as one blank.

    An n-gram's number is its characters' code points side by side, so no two share one.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if not len(codes):
        return np.empty(0, np.int64)
    codes[(codes < 97) | (codes > 122) & (codes < 128)] = BLANK
    codes = codes[np.concatenate(([True], (codes[1:] > BLANK) | (codes[:-1] > BLANK)))]
    found = []
    for at in range(0, len(codes), CHUNK):  # neighbours overlap by two, so no n-gram is lost between them
        part = codes[max(0, at - 2) : at + CHUNK]
        two = part[:-1] << BITS | part[1:]
        three = two[:-1] << BITS | part[2:]
        found.append(np.unique(np.concatenate((part, two, three))))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


@dataclass
class Model:
    """grams: sorted numbers of the landmarks' n-grams; spans: grams x landmarks, cosine-normalised; weights: landmarks x languages."""

    languages: list[str]
    grams: np.ndarray
    spans: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (their n-grams) with the landmarks: one matrix product."""
        rows = np.zeros((len(texts), len(self.grams)), np.float32)
        for row, grams in zip(rows, texts, strict=True):
            at = np.searchsorted(self.grams, grams)
            at[at == len(self.grams)] = 0
            row[at[self.grams[at] == grams]] = 1 / np.sqrt(max(1, len(grams)))
        return rows @ self.spans

    def predict(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the likeliest languages and their scores (0 to 1)."""
        values = self.kernel(texts) @ self.weights
        best = values.argmax(axis=1)
        return best, np.clip(values[np.arange(len(texts)), best], 0.0, 1.0)


def _first_keys(rows: int):
    """The rows least distinct keys of each language among a partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes, keys = langs.indices.to_numpy(), batch.column(1).to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                held[lang] = np.unique(np.concatenate((held.get(lang, keys[:0]), keys[codes == code])))[:rows]
        for lang, keys in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64())], names=["lang", "key"])

    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model | None:
    """Learns from docs' texts and non-null languages; None where there is none.

    Of each language rows distinct texts are used, the first by hashed text, or all where
    there are fewer; copies do not count. Landmarks of these span the approximation. With so
    many languages that ALL_ROWS or ALL_LANDMARKS would be exceeded, each has its share, one
    at least. Where no text has a character but blanks nothing is learned, and all is und.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("key"), "text")
    languages = docs.select(F.col(lang_col).cast("string").alias("lang")).where("lang is not null").distinct().count()
    if not languages:
        return None
    rows, landmarks = max(1, min(rows, ALL_ROWS // languages)), max(1, min(landmarks, ALL_LANDMARKS // languages))
    # each partition keeps its own first keys of a language, so that what is shuffled and sorted is bounded by these
    keys = texts.select("lang", "key").mapInArrow(_first_keys(rows), "lang string, key long").distinct()
    first = keys.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("r") <= rows)
    # of at most ALL_ROWS keys, or one a language
    chosen = texts.join(F.broadcast(first) if languages <= ALL_ROWS else first, ["lang", "key"]).groupBy("lang", "key", "r").agg(F.first("text").alias("text"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([presence(x.as_py()) for x in batch.column(2)], pa.list_(pa.int64()))], names=["lang", "r", "grams"])

    found = sorted(chosen.select("lang", "r", "text").mapInArrow(numbered, "lang string, r int, grams array<long>").collect(), key=lambda x: (x["lang"], x["r"]))
    found = [r for r in found if r["grams"]]
    if not found:
        return None
    languages = sorted({r["lang"] for r in found})
    sets = [np.asarray(r["grams"], np.int64) for r in found]
    marks = [s for s, r in zip(sets, found, strict=True) if r["r"] <= landmarks] or sets[:1]
    grams = np.unique(np.concatenate(marks))
    spans = np.zeros((len(grams), len(marks)), np.float32)
    for k, s in enumerate(marks):
        spans[np.searchsorted(grams, s), k] = 1 / np.sqrt(len(s))
    model = Model(languages, grams, spans, np.zeros((len(marks), len(languages)), np.float32))
    among = (spans.T @ spans).astype(float)
    values, vectors = np.linalg.eigh(among)
    good = values > 1e-6 * values.max()
    map_ = vectors[:, good] / np.sqrt(values[good])  # kernel row -> Nyström features
    x = model.kernel(sets).astype(float) @ map_
    names = np.array([languages.index(r["lang"]) for r in found])
    y = np.zeros((len(found), len(languages)))
    y[np.arange(len(found)), names] = 1.0
    weight = (1 / np.bincount(names, minlength=len(languages)))[names] * len(found) / len(languages)  # each language counts alike
    solved = np.linalg.solve((x * weight[:, None]).T @ x + ridge * np.eye(x.shape[1]) * len(found) / 100, (x * weight[:, None]).T @ y)
    model.weights = (map_ @ solved).astype(np.float32)
    return model


UNKNOWN = "und"


def _identify(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                known = [model is not None and any(map(str.isalpha, t)) for t in texts]
                langs, values = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if rows := [k for k, x in enumerate(known) if x]:
                    best, score = model.predict([presence(texts[k]) for k in rows])
                    for k, b, s in zip(rows, best, score, strict=True):
                        langs[k], values[k] = model.languages[b], float(s)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(values, pa.float64())], names=["id", "lang", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score) of every row: the likeliest learned language of the whole text.

    A text that is null or has no letter is und with score 0, as is every text where
    nothing was learned. Ties go to the first language by code point. Repeated rows and
    null ids come back as they are; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_identify(model), f"id {kind}, lang string, score double")
