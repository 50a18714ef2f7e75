"""Language identification with a blended-spectrum string kernel.

Two texts are compared by the character n-grams (1 to 3) that are present in both, whatever their number.
A few landmark texts span the model (Nyström): a text's row of kernel values with the landmarks, times the
inverse root of the landmarks' own kernel matrix, is its feature vector, and ridge regression fits one target
per language on it. A batch of texts is scored with matrix products alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bounded sample of labelled rows that the model is fitted on: distinct texts of each language at most, drawn by a hash of the text.
TRAIN_PER_LANG = 300
#: Landmarks of each language, a part of the sample.
LANDMARKS_PER_LANG = 24
ORDERS = (1, 2, 3)
RIDGE = 1e-2
#: Sharpness with which the regressions' values become shares that add up to one.
SHARPNESS = 6.0
#: Characters whose n-grams are computed at once, and numbers of a presence matrix.
CHUNK_CHARS = 200_000
CELLS = 1 << 21
UNKNOWN = "und"
#: Bits of a character in an n-gram's code: 1 stands for a blank or anything else that is no letter, a letter is its code point and 2.
CHAR_BITS = 21
BLANK = 1
#: Slots of the n-gram table for each n-gram in it, at least.
ROOM = 8

OUT = "lang_pred string, score double"


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Per code point: its part of an n-gram's code, whatever the script."""
    known = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(known, np.arange(0x110000) + 2, BLANK).astype(np.int64)


class GramTable:
    """n-gram code -> column, in a table with open addressing that is looked up for many codes at once."""

    def __init__(self, codes: np.ndarray):
        """codes: ascending and distinct; a code's place is its column."""
        self.width = len(codes)
        bits = max(8, int(ROOM * max(1, len(codes)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        # runs of full slots may go beyond the end, so there is room for them
        self.codes, self.columns = np.zeros((1 << bits) + len(codes) + 1, np.int64), np.full((1 << bits) + len(codes) + 1, -1, np.int32)
        self.probes, left, at = 0, np.arange(len(codes)), self.slots(codes)
        while len(left):
            slot = at[left] + self.probes
            self.probes += 1
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            takes = first & (self.codes[slot] == 0)
            self.codes[slot[takes]], self.columns[slot[takes]] = codes[left[takes]], left[takes]
            left = left[~takes]

    def slots(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, columns): which of the codes are known, and their columns."""
        at, on = self.slots(codes), None
        places, columns = [], []
        for _ in range(self.probes):
            seen = self.codes[at]
            hit = np.flatnonzero(seen == codes)
            places.append(hit if on is None else on[hit])
            columns.append(self.columns[at[hit]])
            more = np.flatnonzero((seen != 0) & (seen != codes))
            if not len(more):
                break
            on = more if on is None else on[more]
            at, codes = at[more] + 1, codes[more]
        return (np.concatenate(places), np.concatenate(columns)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int32))


@dataclass
class Model:
    langs: list[str]
    grams: GramTable  # the landmarks' n-grams
    landmarks: np.ndarray  # their presence rows
    weights: np.ndarray  # landmarks x languages: the inverse root of the kernel, times the regression
    bias: np.ndarray

    def __post_init__(self) -> None:
        # kernel rows times weights, multiplied from the right: one row of numbers per n-gram
        self.by_gram = (self.landmarks.T @ (self.weights / np.sqrt(np.maximum(self.landmarks.sum(1), 1))[:, None])).astype(np.float32)

    @property
    def width(self) -> int:
        return max(1, self.grams.width)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def gram_codes(letters: np.ndarray, order: int) -> np.ndarray:
    """Codes of the n-grams that start at each position."""
    n = len(letters) - order + 1
    out = letters[:n].copy()
    for k in range(1, order):
        out <<= CHAR_BITS
        out |= letters[k : n + k]
    return out


def distinct_grams(text: str) -> np.ndarray:
    """The codes of all n-grams of the whole text, each once, ascending; none with two neighbouring blanks, nor the blank."""
    parts = []
    text = f" {text} "
    for at in range(0, len(text), CHUNK_CHARS):
        letters = letter_codes()[code_points(text[at : at + CHUNK_CHARS + max(ORDERS) - 1])]
        blank = letters == BLANK
        letters = letters[~(blank & np.concatenate([[False], blank[:-1]]))]
        parts += [np.unique(gram_codes(letters, n)) for n in ORDERS if len(letters) >= n]
    codes = np.unique(np.concatenate(parts))
    return codes[codes != BLANK]


def presence(texts: list[str], grams: GramTable) -> np.ndarray:
    """One row per text: 1 for every known n-gram that occurs anywhere in the whole text."""
    out = np.zeros((len(texts), max(1, grams.width)), np.float32)
    start = 0
    while start < len(texts):
        end, total = start, 0
        while end < len(texts) and (end == start or total + len(texts[end]) <= CHUNK_CHARS):
            total += len(texts[end])
            end += 1
        for at in range(0, total + 1, CHUNK_CHARS) if end == start + 1 else (0,):
            # a text longer than the chunk comes in pieces that overlap by the longest n-gram
            part = [texts[start][at : at + CHUNK_CHARS + max(ORDERS) - 1]] if end == start + 1 else texts[start:end]
            points = [code_points(f" {t} ") for t in part]
            row = np.repeat(np.arange(start, end), [len(p) for p in points])
            letters = letter_codes()[np.concatenate(points)]
            for order in ORDERS:
                if len(letters) >= order:
                    # n-grams across two texts hold two neighbouring blanks, of which no landmark has one
                    place, column = grams.find(gram_codes(letters, order))
                    out[row[place], column] = 1
        start = end
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams, normalised by the presence counts of both; a text without any known n-gram gets zeros."""
    a, b = x.sum(1, keepdims=True), landmarks.sum(1, keepdims=True)
    return (x @ landmarks.T) / np.sqrt(np.maximum(a, 1) * np.maximum(b, 1).T)


def fit(samples: list[tuple[str, str]]) -> Model:
    """From (text, language) pairs; the first LANDMARKS_PER_LANG of each language become landmarks."""
    return fit_grams([(distinct_grams(t), lang) for t, lang in samples])


def fit_grams(samples: list[tuple[np.ndarray, str]]) -> Model:
    """fit for texts of which the distinct n-grams are known."""
    langs = sorted({lang for _, lang in samples})
    marks = [g for lang in langs for g in [g for g, own in samples if own == lang][:LANDMARKS_PER_LANG]]
    known = np.unique(np.concatenate([*marks, np.zeros(0, np.int64)]))
    grams = GramTable(known)

    def rows(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(some), max(1, len(known))), np.float32)
        for k, g in enumerate(some):
            at = np.minimum(np.searchsorted(known, g), max(0, len(known) - 1))
            out[k, at[known[at] == g] if len(known) else []] = 1
        return out

    landmarks = rows(marks)
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64) if len(marks) else np.zeros((0, 0)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    step = max(1, CELLS // max(1, len(known)))
    phi = np.concatenate([np.zeros((0, len(marks))), *[kernel(rows([g for g, _ in samples[at : at + step]]), landmarks).astype(np.float64) @ root for at in range(0, len(samples), step)]])
    y = np.array([[1.0 if own == lang else -1.0 for lang in langs] for _, own in samples]).reshape(len(samples), len(langs))
    # each language weighs the same, however many samples it has
    times = {lang: sum(own == lang for _, own in samples) for lang in langs}
    w = np.array([1.0 / times[own] for _, own in samples])
    w = w * len(w) / max(1e-12, w.sum())
    ones = np.hstack([phi, np.ones((len(phi), 1))])
    penalty = RIDGE * len(ones) / 10 * np.eye(ones.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve((ones * w[:, None]).T @ ones + penalty, (ones * w[:, None]).T @ y) if len(ones) else np.zeros((1, 0))
    return Model(langs, grams, landmarks, (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """The learned language and its share (0 to 1); `und` and 0 for texts that are null or have no letter."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    which = [i for i, t in enumerate(texts) if has_letter(t)] if model.langs else []
    step = max(1, CELLS // model.width)
    margins = np.zeros((len(which), len(model.langs)), np.float32)
    for at in range(0, len(which), step):
        x = presence([texts[i] for i in which[at : at + step]], model.grams)
        margins[at : at + step] = (x @ model.by_gram) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + model.bias
    shares = np.exp(SHARPNESS * (margins - margins.max(1, keepdims=True))) if len(which) else margins
    for i, m, s in zip(which, margins, shares):
        k = int(m.argmax())
        out[i] = model.langs[k], float(s[k] / s.sum())
    return out


def training_rows() -> Column:
    """Rows that may be learned from."""
    return (F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull()


def fit_documents(docs: DataFrame, where: Column | None = None, per_lang: int = TRAIN_PER_LANG) -> Model:
    """The model from a bounded, hash-drawn sample: per_lang distinct texts of each language, or all if it has fewer.

    Candidates are first thinned by a threshold on the hash, about 4 per_lang distinct texts a language, and copies of a
    text become one row before they are shuffled, so that no group of copies fills or empties a language's sample.
    Of each text of the sample only its distinct n-grams come to the driver. Null texts, texts without letters and null
    languages are not learned from. An empty table gives a model that knows no language and answers `und`.
    """
    rows = docs.select("doc_id", "lang", "text").where(training_rows() if where is None else where).where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.md5("text").alias("digest"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("digest").alias("n")).collect()
    if not counts:
        return fit([])
    draw = F.shiftrightunsigned(F.xxhash64("digest"), 1) / F.lit(float(2**63))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 4.0 * per_lang / r["n"]) if r["n"] > 4 * per_lang else 1.0))])
    drawn = rows.withColumn("draw", draw).where(F.col("draw") <= F.element_at(share, F.col("lang")))
    once = drawn.groupBy("lang", "draw", "digest").agg(F.min("text").alias("text"))
    ranked = once.selectExpr("lang", "text", "row_number() over (partition by lang order by draw, digest) as k").where(F.col("k") <= per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([distinct_grams(t.as_py()).tobytes() for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["k"], grams], ["lang", "k", "grams"])

    got = sorted((r["lang"], r["k"], bytes(r["grams"])) for r in ranked.mapInArrow(run, "lang string, k int, grams binary").collect())
    return fit_grams([(np.frombuffer(g, np.int64), lang) for lang, _, g in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document, from its whole text alone.

    Null texts and texts without a letter are `und` with score 0; repeated rows each give a row; other columns
    of docs are not looked at. The model is a broadcast that grows with the
    languages alone: each has a bounded number of landmarks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = predict(shared.value, part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {OUT}")


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns with them, whose text has a language with at least this share; a null lang becomes it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = predict(shared.value, part["text"].to_pylist())
                langs = [own if own is not None else lang for own, (lang, _) in zip(part["lang"].to_pylist(), got)]
                part = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()) if i == at else c for i, c in enumerate(part.columns)], part.schema.names)
                yield part.filter(pa.array([lang != UNKNOWN and share >= least for lang, share in got]))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_documents(docs)).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")
