"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: n-grams of 1 to 3 letters of the lower-cased text, everything but letters read
  as one space, hashed to 2^16 columns. A value is the n-gram's share of the text times
  its inverse document frequency, so a text's scores are plain sums over its characters.
* Document frequencies are counted over all training documents.
* The weights are learned by follow-the-regularised-leader (FTRL-proximal, per-coordinate
  rates, L1 and L2) on a sample of training documents of each language; the sample's
  expected size is the parameter ``SAMPLE``. L1 leaves few weights, so the model is small.
* A part of that sample is kept from training; one temperature is fitted on it, so that
  scores are calibrated probabilities.

The model (columns x languages, bounded by parameters) is sent to the tasks; texts are
scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed columns; n-gram lengths.
COLUMNS, GRAMS = 1 << 16, (1, 2, 3)
#: Documents of each language in the training sample, on average; the part of them that calibrates.
SAMPLE, HOLD = 1200, 0.2
#: FTRL-proximal: rate, its start, L1, L2, passes over the sample, and the scale of feature values.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.5, 1.0, 1e-3, 1e-4, 2, 4.0
#: Texts are read this many characters at a time; n-grams across the cuts are kept.
PART = 1 << 19
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of anything else as one space, a space at both ends; empty without letters."""
    plain = _OTHER.sub(" ", text.lower()).strip(" ")
    if not any(map(str.isalpha, plain)):  # numerals that are no digits may be left
        return np.zeros(0, np.uint32)
    return np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _columns(codes: np.ndarray, starts: int | None = None) -> np.ndarray:
    """The hashed columns of all n-grams (that start in the first ``starts`` characters), in reading order of each length."""
    parts, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1 :] * np.uint32(0x9E3779B1))
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            parts.append((mixed ^ (mixed >> np.uint32(16))) & np.uint32(COLUMNS - 1))
    parts = [p[:starts] for p in parts]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _features(text: str | None) -> Iterator[np.ndarray]:
    """The columns of a text's n-grams, repeats included, some characters at a time."""
    codes = _codes(text or "")
    for lo in range(0, len(codes), PART):
        yield _columns(codes[lo : lo + PART + max(GRAMS) - 1], PART)


@dataclass
class Model:
    """weights: columns x languages, IDF folded in; temperature divides the scores."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, text: str | None) -> np.ndarray | None:
        """Probabilities of the languages; None for a text without letters."""
        total, n = np.zeros(len(self.languages)), 0
        for columns in _features(text):
            total += np.bincount(columns, minlength=COLUMNS) @ self.weights if len(columns) > COLUMNS // 4 else self.weights[columns].sum(axis=0, dtype=np.float64)
            n += len(columns)
        if not n:
            return None
        return _softmax((total * (SCALE / n) + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4, is 2 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and for each column the documents that hold it, over all of train (column text)."""
    slices = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(COLUMNS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                held = np.zeros(COLUMNS, bool)
                for columns in _features(text.as_py()):
                    held[columns] = True
                seen += held
                n += 1
        for k, part in enumerate(np.split(seen, slices)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([n if not k else 0]), pa.array([part.tobytes()], pa.binary())], ["slice", "spread", "n", "seen"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("seen"))
        return pa.table({"slice": table.column("slice")[:1], "spread": pa.array([0], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())]), "seen": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, spread int, n long, seen binary"
    rows = train.select("text").mapInArrow(count, schema).groupBy("slice", "spread").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema).collect()
    df = np.zeros(COLUMNS, np.int64)
    for r in rows:
        df.reshape(slices, -1)[r.slice] = np.frombuffer(bytes(r.seen), np.int64)
    return sum(r.n for r in rows), df


def _sample(train: DataFrame, size: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, columns, shares) of about ``size`` documents of each language, by a hash of their ids, in that order."""
    per = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in per.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < int(min(1.0, size / n) * (1 << 30))))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for order, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                counts = sum((np.bincount(c, minlength=COLUMNS) for c in _features(text)), np.zeros(COLUMNS, np.int64))
                columns = np.flatnonzero(counts).astype(np.uint32)
                if len(columns):
                    for held, x in zip(out, (order, lang, columns.tobytes(), (counts[columns] / counts.sum()).astype(np.float32).tobytes()), strict=True):
                        held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["o", "lang", "columns", "shares"])

    rows = train.where(wanted).select(F.xxhash64("doc_id", F.lit(11)).alias("o"), "lang", "text").mapInArrow(featurise, "o long, lang string, columns binary, shares binary").collect()
    rows.sort(key=lambda r: (r.o, r.lang, bytes(r.columns)))
    return [(r.lang, np.frombuffer(bytes(r.columns), np.uint32), np.frombuffer(bytes(r.shares), np.float32)) for r in rows]


def _ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last row is the bias) by FTRL-proximal with elastic-net penalties, one document at a time."""
    z, n = np.zeros((COLUMNS + 1, classes)), np.zeros((COLUMNS + 1, classes))

    def weights(at) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(PASSES):
        for y, columns, values in rows:
            at = np.append(columns, COLUMNS)
            x = np.append(values, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.mean(np.log(np.maximum(_softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-12)))
    lo, hi, ratio = np.log(0.2), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the languages that docs label, learned from text and lang; doc_id only draws the sample."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    n, df = _frequencies(known)
    rows = _sample(known, sample)
    languages = sorted({r[0] for r in rows})
    idf = np.log((1 + n) / (1 + df)) + 1
    number = {x: k for k, x in enumerate(languages)}
    data = [(number[x], columns, shares * idf[columns] * SCALE) for x, columns, shares in rows]
    hold = max(1, int(len(data) * HOLD)) if len(data) >= 10 else 0
    weights, bias = _ftrl(data[hold:], max(1, len(languages)))
    scores = np.array([v @ weights[c] + bias for _, c, v in data[:hold]]).reshape(hold, weights.shape[1])
    return Model(languages, (weights * idf[:, None]).astype(np.float32), bias, _temperature(scores, np.array([y for y, _, _ in data[:hold]], int)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; UNKNOWN and 0 for a null text, one without letters, or a model without languages.

    Equal scores go to the language that sorts first. Columns of docs stay; columns named
    lang_pred or score are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # columns x languages: bounded by parameters
    at = kept.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, values = [], []
            for x in batch.column(at):
                p = m.scores(x.as_py()) if m.languages else None
                k = int(p.argmax()) if p is not None else 0
                names.append(UNKNOWN if p is None else m.languages[k])
                values.append(0.0 if p is None else float(p[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(values, pa.float64())], [*kept, "lang_pred", "score"])

    slim = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = slim.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    for f in schema.fields:
        f.nullable = True
    return slim.mapInArrow(score, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; the model learns from labelled rows that are not held out.

    Empty tables, or tables without labels, give UNKNOWN with score 0. Rows that repeat a
    doc_id are scored each for itself.
    """
    model = train(docs.where(~held_out(F.col(doc_id))), text, lang, doc_id)
    slim = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return predict(slim, model).select("doc_id", "held_out", "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every whole text of ``documents``."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
