"""Toxicity by multiple-instance learning: a document is toxic if some sentence is, and sentence scores combine by noisy-or.

Only documents have labels. A sentence's score is the logistic function of a bias and the weights of its words and their prefixes;
a document's is 1 - product of (1 - score) over its sentences. Weights are fitted to the document labels through that product,
which shows, once fitted, where a document's offending sentences are (`offending_sentences`).

The fit takes a bounded sample of labelled rows, chosen by a hash of doc_id: MAX_TOXIC and MAX_CLEAN documents, whole, up to FIT_FEATURES words and
prefixes in all; clean rows weigh as many as they stand for. Scoring reads whole texts.
Defined results: null, empty and wordless texts score 0; labels other than 0 and 1 are not learnt from; a document with both labels is toxic;
of rows of one doc_id with different texts, the fit takes one; without labelled rows of both kinds, or with an empty table of labels, every score is 0 but for rounding;
very long texts are read whole; rows that repeat score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import small_batches
from .words import NOT_WORD, text_sentences

MAX_TOXIC, MAX_CLEAN, FIT_FEATURES = 2000, 4000, 30_000_000
THRESHOLD = 0.3
BUCKETS = 1 << 22
#: Bytes of the prefixes that are features beside the word.
PREFIXES = (4, 5, 6, 7)
#: Share of labels that are taken to be wrong either way, penalty on squared weights, documents that must have a feature, and steps of the fit.
NOISE, PENALTY, LEAST_DOCS, STEPS = 0.02, 0.1, 4, 120
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[list(b".!?\n")] = True
_SENTENCE = re.compile(r"[.!?\n]")


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float32)
        out[self.buckets] = self.weights
        return out


def _features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for hashes, sentence in text_sentences(texts, NOT_WORD, _BREAKS, PREFIXES):
        there = hashes != 0
        yield (hashes[there] >> np.uint64(42)).astype(np.int32), sentence[there].astype(np.int32)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(f.tobytes(), s.tobytes()) for f, s in _features(b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("place"), b.column("toxic"), pa.array([f for f, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], names=["place", "toxic", "features", "sentences"])


def _noisy_or(z: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of sentences with logits z, and the logarithm of 1 - score of their documents."""
    z = np.clip(z, -30, 30)
    return 1 / (1 + np.exp(-z)), np.bincount(doc, -np.logaddexp(0, z), minlength=n)


def fit(rows: list[tuple[int, bytes, bytes]], clean_weight: float = 1.0) -> Model:
    """Fits the model to (label, features, sentences) of documents, by Adam on the whole sample."""
    y = np.array([r[0] for r in rows], dtype=float)
    feature, sentence, doc, start = [], [], [], 0
    for i, (_, f, s) in enumerate(rows):
        if f:
            own, place = np.unique(np.frombuffer(s, dtype=np.int32), return_inverse=True)
            feature.append(np.frombuffer(f, dtype=np.int32))
            sentence.append((place + start).astype(np.int32))
            doc.append(np.full(len(own), i, dtype=np.int32))
            start += len(own)
    if not feature or y.min(initial=1) == y.max(initial=0):
        return Model(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32), -30.0)
    in_docs = np.zeros(BUCKETS, dtype=np.int32)
    for f in feature:
        in_docs[np.unique(f)] += 1
    kept = np.flatnonzero(in_docs >= LEAST_DOCS).astype(np.int32)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    f, s, d = place[np.concatenate(feature)], np.concatenate(sentence), np.concatenate(doc)
    f, s = f[f >= 0], s[f >= 0]
    del feature, sentence, in_docs, place
    weight, n, m = np.where(y > 0, 1.0, clean_weight), len(y), len(kept)
    x = np.zeros(m + 1)
    x[m] = -6.0
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, STEPS + 1):
        p, log_clean = _noisy_or(x[m] + np.bincount(s, x[f], minlength=start), d, n)
        said = NOISE - (1 - 2 * NOISE) * np.expm1(log_clean)  # the probability of label 1
        slope = weight * (said - y) / (said * (1 - said)) * (1 - 2 * NOISE) * np.exp(log_clean)
        by_sentence = slope[d] * p
        grad = np.append(np.bincount(f, by_sentence[s], minlength=m) + PENALTY * x[:m], by_sentence.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        x -= 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(kept, x[:m].astype(np.float32), float(x[m]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits to the rows of labels (doc_id, toxic) that are not held out. One task takes the bounded sample, and the driver the weights."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", F.xxhash64(F.lit("fit"), "doc_id"))
    order = ["place", "doc_id"]
    ids = known.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).union(known.where("toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    n_clean = known.where("toxic = 0").count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # at most MAX_TOXIC + MAX_CLEAN ids
    sample = texts.groupBy("doc_id", "place", "toxic").agg(F.max("text").alias("text")).select("place", "toxic", "text").mapInArrow(_sampled, "place long, toxic int, features binary, sentences binary")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for row in sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("place", "toxic", "features", "sentences")), strict=True)):
            size += len(row[2]) // 4
            if size > FIT_FEATURES and found:
                break
            found.append(row[1:])
        model = fit(found, max(1.0, n_clean / max(1, sum(not r[0] for r in found))))
        yield pa.RecordBatch.from_arrays([pa.array([model.buckets.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["buckets", "weights", "bias"])

    r = sample.coalesce(1).mapInArrow(fitted, "buckets binary, weights binary, bias double").first()
    if r is None:
        return fit([])
    return Model(np.frombuffer(r["buckets"], dtype=np.int32), np.frombuffer(r["weights"], dtype=np.float32), r["bias"])


def _document_scores(model: Model, table: np.ndarray, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Of each text: its score, its sentences that have words, and their scores."""
    for f, s in _features(texts):
        if not len(f):
            yield 0.0, s, np.zeros(0)
            continue
        own, place = np.unique(s, return_inverse=True)
        p, log_clean = _noisy_or(model.bias + np.bincount(place, table[f]), np.zeros(len(own), dtype=np.int8), 1)
        yield float(-np.expm1(log_clean[0])), own, p


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in batches:
            scores = [x[0] for x in _document_scores(model, table, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score is below THRESHOLD."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in batches:
            kept = pa.array([x[0] < THRESHOLD for x in _document_scores(model, table, b.column("text").to_pylist())], pa.bool_())
            yield b.select(["row"]).filter(kept)

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")  # columns may have any names
    return rows.mapInArrow(run, StructType([rows.schema["row"]])).select("row.*")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence (breaks before it), text and score of every sentence that scores at least threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for doc_id, text, (_, own, p) in zip(b.column("doc_id").to_pylist(), texts, _document_scores(model, table, texts), strict=True):
                if (p >= threshold).any():
                    parts = _SENTENCE.split(text)
                    out += [(doc_id, int(i), parts[i].strip(), float(x)) for i, x in zip(own, p, strict=True) if x >= threshold]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], names=["doc_id", "sentence", "text", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentence long, text string, score double")
