"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words (hashed, in lower case), the trigrams of its character shapes
(letter case, digits, white space and each punctuation mark) and how much its words repeat.
Log counts weighted by inverse document frequency are projected on the leading singular vectors of a bounded labelled sample.
The sample's vectors are broadcast; cosines of every document with all of them are computed in
blocks, and the nearest ones vote with their similarity.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, byte_view, held_out, labelled_texts, small_slices, table, text_column, tidy

#: Labelled texts of each label that are broadcast as neighbours, at most.
SAMPLE_PER_CLASS = 1000
DIMENSIONS = 48
NEIGHBOURS = 15
HASHED = 1024
BINS = 10
#: Buckets of words, and their weight beside that of the other terms.
WORDS, WORD_WEIGHT = 2048, 0.5
THRESHOLD = 0.3
TERMS = HASHED + 4 * BINS + WORDS


#: Shapes: 1 letter or other, 2 capital, 3 digit, 4 line end, 5 blank; marks from 6 on, each its own.
_SHAPE = np.ones(256, np.int32)
_SHAPE[[*range(65, 91)]] = 2
_SHAPE[[*range(48, 58)]] = 3
_SHAPE[[10, 11, 12, 13]] = 4
_SHAPE[[32, 9]] = 5
for _place, _mark in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _SHAPE[ord(_mark)] = 6 + _place
#: The hashed term of each trigram of 6-bit shapes.
_TERM = ((np.arange(1 << 18, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int16)


def _bin(share: float) -> int:
    return min(int(share * BINS), BINS - 1)


def terms(raw: bytes) -> np.ndarray:
    """The term counts of one text; all zero for a text without words."""
    out = np.zeros(TERMS, np.float32)
    words = raw.split()
    if not words:
        return out
    shape = _SHAPE[np.frombuffer(raw, np.uint8)]
    if len(shape) >= 3:
        out[:HASHED] = np.bincount(_TERM[shape[:-2] << 12 | shape[1:-1] << 6 | shape[2:]], minlength=HASHED)
    # How much repeats: distinct words, words like the one before, distinct lines, words that end in no mark.
    blank = np.append((shape == 4) | (shape == 5), True)
    last = shape[blank[1:] & ~blank[:-1]]
    lines = raw.split(b"\n")
    alike = sum(map(bytes.__eq__, words[1:], words[:-1]))
    shares = (len(set(words)) / len(words), alike / max(len(words) - 1, 1), len(set(lines)) / len(lines), float((last <= 3).mean()))
    for k, share in enumerate(shares):
        out[HASHED + k * BINS + _bin(share)] = 20
    counts = Counter(raw.lower().split())
    buckets = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % WORDS
    out[HASHED + 4 * BINS :] = np.bincount(buckets, np.fromiter(counts.values(), np.float64, len(counts)), WORDS)
    return out


@dataclass
class Model:
    weights: np.ndarray
    axes: np.ndarray
    neighbours: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit latent vectors of term counts; zero for a text without terms."""
        latent = (np.log1p(counts).astype(np.float64) * self.weights) @ self.axes
        norm = np.sqrt((latent**2).sum(axis=1, keepdims=True))
        return latent / np.where(norm > 0, norm, 1)

    def vote(self, latent: np.ndarray) -> np.ndarray:
        """The labels of the nearest neighbours, weighted by cosine; ties at the last place all vote."""
        if not len(self.labels):
            return np.full(len(latent), self.prior)
        # Past nine places a product depends on the batch that it is computed in.
        cosine = np.round(latent @ self.neighbours.T, 9)
        k = min(NEIGHBOURS, cosine.shape[1])
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k][:, None]
        weight = np.where(cosine >= last, np.maximum(cosine, 0), 0).astype(np.float64)
        total = weight.sum(axis=1)
        return np.where(total > 0, weight @ self.labels / np.where(total > 0, total, 1), self.prior)


def leading_axes(matrix: np.ndarray, n: int, rounds: int = 30) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration: no matrix of terms by terms is held."""
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(matrix.shape[1], n + 16)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    inner = matrix @ basis
    values, turn = np.linalg.eigh(inner.T @ inner)
    return basis @ turn[:, np.argsort(-values)[:n]]


def train(rows: list[tuple[str, int]]) -> Model:
    """Latent axes and labelled vectors of (text, label) rows."""
    if not rows:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    counts = np.stack([terms(t.encode()) for t, _ in rows])
    seen = (counts > 0).sum(axis=0)
    weights = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 0.1
    weights[seen == 0] = 0
    weights[HASHED + 4 * BINS :] *= WORD_WEIGHT
    axes = leading_axes(np.log1p(counts).astype(np.float64) * weights, DIMENSIONS)
    model = Model(weights, axes, np.zeros((0, axes.shape[1])), np.array([y for _, y in rows], np.float64))
    model.neighbours = model.project(counts)
    return model


def score_batch(model: Model, raws: list[bytes]) -> np.ndarray:
    parts = [model.vote(model.project(np.stack([terms(r) for r in raws[at : at + 256]]))) for at in range(0, len(raws), 256)]
    return np.round(np.concatenate(parts), 6) if parts else np.zeros(0)


def _raws(batch: pa.RecordBatch, name: str) -> list[bytes]:
    data, offsets = byte_view(text_column(batch, name))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for each input row.

    Null, empty and blank texts have no vector and get the share of label 1 in the sample (0.5
    without a sample). Equal texts score alike. Other columns are ignored; an empty table gives
    no rows.
    """
    sent = bounded_batches(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_batch(sent.value, _raws(batch, "text")))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least the threshold."""
    sent = bounded_batches(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, text_col):
            yield batch.filter(pa.array(score_batch(sent.value, _raws(batch, text_col)) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def fitted(spark, sf_dir: str) -> Model:
    """The model of the labelled documents of a folder of tables."""
    return train(labelled_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", SAMPLE_PER_CLASS))


def op1(spark, sf_dir: str) -> DataFrame:
    found = score_quality(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
