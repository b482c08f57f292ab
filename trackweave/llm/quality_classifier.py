"""Quality scores from random-indexing word vectors and a small network.

Tokens are runs of letters and digits or runs of other characters. A token falls
into one of ``BUCKETS`` rows by its hash; words written in capitals share one
row. Every row has a sparse random index vector (two entries of +1 or -1), and a
row's word vector is the sum of the index vectors of all neighbours of its
tokens in all documents: each task adds up its own documents in a table of fixed
size, and the tables are added up as they stream through a shuffle.

A document is the mean of its tokens' vectors, frequent ones weighing less, with
a few sums beside it: length, share of distinct neighbours, share of repeats. A
network of two layers is trained on the driver with at most ``SAMPLE`` labelled
documents; a fifth of them is set aside to fit the temperature that calibrates
its probabilities.

Edge cases: a null or empty text has the zero vector and gets a score like any
other. Without labels of both kinds every score is the share of label 1 (0.5
without any). Repeated rows and extra columns need no care: rows are independent
once the model is fitted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .labelled import held_out, training_texts

BUCKETS, DIMENSIONS = 1 << 14, 32
UPPER_BUCKET = 0
BLOCKS = 64
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 128, 0.01
THRESHOLD = 0.3

# Classes of bytes: 0 white space, 1 letters and digits, 2 others.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[hashing.WHITE] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every token."""
    kind = _CLASS[data]
    new = np.empty(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(kind))
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    texts = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return np.empty(0, np.int64), texts
    buckets = (hashing.span_hashes(data, starts, ends) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    capitals = (ends - starts > 2) & _CAPITAL[data[starts]] & _CAPITAL[data[np.minimum(starts + 1, ends - 1)]]
    buckets[capitals] = UPPER_BUCKET
    return buckets, texts


def _index_vectors() -> list[tuple[np.ndarray, np.ndarray]]:
    """Place and sign of the two entries of every row's index vector."""
    rows = np.arange(BUCKETS, dtype=np.uint64)
    out = []
    for salt in (21, 22):
        h = hashing.mix(rows, salt)
        out.append(((h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)))
    return out


def context_sums(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of neighbours' index vectors, and token counts, by bucket: a table of fixed size."""
    width = DIMENSIONS + 1
    rows_each = BUCKETS // BLOCKS

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_vectors()
        table = np.zeros((BUCKETS, width))
        for _, data, offsets in hashing.pieces(batches):
            buckets, texts = tokens(data, offsets)
            table[:, DIMENSIONS] += np.bincount(buckets, minlength=BUCKETS)
            for step in (1, 2):
                left, right = buckets[:-step], buckets[step:]
                same = texts[:-step] == texts[step:]
                left, right = left[same], right[same]
                for here, there in ((left, right), (right, left)):
                    for place, sign in index:
                        cells = np.bincount(
                            here * DIMENSIONS + place[there], sign[there], minlength=BUCKETS * DIMENSIONS
                        )
                        table[:, :DIMENSIONS] += cells.reshape(BUCKETS, DIMENSIONS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(BLOCKS), pa.int32()),
                pa.array([table[b * rows_each : (b + 1) * rows_each].tobytes() for b in range(BLOCKS)], pa.binary()),
            ],
            names=["block", "sums"],
        )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(sums)
                total[block] = total[block] + part if block in total else part
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
                names=["block", "sums"],
            )

    schema = "block int, sums binary"
    parts = documents.select("text").mapInArrow(gather, schema)
    table = np.zeros((BUCKETS, width))
    for row in parts.repartition(BLOCKS, "block").mapInArrow(add, schema).collect():
        table[row.block * rows_each : (row.block + 1) * rows_each] += np.frombuffer(row.sums).reshape(-1, width)
    return table[:, :DIMENSIONS], table[:, DIMENSIONS]


def word_vectors(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors by bucket, and the weight of a token in a document's mean."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    share = counts / max(counts.sum(), 1)
    return (sums / np.maximum(norm, 1e-9)).astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n = len(offsets) - 1
    buckets, texts = tokens(data, offsets)
    counts = np.bincount(texts, minlength=n)
    out = np.zeros((n, 2 * DIMENSIONS + 4), np.float32)
    if len(buckets):
        filled = np.flatnonzero(counts)
        first = (np.cumsum(counts) - counts)[filled]
        each = vectors[buckets]
        weight = weights[buckets]
        total = np.add.reduceat(weight, first)[:, None]
        out[filled, :DIMENSIONS] = np.add.reduceat(each * weight[:, None], first) / total
        out[filled, DIMENSIONS : 2 * DIMENSIONS] = np.add.reduceat(each, first) / counts[filled, None]
        again = np.zeros(len(buckets), np.float32)
        again[1:] = (buckets[1:] == buckets[:-1]) & (texts[1:] == texts[:-1])
        kinds = np.bincount(hashing.distinct_per_text(buckets, texts)[1], minlength=n)
        out[filled, -4] = np.add.reduceat(again, first) / counts[filled]
        out[filled, -3] = kinds[filled] / counts[filled]
        out[filled, -2] = np.add.reduceat((buckets == UPPER_BUCKET).astype(np.float32), first) / counts[filled]
    out[:, -1] = np.log1p(counts) / 10
    return out


class Network:
    """Two layers; probabilities are those of the last layer over a temperature."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, seed: int = 7):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.fitted = len(labels) > 1 and 0 < self.prior < 1
        if not self.fitted:
            return
        random = np.random.default_rng(seed)
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-6
        x = (features - self.mean) / self.scale
        aside = random.random(len(x)) < 0.2
        if aside.all() or not aside.any():
            aside[:] = False
        self.weights = [
            random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            np.zeros(1),
        ]
        self._train(x[~aside], labels[~aside], random)
        self.temperature = 1.0
        if aside.any():
            logits, y = self._logits(x[aside]), labels[aside]
            loss = lambda t: np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _train(self, x: np.ndarray, y: np.ndarray, random: np.random.Generator) -> None:
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        step = 0
        for epoch in range(EPOCHS):
            order = random.permutation(len(x))
            for begin in range(0, len(x), BATCH):
                rows = order[begin : begin + BATCH]
                w1, b1, w2, b2 = self.weights
                hidden = np.tanh(x[rows] @ w1 + b1)
                wrong = (1 / (1 + np.exp(-(hidden @ w2 + b2))) - y[rows]) / len(rows)
                back = wrong[:, None] * w2 * (1 - hidden**2)
                slopes = [x[rows].T @ back + 1e-4 * w1, back.sum(0), hidden.T @ wrong + 1e-4 * w2, wrong.sum(keepdims=True)]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for w, g, m, v in zip(self.weights, slopes, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(features), self.prior)
        logits = self._logits((features - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    vectors, weights = word_vectors(*context_sums(documents))
    size = 2 * DIMENSIONS + 4

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in hashing.pieces(batches):
            found = pooled(data, offsets, vectors, weights)
            counts = np.full(len(found), size)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("label"), hashing.ragged(found.ravel(), counts, pa.float32())],
                names=["doc_id", "label", "features"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    sample = training_texts(documents, labels, "quality", SAMPLE).select("doc_id", "label", "text")
    rows = sample.mapInArrow(features, f"doc_id {kind}, label int, features array<float>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.features))
    model = Network(
        np.array([r.features for r in rows], np.float64).reshape(-1, size), np.array([r.label for r in rows], np.float64)
    )

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in hashing.pieces(batches):
            found = model.scores(pooled(data, offsets, vectors, weights).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    inputs = documents.select("doc_id", held_out().alias("held_out"), "text")
    return inputs.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
