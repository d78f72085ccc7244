"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

A word is a maximal run of letters and digits (any byte from 0x80 up counts as a letter) or of other visible
ASCII. Unigrams and bigrams are hashed to 2**bits slots, one more is the mark of a word said twice in a row; a slot's value is log(1 + count), and each document's
vector has length 1. Features are extracted by all tasks; the model is fitted by one task on at most `max_docs`
labelled documents, which is the documented bound of the training sample, and is a float for each slot in size.

Edge cases: a null or empty text has no feature and gets the bias alone; a label that is null is no label; several
labels of one id count as their largest; labelled ids without a document are ignored; with no labelled row at all
every score is 0.5; rows with a null id are scored but never trained on; repeated rows get equal scores, and rows of
one id are fitted in the order of their features, so that the model does not depend on their order in the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.llm.common import RollingHash, by_value, mix, slices, with_text_columns

by_value(__name__)

KIND = np.full(256, 1, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float

    @property
    def bits(self) -> int:
        return (len(self.weights) - 1).bit_length() - 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, slots and values of the sparse vectors of a slice, ordered by row and slot."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kind = KIND[data]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edge = np.unique(np.concatenate([[0], change, offsets[:-1][offsets[:-1] < len(data)], [len(data)]]))
    start, end = edge[:-1], edge[1:]
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    row = np.searchsorted(offsets, start, "right") - 1
    one = RollingHash(data).of(start, end)
    same = row[1:] == row[:-1]
    two = mix(one[:-1] * np.uint64(3) + one[1:])[same]
    again = same & (one[1:] == one[:-1])  # a bigram of one word twice also counts as such, whatever the word
    shift, wide = np.uint64(64 - bits), bits + 1
    slot = lambda r, h: (r << wide) | (h >> shift).astype(np.int64)
    key = np.sort(np.concatenate([slot(row, one), slot(row[1:][same], two), (row[1:][again] << wide) | 1 << bits]))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    value = np.log1p(np.diff(np.r_[first, len(key)]).astype(float))
    key = key[first]
    row = key >> wide
    norm = np.sqrt(np.bincount(row, value * value, len(offsets) - 1))
    return row, key & ((1 << wide) - 1), value / norm[row]


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Per-coordinate follow-the-regularised-leader-proximal on (slots, values, label); the slot behind all others is the bias."""
    bias = (1 << bits) + 1
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weight(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for slot, value, label in examples:
            at, x = np.append(slot, bias), np.append(value, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weight(np.arange(bias + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 16_000, bits: int = 18, epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> QualityModel:
    """Fit on the `max_docs` labelled documents whose ids hash lowest (the bound of the sample)."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col)).cast("double").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_docs)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(chosen), "id")

    def extract(batches):
        for part, data, offsets in slices(batches, "body"):
            row, slot, value = features(data, offsets, bits)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([slot[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["id", "label", "slots", "vals"])

    id_type = docs.schema[id_col].dataType.simpleString()
    sparse = rows.mapInArrow(extract, f"id {id_type}, label double, slots binary, vals binary")

    def train(batches):
        got = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("id", "slots", "vals", "label"))))
        got = [(i, np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), y) for i, s, v, y in got]
        order = np.random.default_rng(7).permutation(len(got))
        w, bias = ftrl([got[k][1:] for k in order], bits, epochs, alpha, beta, l1, l2)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])

    fitted = sparse.repartition(1).mapInArrow(train, "weights binary, bias double").collect()
    return QualityModel(np.frombuffer(fitted[0].weights, np.float32), fitted[0].bias)


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= 0.5); columns of these names are replaced."""
    weights, bias, bits = model.weights, model.bias, model.bits

    def kernel(data, offsets):
        row, slot, value = features(data, offsets, bits)
        score = 1 / (1 + np.exp(-(np.bincount(row, weights[slot] * value, len(offsets) - 1) + bias)))
        return [score, (score >= 0.5).astype(np.int32)]

    return with_text_columns(docs, text_col, "score double, predicted int", kernel)
