"""Many logistic regressions over one table, fitted side by side: each pass over the data serves all of them.

Rows are packed once into blocks of sparse features with their class and their fold in each repeat. A model is one
(repeat, fold): it learns from the rows of the other folds, so a row is masked out of its own fold's model in each repeat. The
models' coefficients stand side by side in one matrix; a pass gives all losses and gradients by two matrix products a
block, summed up a tree, and one step of each model's own L-BFGS is taken on the driver. What the driver holds is
(slots x models x classes), whatever the number of rows.

The objective is that of a class-weighted multinomial regression: weighted mean loss + regularisation / 2 * |w|^2 without
the intercepts.
"""

from __future__ import annotations

import math
import pickle
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.sources.store import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this repository

BLOCK_ROWS = 128
#: A block ends at so many cells too (about 1 MB as it is stored), so that long texts make no large ones.
BLOCK_CELLS = 1 << 18
#: A reader loads the values of a whole row group, up to 4096 rows, at once: groups of a few blocks keep that small.
GROUP_BYTES = 4 << 20
GROUPS = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "2", "parquet.enable.dictionary": "false"}


@dataclass(frozen=True)
class Stack:
    """Blocks of rows (read by `tasks` tasks, 0: there are no rows), and the models over them: weights[model][class] is what a training row of the class counts."""

    blocks: DataFrame
    tasks: int
    dim: int
    classes: int
    repeats: int
    k: int
    weights: np.ndarray
    total: np.ndarray
    sparse: bool = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def gram_slots(text: np.ndarray, dim: int, sizes: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
    """crc32 mod dim of all runs of n code points of a text's UTF-8 bytes, for each n, all places side by side.

    The checksums of runs of n code points go on from those of n - 1.
    """
    start = np.flatnonzero((text & 0xC0) != 0x80)
    length = np.diff(np.r_[start, len(text)])
    out, crc = [np.zeros(0, np.int64)], np.full(len(start), 0xFFFFFFFF, np.uint32)
    for n in range(1, max(sizes) + 1):
        more = len(start) - n + 1
        if more <= 0:
            break
        crc, at, size = crc[:more], start[n - 1 :], length[n - 1 :]
        for j in range(int(size.max())):
            if j == 0:
                crc = CRC[(crc ^ text[at]) & 0xFF] ^ (crc >> 8)
            else:
                on = np.flatnonzero(size > j)
                crc[on] = CRC[(crc[on] ^ text[at[on] + j]) & 0xFF] ^ (crc[on] >> 8)
        if n in sizes:
            out.append(((crc ^ np.uint32(0xFFFFFFFF)) % dim).astype(np.int64))
    return np.concatenate(out)


def pack_rows(rows: DataFrame, dim: int, sparse: bool = True) -> DataFrame:
    """Blocks (data binary) of rows (label int, folds array<int>, features): slots with repeats or a text (its n-grams' slots), scaled to length 1, or plain values."""
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))

    def block(held):
        label, folds, slot, value = zip(*held)
        sizes = np.array([len(x) for x in slot], np.int32)
        value = np.concatenate(value)
        data = (np.array(label, np.int32), np.array(folds, np.int32), sizes, small(np.concatenate(slot)), small(value) if sparse else value)
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(data)], pa.binary())], ["data"])

    def run(batches):
        held, cells = [], 0
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False)
            folds = b.column(1).to_pylist()
            features = b.column(2)
            for i in range(b.num_rows):
                if pa.types.is_list(features.type):
                    part = features[i].values.to_numpy(zero_copy_only=False)
                else:
                    part = gram_slots(np.frombuffer(features[i].as_buffer(), np.uint8), dim)
                if sparse:
                    count = np.bincount(part, minlength=dim)
                    slot = np.flatnonzero(count)
                    value = count[slot]
                else:
                    slot, value = np.arange(dim), part.astype(float)
                held.append((label[i], folds[i], slot, value))
                cells += len(slot)
                if len(held) >= BLOCK_ROWS or cells >= BLOCK_CELLS:
                    yield block(held)
                    held, cells = [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(run, "data binary")


def make_stack(rows: DataFrame, dim: int, classes: int, repeats: int, k: int, sparse: bool = True) -> Stack:
    """rows: label int, folds array<int>, features (array, or text without nulls); a class's training rows weigh all together as much as another's."""
    counts = np.zeros((repeats, k, classes))
    for r in rows.select("label", F.posexplode("folds").alias("rep", "fold")).groupBy("rep", "fold", "label").count().collect():
        counts[r["rep"], r["fold"], r["label"]] = r["count"]
    train = counts.sum(axis=1, keepdims=True) - counts
    whole, there = train.sum(axis=2, keepdims=True), (train > 0).sum(axis=2, keepdims=True)
    weights = np.where(train > 0, whole / np.maximum(there * train, 1), 0.0).reshape(repeats * k, classes)
    blocks = written(pack_rows(rows.select("label", "folds", "features"), dim, sparse), GROUPS)
    return Stack(blocks, blocks.rdd.getNumPartitions() if counts.any() else 0, dim, classes, repeats, k, weights, whole.reshape(-1), sparse)


def _summed(stack: Stack, table: np.ndarray, start, kernel) -> list:
    """The sum over all blocks: `kernel` adds a block, given its rows and the table, to the arrays that `start` makes.

    The table goes to the executors as a broadcast of this pass alone: passes do not pile up there.
    """
    shared = stack.blocks.sparkSession.sparkContext.broadcast(table)
    dim, sparse = stack.dim, stack.sparse

    def packed(total):
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    def each(batches):
        return (pickle.loads(x.as_py()) for b in batches for x in b.column(0))

    def first(batches):
        total = None
        for data in each(batches):
            if total is None:
                total, rows, flat = start(), _rows(dim, sparse), shared.value
            kernel(total, rows, flat, *data)
        if total is not None:
            yield packed(total)

    def joined(parts):
        total = None
        for p in parts:
            if total is None:
                total = p
            else:
                for a, b in zip(total, p):
                    a += b
        return total

    def branch(batches):
        total = joined(each(batches))
        if total is not None:
            yield packed(total)

    parts = stack.blocks.mapInArrow(first, "part binary")
    if stack.tasks > 16:
        parts = parts.repartition(math.isqrt(stack.tasks)).mapInArrow(branch, "part binary")
    try:
        return joined(pickle.loads(r.part) for r in parts.collect())
    finally:
        shared.destroy()


def _rows(dim: int, sparse: bool):
    """A function that gives a block's rows over all slots and the intercept; its next call takes the same memory again."""
    held = [np.zeros((BLOCK_ROWS, dim + 1)), np.zeros(0, np.int64)]
    held[0][:, dim] = 1.0  # the intercept

    def rows(sizes: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
        x, before = held
        cells = x.reshape(-1)
        cells[before] = 0.0
        value = value.astype(float)
        if sparse:
            at = np.cumsum(sizes) - sizes
            some = sizes > 0
            norm = np.ones(len(sizes))
            norm[some] = np.sqrt(np.add.reduceat(value * value, at[some])) if some.any() else 1.0
            value /= np.repeat(norm, sizes)
        held[1] = np.repeat(np.arange(len(sizes)) * (dim + 1), sizes) + slot
        cells[held[1]] = value
        return x[: len(sizes)]

    return rows


def _flat(w: np.ndarray) -> np.ndarray:
    """(slots + 1, models x (classes - 1)): the coefficients less those of the last class, which is all that a softmax sees."""
    return np.ascontiguousarray((w[:, :, :-1] - w[:, :, -1:]).transpose(1, 0, 2).reshape(w.shape[1], -1))


def _logits(x: np.ndarray, flat: np.ndarray, models: int, classes: int) -> np.ndarray:
    z = np.zeros((len(x), models, classes))
    z[:, :, :-1] = (x @ flat).reshape(len(x), models, classes - 1)
    return z


def losses(stack: Stack, w: np.ndarray, regular: float) -> tuple[np.ndarray, np.ndarray]:
    """Each model's objective and gradient at its coefficients; w and the gradient are (models, slots + 1, classes)."""
    models, dim, classes, k, sparse = len(w), stack.dim, stack.classes, stack.k, stack.sparse
    scale = stack.weights / np.maximum(stack.total, 1)[:, None]

    def start():
        return [np.zeros(models), np.zeros((models * (classes - 1), dim + 1))]

    def kernel(out, rows, flat, label, folds, *cells):
        n = len(label)
        x = rows(*cells)
        z = _logits(x, flat, models, classes)
        z -= z.max(axis=2, keepdims=True)
        e = np.exp(z)
        total = e.sum(axis=2)
        own = np.zeros((n, models), bool)
        own[np.arange(n)[:, None], folds + k * np.arange(folds.shape[1])[None, :]] = True
        weight = np.where(own, 0.0, scale[:, label].T)
        out[0] += (weight * (np.log(total) - z[np.arange(n), :, label])).sum(axis=0)
        p = e / total[:, :, None]
        p[np.arange(n), :, label] -= 1.0
        out[1] += (p * weight[:, :, None])[:, :, :-1].reshape(n, -1).T @ x

    loss, most = _summed(stack, _flat(w), start, kernel)
    gradient = np.zeros((models, dim + 1, classes))
    gradient[:, :, :-1] = most.reshape(models, classes - 1, dim + 1).transpose(0, 2, 1)
    gradient[:, :, -1] = -gradient[:, :, :-1].sum(axis=2)  # a row's residuals sum to zero over the classes
    gradient[:, :dim] += regular * w[:, :dim]
    return loss + regular / 2 * (w[:, :dim] ** 2).sum(axis=(1, 2)), gradient


def fit_stack(stack: Stack, regular: float = 1e-3, tolerance: float = 1e-6, most: int = 100, memory: int = 8) -> np.ndarray:
    """Coefficients of all models, by L-BFGS with a step length of its own for each; a pass is a try of every unfinished model.

    A model is done when a step gains less than `tolerance` of its objective.
    """
    models = stack.repeats * stack.k
    w = np.zeros((models, stack.dim + 1, stack.classes))
    dot = lambda a, b: (a * b).sum(axis=(1, 2))
    wide = lambda v: v[:, None, None]
    f, g = losses(stack, w, regular)
    history: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    gamma, open_ = np.ones(models), np.ones(models, bool)
    d = -g
    t = 1 / np.maximum(np.sqrt(dot(g, g)), 1e-12)
    for _ in range(most):
        tried = w + wide(np.where(open_, t, 0.0)) * d
        f1, g1 = losses(stack, tried, regular)
        good = open_ & (f1 <= f + 1e-4 * t * dot(g, d))
        s, y = tried - w, g1 - g
        sy = dot(s, y)
        rho = np.where(good & (sy > 1e-14), 1 / np.where(sy > 1e-14, sy, 1), 0.0)
        history = [*history, (s, y, rho)][-memory:]
        gamma = np.where(rho > 0, sy / np.maximum(dot(y, y), 1e-300), gamma)
        done = good & (f - f1 <= tolerance * np.maximum(np.abs(f), 1e-12))
        w, g = np.where(wide(good), tried, w), np.where(wide(good), g1, g)
        f = np.where(good, f1, f)
        open_ &= ~done & ~(~good & (t < 1e-10))
        if not open_.any():
            break
        q, alphas = g.copy(), []
        for s, y, rho in reversed(history):
            alpha = rho * dot(s, q)
            alphas.append(alpha)
            q -= wide(alpha) * y
        q *= wide(gamma)
        for (s, y, rho), alpha in zip(history, reversed(alphas)):
            q += wide(alpha - rho * dot(y, q)) * s
        # a model whose step was too long tries half of it, the others take a new direction
        d = np.where(wide(good), -q, d)
        t = np.where(good, 1.0, t / 2)
    return w


def confusion(stack: Stack, w: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(repeat, fold, class, predicted, rows): each row judged in each repeat by the model that did not learn from it."""
    models, dim, classes, k, repeats, sparse = len(w), stack.dim, stack.classes, stack.k, stack.repeats, stack.sparse

    def start():
        return [np.zeros((repeats, k, classes, classes), np.int64)]

    def kernel(out, rows, flat, label, folds, *cells):
        z = _logits(rows(*cells), flat, models, classes)
        for rep in range(repeats):
            said = z[np.arange(len(label)), folds[:, rep] + k * rep].argmax(axis=1)
            np.add.at(out[0], (rep, folds[:, rep], label, said), 1)

    counts = _summed(stack, _flat(w), start, kernel)[0]
    return [(*map(int, at), int(counts[tuple(at)])) for at in np.argwhere(counts)]
