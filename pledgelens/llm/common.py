"""Helpers shared by the Arrow-batched kernels: byte views of text columns, word boundaries, word hashes.

Kernels get Arrow batches from Spark, cut them into slices of bounded bytes, and work on flat numpy arrays.
Null texts count as empty texts everywhere in this package.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20


def by_value(name: str) -> None:
    """Ship a kernel module inside the pickled function, so that executors need no copy of this repository."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def per_process(key, make):
    """A value kept for the life of a Python worker, over the tasks it runs."""
    kept = sys.modules.setdefault("_pledgelens_kept", types.ModuleType("_pledgelens_kept")).__dict__.setdefault("values", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    at = os.path.join(scratch_dir(df.sparkSession), f"t-{uuid.uuid4().hex}")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        for at in {os.path.dirname(x) for x in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of bytes, whole numbers from 0 on or doubles as compressed planes, one for each byte of a number that isn't 0 throughout."""
    head, body = [len(arrays)], []
    for x in arrays:
        kind = 0 if x.dtype == np.uint8 else 2 if x.dtype.kind == "f" else 1
        planes = x.reshape(1, -1) if kind == 0 else np.ascontiguousarray(x, "<f8" if kind == 2 else "<i8").view(np.uint8).reshape(-1, 8).T
        if kind == 1:
            planes = planes[: (int(x.max(initial=0)).bit_length() + 7) // 8]
        made = [pa.compress(np.ascontiguousarray(p), "zstd", asbytes=True) for p in planes] if len(x) else []
        head += [kind, len(x), len(made), *map(len, made)]
        body += made
    return np.array([len(head), *head], "<u4").tobytes() + b"".join(body)


def _head(blob: bytes) -> list[int]:
    return np.frombuffer(blob, "<u4", int(np.frombuffer(blob, "<u4", 1)[0]), 4).tolist()


def packed_lengths(blob: bytes) -> list[int]:
    """How long the arrays of `pack` are."""
    head, i, out = _head(blob), 1, []
    for _ in range(head[0]):
        out.append(head[i + 1])
        i += 3 + head[i + 2]
    return out


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of `pack`: bytes, 64-bit numbers or doubles."""
    head = _head(blob)
    view, at, i, out = memoryview(blob), 4 * len(head) + 4, 1, []
    for _ in range(head[0]):
        kind, n, many = head[i : i + 3]
        planes = np.zeros((n, 1 if kind == 0 else 8), np.uint8)
        for k, size in enumerate(head[i + 3 : i + 3 + many]):
            planes[:, k] = np.frombuffer(pa.decompress(pa.py_buffer(view[at : at + size]), n, "zstd"), np.uint8)
            at += size
        out.append(planes[:, 0] if kind == 0 else planes.reshape(-1).view("<f8" if kind == 2 else "<i8"))
        i += 3 + many
    return out


def clean_text(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (rows + 1) of a text column, nulls as empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices whose texts hold about `limit` bytes (one longer text comes alone): (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not ASCII white space; runs never cross rows."""
    solid = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=solid[:-1])
    first = solid[:-1].copy()
    first[1:] &= ~solid[:-2]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = solid[edges]
    start = np.flatnonzero(first)
    last = solid[:-1] & ~solid[1:]
    cuts = edges[edges > 0]
    last[cuts - 1] |= solid[cuts - 1]
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


PRIME = np.uint64(2**61 - 1)
BLOCK = 1 << 15  # numbers that stay in the cache


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - PRIME)  # below the prime the difference wraps around


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 31 bits."""
    half, low = np.uint64(31), np.uint64(2**31 - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64(2**30 - 1)) << half) + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        for a in range(0, more, BLOCK):
            to = min(a + BLOCK, more)
            out[done + a : done + to] = _times(out[a:to], np.uint64(step))
        done, step = done + more, step * step % int(PRIME)
    return out


_RNG = np.random.default_rng(20240607)
BYTE_CODE = _RNG.integers(1, int(PRIME), 256, dtype=np.uint64)
BASE = int(_RNG.integers(2**32, int(PRIME)))
INVERSE = pow(BASE, -1, int(PRIME))


class RollingHash:
    """64-bit names of any byte ranges of one buffer: polynomials modulo the prime 2^61 - 1, scrambled.

    Two different ranges of n bytes have one name for at most n of the 2^61 bases.
    """

    POWERS: dict[str, np.ndarray] = {}

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(self.POWERS.get("up", ())) < n:
            m = max(n, SLICE_BYTES + 1)
            self.POWERS["up"], self.POWERS["down"] = _powers(BASE, m), _powers(INVERSE, m)
        self.sums = np.zeros(n, np.uint64)
        for a in range(0, n - 1, BLOCK):
            term = _times(BYTE_CODE[data[a : a + BLOCK]], self.POWERS["up"][a : min(a + BLOCK, n - 1)])
            low, high = np.cumsum(term & np.uint64(2**32 - 1)), np.cumsum(term >> np.uint64(32))
            self.sums[a + 1 : a + 1 + len(term)] = _reduced(self.sums[a] + low + (high >> np.uint64(29)) + ((high & np.uint64(2**29 - 1)) << np.uint64(32)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for a in range(0, len(start), BLOCK):
            s, e = start[a : a + BLOCK], end[a : a + BLOCK]
            h = self.sums[e] + PRIME - self.sums[s]
            out[a : a + BLOCK] = mix(_times(np.minimum(h, h - PRIME), self.POWERS["down"][s]) + ((e - s).astype(np.uint64) << np.uint64(40)))
        return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return h ^ (h >> np.uint64(32))


def with_text_columns(df: DataFrame, text: str, fields: str, kernel) -> DataFrame:
    """Add columns that `kernel(bytes, offsets)` computes from each slice of texts, as a list of arrays in the order of `fields`.

    Input columns of the same names are replaced. Row order within a partition and all other columns stay.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = df.sparkSession.createDataFrame([], fields).schema
    kept = df.drop(*new.names)
    schema = T.StructType([*kept.schema, *new])
    arrow = to_arrow_schema(new)

    def run(batches):
        for rows, data, offsets in slices(batches, text):
            made = [pa.array(x, t.type) if not isinstance(x, pa.Array) else x.cast(t.type) for x, t in zip(kernel(data, offsets), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *made], [*rows.schema.names, *arrow.names])

    return kept.mapInArrow(run, schema)
