"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become integers, floor(scale * x). Candidates and queries are packed into blocks of a fixed number of rows.
First, about `sample` candidates, chosen by a hash, give each query a floor: its k-th best score among them, which
is no higher than its k-th best of all, whatever the sample. The sample's principal axes turn all vectors, so that
most of their length comes to lie in few segments; turning changes no inner product. A block of queries with its floors meets every
block of candidates through a join on the query block's number and one of `deal` parts of the candidates, so both
sides shuffle by key and no key holds many blocks. Inside a pair of
blocks the inner product is bounded from above, coarse to fine, from each segment's mean and deviation: over a segment of w components,
sum(q*c) <= w*mean(q)*mean(c) + w*dev(q)*dev(c). As |q-c|^2 = |q|^2 + |c|^2 - 2*q.c, this bounds the distance from
below. Pairs whose bound is under the query's floor, or its k-th best score so far, are left out; the survivors are
scored exactly in 64-bit integers, best bounds first, and a window keeps each query's k best over all blocks. How much is left out depends on the
vectors: nearly all pairs of clustered ones, few of those that lie alike in all directions.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of another
length than the query's are no candidates for it; null ids take no part; repeated ids are separate candidates,
and every row with the query's own id is left out; ties go to smaller ids; a query id that is repeated is searched
once, with the smallest of its usable vectors; fewer than k candidates give fewer rows; columns besides id and vector
don't matter; an empty table gives an empty table. Components beyond 2**26 after
scaling raise an error, since sums could leave 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pledgelens.llm.common import by_value

by_value(__name__)

LEVELS = (1, 4, 16, 32)
STEP = 512


def segment_stats(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(w)*mean and sqrt(w)*deviation of each segment, so that bounds are plain products."""
    edge = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    width = np.diff(edge)
    total = np.add.reduceat(x, edge[:-1], axis=1)
    mean = total / width
    dev = np.sqrt(np.maximum(np.add.reduceat((x - np.repeat(mean, width, axis=1)) ** 2, edge[:-1], axis=1), 0))
    return mean * np.sqrt(width), dev


def principal_axes(x: np.ndarray) -> np.ndarray:
    """An orthogonal matrix of the second moments' axes, largest first."""
    return np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]


def floors(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the rows; the lowest integer where there are fewer than k."""
    score = queries @ rows.T
    score[query_ids[:, None] == row_ids[None, :]] = NONE
    return np.partition(score, -k, axis=1)[:, -k] if len(rows) >= k else np.full(len(queries), NONE)


NONE = np.iinfo(np.int64).min


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floor: np.ndarray | None = None, axes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each query's k best rows of a block, as far as they reach its floor: (query number, row number, score); and how many pairs were scored."""
    turned = np.eye(queries.shape[1]) if axes is None else axes
    q = queries @ turned
    q_stats, q_norm = [segment_stats(q, n) for n in LEVELS], np.linalg.norm(q, axis=1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in query_ids]
    floor = np.full(len(q), NONE) if floor is None else floor.copy()
    scored = 0
    for at in range(0, len(rows), STEP):
        part, ids = rows[at : at + STEP], row_ids[at : at + STEP]
        c = part @ turned
        alive = query_ids[:, None] != ids[None, :]
        slack = 1 + 1e-9 * np.outer(q_norm, np.linalg.norm(c, axis=1))  # for rounding
        bound = slack
        for n, (qm, qd) in zip(LEVELS, q_stats):
            cm, cd = segment_stats(c, n)
            bound = qm @ cm.T + qd @ cd.T + slack
            alive &= bound >= floor[:, None]
            if not alive.any():
                break
        for i in np.flatnonzero(alive.any(axis=1)):
            j = np.flatnonzero(alive[i])
            if len(j) > 4 * k:  # the best bounds first, so that the others meet a higher floor
                j = j[np.argsort(-bound[i, j], kind="stable")]
            for a, b in ((0, 2 * k), (2 * k, len(j))):
                some = j[a:b][bound[i, j[a:b]] >= floor[i]]
                if not len(some):
                    continue
                scored += len(some)
                score = part[some] @ queries[i]
                best = np.lexsort((ids[some], -score))[:k]
                merged = sorted(out[i] + [(-int(score[x]), int(ids[some[x]]), at + int(some[x])) for x in best if score[x] >= floor[i]])[:k]
                out[i] = merged
                if len(merged) == k:
                    floor[i] = max(floor[i], -merged[-1][0])
    flat = [(i, r, -s) for i, best in enumerate(out) for s, _, r in best]
    a = np.array(flat, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2], scored


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec of the rows whose id and components are all there and finite."""
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(usable & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))


def _packed(df: DataFrame, rows: int, scale: int) -> DataFrame:
    """Blocks of at most `rows` vectors of one length and one `b`: b, dim, ids, vals (32-bit integers).

    `b` is the rows' own column, so that a block's key does not depend on the order in which a task gets its rows.
    """

    def block(key: tuple[int, int], ids: list[int], vectors: list[list[float]]) -> pa.RecordBatch:
        x = np.floor(np.array(vectors, float) * scale)
        if np.abs(x).max() > 2**26:
            raise ValueError("a scaled component is beyond 2**26")
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([x.astype(np.int32).tobytes()], pa.binary())],
            ["b", "dim", "ids", "vals"],
        )

    def run(batches):
        held: dict[tuple[int, int], tuple[list[int], list[list[float]]]] = {}
        for batch in batches:
            for b, i, v in zip(*(batch.column(c).to_pylist() for c in ("b", "id", "vec"))):
                ids, vectors = held.setdefault((b, len(v)), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    yield block((b, len(v)), *held.pop((b, len(v))))
        for key, (ids, vectors) in held.items():
            yield block(key, ids, vectors)

    return df.select("b", "id", "vec").mapInArrow(run, "b int, dim int, ids binary, vals binary")


def _matrix(vals: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(vals, np.int32).reshape(-1, dim).astype(np.int64)


def top_k(candidates: DataFrame, queries: DataFrame, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 1024, block_rows: int = 1024, deal: int | None = None, sample: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest integer inner products.

    deal: parts of the candidates, by default one for 16 blocks, at least 32.
    """
    usable = _usable(candidates, id_col, vector_col)
    n_rows = usable.count()
    deal = deal or max(32, n_rows // (16 * block_rows))
    asked = _usable(queries, id_col, vector_col).groupBy("id").agg(F.min("vec").alias("vec"))
    blocks = max(1, -(-asked.count() // query_rows))
    # about `sample` rows, never more than twice as many, come to the driver and go out with the tasks
    share = F.xxhash64("id", "vec") / 2.0**64 + 0.5 <= sample / max(1, n_rows)
    known = {}
    for r in _packed(usable.where(share).limit(2 * sample).withColumn("b", F.lit(0)).coalesce(1), 2 * sample, scale).collect():
        rows = _matrix(r.vals, r.dim)
        known[r.dim] = np.frombuffer(r.ids, np.int64), rows, principal_axes(rows)
    # both sides are dealt by hashes of ids, so a task that runs again deals each row as before
    dealt = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "b")

    def with_floors(batches):
        for b in batches:
            low = []
            for dim, ids, vals in zip(*(b.column(x).to_pylist() for x in ("dim", "ids", "vals"))):
                asked_ids = np.frombuffer(ids, np.int64)
                own = floors(_matrix(vals, dim), asked_ids, known[dim][1], known[dim][0], k) if dim in known else np.full(len(asked_ids), NONE)
                low.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.binary())], [*b.schema.names, "floor"])

    q = _packed(dealt, query_rows, scale).mapInArrow(with_floors, "b int, dim int, ids binary, vals binary, floor binary")
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(deal - 1)))).select(F.col("b").alias("q_block"), "part", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"), "floor")
    rows = usable.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(deal)).cast("int"))
    c = _packed(rows, block_rows, scale).withColumnRenamed("b", "part").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(batches):
        for b in batches:
            for dim, ids, vals, q_dim, q_ids, q_vals, low in zip(*(b.column(x).to_pylist() for x in ("dim", "ids", "vals", "q_dim", "q_ids", "q_vals", "floor"))):
                if dim != q_dim:
                    continue
                row_ids, asked_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                i, j, score, _ = search_block(_matrix(q_vals, dim), asked_ids, _matrix(vals, dim), row_ids, k, np.frombuffer(low, np.int64), known[dim][2] if dim in known else None)
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[i]), pa.array(row_ids[j]), pa.array(score)], ["query_id", "vec_id", "score"])

    found = c.join(q, ["q_block", "part"]).mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
