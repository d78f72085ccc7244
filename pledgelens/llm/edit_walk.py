"""Document fingerprints by a randomised edit embedding.

A shared random walk copies a text to a longer string: at step j the walker writes the character it stands on and
moves on or stays by a random bit that depends on j and the character's class (one of 64). Two texts' walks fall
into step again after an edit, so the Hamming distance of the strings follows the texts' edit distance. A
fingerprint keeps the classes written at fixed random steps, up to `SAMPLES` in each octave of steps until the walk
ends, so it covers whole texts of any length with a few hundred characters, and texts share their sample steps.
The likeness of two fingerprints is the share of equal samples, each weighted by the steps it stands for. The texts
of a slice of about 2 MB (one longer text comes alone) walk side by side. Near pairs come from bands of samples and are verified by their edit distance.

Edge cases: null and empty texts have an empty fingerprint, and likeness 1 to each other; equal texts have equal
fingerprints; the last document's next is the first, a single document's is itself; equal ids are ordered by a hash
of their texts; null ids come first; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pledgelens.llm.common import SLICE_BYTES, by_value, clean_text, materialise, per_process

by_value(__name__)

SAMPLES = 32
PERIOD = 1 << 14
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-", np.uint8)
OVER = 64  # the class past a text's end: the walker stays


def _octave(k: int) -> np.ndarray:
    """Sample steps of octave k: [2**k, 2**(k+1)); octave 0 has step 0 too."""
    if 1 << k <= SAMPLES:
        return np.arange(0 if k == 0 else 1 << k, 2 << k)
    return np.sort(np.random.default_rng(1000 + k).choice(1 << k, SAMPLES, replace=False)) + (1 << k)


def _moves() -> np.ndarray:
    table = np.random.default_rng(77).integers(0, 2, (PERIOD, OVER + 1), dtype=np.uint8)
    table[:, OVER] = 0
    return table


def classes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for t in texts:
        p = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out.append(((p * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8))
    return out


def walk(texts: list[str]) -> list[str]:
    """Fingerprints of the texts."""
    if not texts:
        return []
    moves = per_process("edit_walk_moves", _moves)
    flat = classes(texts)
    size = np.array([len(x) for x in flat])
    order = np.argsort(-size, kind="stable")
    begin = np.zeros(len(texts), np.int64)
    stops = np.cumsum(size[order] + 1)
    begin = stops - size[order] - 1
    board = np.full(int(stops[-1]), OVER, np.uint8)
    for k, i in enumerate(order):
        board[begin[k] : begin[k] + size[i]] = flat[i]
    out = [bytearray() for _ in texts]
    at = begin.copy()
    alive = int((size > 0).sum())
    at = at[:alive]
    step, octave = 0, 0
    who = order[:alive]
    while len(at):
        samples = _octave(octave)
        taken = []
        for s in samples.tolist() + [(2 << octave)]:
            while step < s:
                at += moves[step & (PERIOD - 1)].take(board.take(at))
                step += 1
            if s < 2 << octave:
                taken.append(board[at])
        block = LETTERS[np.stack(taken, axis=1)] if taken else np.zeros((len(at), 0), np.uint8)
        for i, row in zip(who.tolist(), block):
            out[i] += row.tobytes()
        going = board[at] != OVER
        at, who = at[going], who[going]
        octave += 1
    return [x.rstrip(b"-").decode() for x in out]


def likeness(a: str, b: str) -> float:
    """Weighted share of equal samples, 0 to 1."""
    n = max(len(a), len(b))
    if not n:
        return 1.0
    x, y = (np.frombuffer(t.ljust(n, "-").encode(), np.uint8) for t in (a, b))
    weight, k = [], 0
    while len(weight) < n:
        s = len(_octave(k)) if 1 << k <= SAMPLES else SAMPLES
        weight += [((2 << k) - (0 if k == 0 else 1 << k)) / s] * s
        k += 1
    w = np.array(weight[:n])
    return float(w[x == y].sum() / w.sum())


def text_slices(texts: list[str], limit: int = SLICE_BYTES):
    """Ranges of texts that hold about `limit` characters; one longer text comes alone."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def edit_fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Add fingerprint; a column of that name is replaced."""
    from pyspark.sql import types as T

    kept = docs.drop("fingerprint")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            for a, b in text_slices(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(walk(texts[a:b]), pa.string())], [*part.schema.names, "fingerprint"])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("fingerprint", T.StringType())]))


def edited(text: str, after: str) -> str:
    """The last half of the characters replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) in the order of ids.

    One shuffle brings the texts into ranges of ids; a range's last document waits for the next range's first, and
    these few texts (two for each range) are joined afterwards.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), clean_text(text_col).alias("body")).withColumn("tie", F.xxhash64("body"))
    ranges = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def compared(ids: list, texts: list[str], afters: list[str]) -> dict:
        changed = [edited(t, a) for t, a in zip(texts, afters)]
        different = list(dict.fromkeys([*texts, *afters, *changed]))
        prints = dict(zip(different, walk(different)))
        return {
            "id": ids,
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": [prints[t] for t in texts],
            "edited_fingerprint": [prints[t] for t in changed],
            "near_edited": [likeness(prints[t], prints[c]) for t, c in zip(texts, changed)],
            "near_next": [likeness(prints[t], prints[a]) for t, a in zip(texts, afters)],
        }

    types = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches):
        part, first, last = TaskContext.get().partitionId(), None, None
        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field("id").type
            ids, texts = b.column("id").to_pylist(), b.column("body").to_pylist()
            if first is None:
                first = ids[0], texts[0]
            if last is not None:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids[-1], texts[-1]
            for x, y in text_slices(texts[:-1]):
                got, n = compared(ids[x:y], texts[x:y], texts[x + 1 : y + 1]), y - x
                yield pa.RecordBatch.from_arrays([pa.array(got["id"], kind), *(pa.array(got[c], t) for c, t in types.items()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, kind), pa.nulls(n, pa.string())], names)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], kind), *(pa.nulls(1, t) for t in types.values()), pa.array([part], pa.int32()), pa.array([last[1]]), pa.array([first[0]], kind), pa.array([first[1]])], names)

    names = ["id", *types, "part", "last_text", "first_id", "first_text"]
    kind = id_type.simpleString()
    columns = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    made = materialise(ranges.mapInArrow(run, f"id {kind}, {columns}, part int, last_text string, first_id {kind}, first_text string"))
    # one row for each range that has rows; at most as many as there are partitions
    edge = made.where("part IS NOT NULL")
    order = edge.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    firsts = edge.select(F.col("part").alias("next_part"), "first_text")
    tails = edge.select("id", "last_text", "part").join(order, "part").join(firsts, "next_part").select("id", "last_text", "first_text")

    def close(batches):
        for b in batches:
            texts, afters = b.column("last_text").to_pylist(), b.column("first_text").to_pylist()
            for x, y in text_slices(texts):
                got = compared(b.column("id").to_pylist()[x:y], texts[x:y], afters[x:y])
                yield pa.RecordBatch.from_arrays([b.column("id").slice(x, y - x), *(pa.array(got[c], t) for c, t in types.items())], ["id", *types])

    done = made.where("part IS NULL").select("id", *types).unionByName(tails.mapInArrow(close, f"id {kind}, {columns}"))
    return done.withColumnRenamed("id", id_col)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one machine word of any width for the column (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
    return score


def edit_near_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", at_most: float = 0.05, bands: int = 16, samples: int = 6, block: int = 256) -> DataFrame:
    """(id_a, id_b, distance): class representatives at an edit distance of at most `at_most` of the longer text, and copies' members.

    Equal texts are one class, whose smallest id stands for it. A band is a draw of samples of a text's last octaves;
    all representatives of a band's bucket are compared with each other, block by block.
    """
    rows = docs.select(F.col(id_col).alias("id"), clean_text(text_col).alias("body"))
    classes_ = rows.groupBy("body").agg(F.min("id").alias("id"))
    printed = edit_fingerprints(classes_, text_col="body")

    def run(batches):
        for b in batches:
            out_id, out_band = [], []
            for i, fp in zip(b.column("id").to_pylist(), b.column("fingerprint").to_pylist()):
                # whole octaves up to the text's scale and the one below, so that near lengths meet
                for scale in {max(0, len(fp) // SAMPLES), max(0, len(fp) // SAMPLES - 1)}:
                    low = fp[: scale * SAMPLES]
                    for k in range(bands):
                        at = np.random.default_rng((k, scale)).integers(max(0, len(low) - 3 * SAMPLES), max(1, len(low)), samples)
                        out_id.append(i)
                        out_band.append(f"{scale}.{k}." + "".join(low[j] if j < len(low) else "-" for j in at))
            yield pa.RecordBatch.from_arrays([pa.array(out_id, b.schema.field("id").type), pa.array(out_band, pa.string())], ["id", "band"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = printed.select("id", "fingerprint").mapInArrow(run, f"id {kind}, band string")
    # a bucket's representatives are dealt by id into blocks of about `block`, and a join key is one pair of blocks
    held = materialise(held.distinct())
    size = held.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = held.join(size, "band").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = dealt.select("band", "b", F.col("id").alias("id_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"))
    right = dealt.select("band", F.col("b").alias("c"), F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    pairs = left.join(right, ["band", "b", "c"]).where("id_a < id_b").select("id_a", "id_b").distinct()
    text = classes_.select("id", "body")
    found = pairs.join(text.select(F.col("id").alias("id_a"), F.col("body").alias("a")), "id_a").join(text.select(F.col("id").alias("id_b"), F.col("body").alias("b")), "id_b")
    found = found.where(F.abs(F.length("a") - F.length("b")) <= at_most * F.greatest(F.length("a"), F.length("b")))

    def verify(batches):
        for b in batches:
            d = [edit_distance(x, y) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id_a"), b.column("id_b"), pa.array(d, pa.int64())], ["id_a", "id_b", "distance"])

    near = found.select("id_a", "id_b", "a", "b").mapInArrow(verify, f"id_a {kind}, id_b {kind}, distance long")
    size = found.select("id_a", "id_b", F.greatest(F.length("a"), F.length("b")).alias("n"))
    near = near.join(size, ["id_a", "id_b"]).where(F.col("distance") <= at_most * F.col("n")).select("id_a", "id_b", "distance")
    copies = rows.join(classes_.select("body", F.col("id").alias("id_a")), "body").where("id > id_a").select("id_a", F.col("id").alias("id_b"), F.lit(0).cast("long").alias("distance"))
    return near.unionByName(copies)
