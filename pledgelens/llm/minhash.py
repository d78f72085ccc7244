"""Near-duplicate classes by DartMinHash over weighted shingles.

Words are runs of bytes that are not ASCII white space, A-Z in lower case; a document is its five-word shingles, each
weighing how often it occurs ("tf"), one plus the natural log of that ("log"), or one ("set"). The similarity of two
documents is the weighted one, the sum of the smaller weights over the sum of the larger.

A shingle's region is weight by rank. It is cut along the weight at 1, 2, 4, ...; in each piece that the weight
reaches, darts fall by a Poisson process over rank whose rate is the piece's width, each at a hashed height. Darts
are the same in all documents; a document's are those under its own weight, up to a rank of about (k ln k + 2k) over
its whole weight. Each dart belongs to one of k coordinates, and the earliest per coordinate is the signature. So a
document costs its shingles once and about k ln k darts, and a heavy shingle costs no more than the log of its weight.

Documents with equal words are one node. Nodes meet in bands of `rows` coordinates. In each bucket the node that
shares most buckets with others is the centre, and only (centre, node) pairs are verified, on whole weighted sets;
their links give components. Buckets that still hold several components are then searched for the missing links:
nodes outside a bucket's largest component are compared with all its nodes, in blocks of bounded size, by whole
sets, and the most similar node of each other component that reaches the threshold is verified. So a group of
thousands of copies costs about a pair for each, and no link between different texts that share a band is left out.
A centre's pairs are dealt to as many tasks as they fill. With 24 bands of 4, a pair at 0.8 shares none with
probability 3e-6.

Edge cases: null and empty texts, and those of white space only, have no shingle and form one class; texts of fewer
than five words are one shingle; the class id is the smallest non-null id in the class, null if there is none;
repeated rows and ids get the class of their text; other columns of the table don't matter (keep_one returns them as
they are, whatever their names); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.llm.common import LOWER, RollingHash, by_value, clean_text, materialise, mix, slices, word_spans
from pledgelens.llm.native import free_names

by_value(__name__)

GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_weights(data: np.ndarray, offsets: np.ndarray, n: int, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the distinct shingles of each row, ordered by row and hash."""
    low = LOWER[data]
    start, end, row = word_spans(low, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    word = RollingHash(low).of(start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    place = np.arange(len(row)) - first[row]
    opens = (place + n <= count[row]) | (place == 0)
    at = np.flatnonzero(opens)
    h = mix(word[at])
    for k in range(1, n):
        there = np.minimum(at + k, len(word) - 1)
        inside = place[at] + k < count[row[at]]
        h = np.where(inside, mix(h * np.uint64(5) + word[there]), h)
    row = row[at]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
    times = np.diff(np.r_[at, len(h)]).astype(float)
    return row[at], h[at], {"set": np.ones_like, "tf": lambda x: x, "log": lambda x: 1 + np.log(x)}[weights](times)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


def dart_signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Ids of each row's earliest dart per coordinate, (rows, k); zeros for rows without a shingle."""
    total = np.bincount(row, weight, rows).astype(float)
    # the pieces of the weight axis that each shingle reaches: [0, 1), [1, 2), [2, 4), ...
    pieces = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(row)), pieces)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low = np.where(piece == 0, 0.0, 2.0 ** (piece - 1))
    width = np.where(piece == 0, 1.0, low)
    seed = mix(shingle[of] + GOLD * piece.astype(np.uint64))
    owner, height = row[of], weight[of]
    best = np.full(rows * k, np.inf)
    ident = np.zeros(rows * k, np.uint64)
    todo = total > 0
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-9)
    while todo.any():
        own = np.flatnonzero(todo[owner])
        rank = np.zeros(len(own))
        step = 1
        while len(own):
            h = mix(seed[own] + np.uint64(int(GOLD) * step % 2**64))
            rank = rank - np.log1p(-_uniform(h)) / width[own]
            keep = rank < limit[owner[own]]
            own, rank, h = own[keep], rank[keep], h[keep]
            dart = mix(h ^ GOLD)
            inside = low[own] + width[own] * _uniform(mix(dart + GOLD)) < height[own]
            r, d, g = owner[own][inside], rank[inside], dart[inside]
            at = r * k + (g % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, at, d)
            won = d == best[at]
            ident[at[won]] = g[won]
            step += 1
        todo &= ~np.isfinite(best).reshape(rows, k).all(axis=1)
        limit = limit * 2
    return ident.reshape(rows, k)


def _keys(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [hashlib.blake2b(b" ".join(raw[a:b].lower().split()), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def sign(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, weights: str) -> DataFrame:
    """id, node (hash of the words), n (whole weight), bands (hash of each band), text_key (hash of the whole text)."""
    k = bands * rows

    def run(batches):
        for part, data, offsets in slices(batches, "body"):
            row, shingle, weight = shingle_weights(data, offsets, words, weights)
            ids = dart_signatures(row, shingle, weight, part.num_rows, k)
            n = np.bincount(row, weight, part.num_rows).astype(float)  # a slice without any shingle gives whole numbers
            h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (part.num_rows, bands)).copy()
            for c in range(rows):
                h = mix(h * np.uint64(31) + ids[:, c::rows])
            at = np.r_[0, np.cumsum(np.where(n > 0, bands, 0))]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h[n > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_keys(data, offsets), pa.binary()), pa.array(n), lists, part.column("text_key")], ["id", "node", "n", "bands", "text_key"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.xxhash64(clean_text(text_col)).alias("text_key"))
    return source.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, node binary, n double, bands array<long>, text_key long")


ITEM = np.dtype([("shingle", "<u8"), ("weight", "<f4")])


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int, weights: str) -> DataFrame:
    """node and its whole weighted shingles (ITEM, sorted) for the nodes whose document ids are wanted."""

    def run(batches):
        for part, data, offsets in slices(batches, "body"):
            row, shingle, weight = shingle_weights(data, offsets, words, weights)
            items = np.zeros(len(row), ITEM)
            items["shingle"], items["weight"] = shingle, weight
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.array(_keys(data, offsets), pa.binary()), pa.array([items[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["node", "shingles"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    ids = wanted.select(F.col("rep").alias("_rep")).distinct()
    return source.join(ids, source.id.eqNullSafe(ids._rep), "left_semi").select("body").mapInArrow(run, "node binary, shingles binary")


def similarity(x: bytes, y: bytes) -> float:
    """Weighted similarity of two sets of ITEMs."""
    s, t = np.frombuffer(x, ITEM), np.frombuffer(y, ITEM)
    _, i, j = np.intersect1d(s["shingle"], t["shingle"], assume_unique=True, return_indices=True)
    both = float(np.minimum(s["weight"][i], t["weight"][j]).sum(dtype=float))
    whole = float(s["weight"].sum(dtype=float) + t["weight"].sum(dtype=float)) - both
    return both / whole if whole else 1.0


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. The pairs of an `a` with more than BLOCK partners are dealt to several tasks."""

    def run(batches):
        for batch in batches:
            ok = np.array([similarity(x.as_py(), y.as_py()) >= threshold - 1e-9 for x, y in zip(batch.column("x"), batch.column("y"))], bool)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    left = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # the few that are dealt stand in a table of their own, so that a join with them can split their rows
    deals = materialise(pairs.groupBy("a").agg(F.expr(f"cast(1 + count(*) div {BLOCK} AS int)").alias("deals")).where("deals > 1"))
    often = F.coalesce("deals", F.lit(1))
    right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(deals, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), often - 1)).alias("deal"))
    dealt = pairs.join(deals, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), often).cast("int").alias("deal"))
    return dealt.join(left, "b").join(right, ["a", "deal"]).select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


BLOCK = 512  # members of a bucket that one task compares at most with as many others


SHORT = np.dtype([("shingle", "<u4"), ("weight", "<f4")])


def _short_sets(sets: DataFrame) -> DataFrame:
    """node and the low half of its shingles' hashes with their weights; hashes that fall together add up, so no similarity gets smaller."""

    def short(x: bytes) -> bytes:
        items = np.frombuffer(x, ITEM)
        key, which = np.unique(items["shingle"].astype(np.uint32), return_inverse=True)
        out = np.zeros(len(key), SHORT)
        out["shingle"], out["weight"] = key, np.bincount(which, items["weight"], len(key))
        return out.tobytes()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([short(x) for x in batch.column("shingles").to_pylist()], pa.binary())], ["node", "short"])

    return sets.select("node", "shingles").mapInArrow(run, "node binary, short binary")


def _cross_search(threshold: float):
    """Within a block of a bucket: each query node's most similar member in every other component, if it reaches the threshold."""

    def search(group: pa.Table) -> pa.Table:
        node, comp = group.column("node").to_pylist(), group.column("comp").to_pylist()
        number = {c: k for k, c in enumerate(set(comp))}
        code = np.array([number[c] for c in comp])
        sets = [np.frombuffer(x, SHORT) for x in group.column("short").to_pylist()]
        size = np.array([len(x) for x in sets])
        n = np.array([x["weight"].sum(dtype=float) for x in sets])
        member = np.flatnonzero(np.asarray(group.column("member").combine_chunks()))
        a, b = [], []
        if len(member):
            flat, owner = np.concatenate([sets[i] for i in member]), np.repeat(np.arange(len(member)), size[member])
            order = np.argsort(flat["shingle"], kind="stable")
            keys, heights, owner = flat["shingle"][order], flat["weight"][order], owner[order]
            for i in np.flatnonzero(np.asarray(group.column("query").combine_chunks())):
                low, high = np.searchsorted(keys, sets[i]["shingle"]), np.searchsorted(keys, sets[i]["shingle"], "right")
                hits = high - low
                at = np.repeat(low - np.r_[0, np.cumsum(hits)[:-1]], hits) + np.arange(int(hits.sum()))
                both = np.bincount(owner[at], np.minimum(heights[at], np.repeat(sets[i]["weight"], hits)), len(member))
                like = both / (n[i] + n[member] - both) + 1e-6
                near = np.flatnonzero((like >= threshold) & (code[member] != code[i]))
                best: dict[int, int] = {}
                for j in near[np.argsort(-like[near], kind="stable")].tolist():
                    best.setdefault(int(code[member[j]]), j)
                for j in best.values():
                    x, y = sorted((node[i], node[member[j]]))
                    a.append(x)
                    b.append(y)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return search


def _blocks(labelled: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components and untried pairs, dealt into blocks: band, x, y, node, comp, member, query.

    Buckets of two are tried as (centre, node). Nodes outside a bucket's largest component are queries for all its members.
    """
    sizes = labelled.groupBy("band", "comp").agg(F.count("*").alias("n"))
    # written before the join, so that a bucket with many rows can be split there
    largest = materialise(sizes.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.sum("n").alias("members"), F.count("*").alias("kinds")).where("members > 2 AND kinds > 1"))
    rows = labelled.join(largest, "band").withColumn("rest", F.col("comp") != F.col("largest"))
    rows = rows.withColumn("blocks", F.expr(f"cast(1 + (members - 1) div {BLOCK} AS int)")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = "array_distinct(concat(transform(sequence(0, blocks - 1), k -> named_struct('x', own, 'y', k)), if(rest, transform(sequence(0, blocks - 1), k -> named_struct('x', k, 'y', own)), array())))"
    rows = rows.select("band", "node", "comp", "rest", "own", F.explode(F.expr(cells)).alias("cell"))
    return rows.select("band", "cell.x", "cell.y", "node", "comp", (F.col("cell.x") == F.col("own")).alias("member"), (F.col("rest") & (F.col("cell.y") == F.col("own"))).alias("query"))


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each linked node reaches, by label passing and shortcuts until nothing changes."""
    both = materialise(links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a")).distinct())
    label = materialise(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("comp")))
    while True:
        near = both.join(label.withColumnsRenamed({"node": "near"}), "near").select("node", "comp", F.lit(None).cast("binary").alias("old"))
        passed = near.union(label.select("node", "comp", F.col("comp").alias("old"))).groupBy("node").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = materialise(passed.join(up, "comp", "left").select("node", F.least("comp", F.coalesce("top", "comp")).alias("comp"), "old"))
        if new.where(F.col("comp") != F.col("old")).isEmpty():
            return new.select("node", "comp")
        label = new.select("node", "comp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5, bands: int = 24, rows: int = 4, weights: str = "tf") -> DataFrame:
    """(id_col, node, class_id, comp, text_key) for each row: node is a hash of the document's words, class_id the smallest id of its class, comp the class."""
    signed = materialise(sign(docs, id_col, text_col, words, bands, rows, weights))
    nodes = materialise(signed.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    held = nodes.select("node", F.explode("bands").alias("band"))
    shared = held.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    held = materialise(held.join(shared, "band"))
    known = held.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = held.join(known, "node")
    centre = weighed.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("c")).select("band", F.col("c.node").alias("a"))
    sizes = nodes.select("node", "n", "rep")
    fits = F.least("n_a", "n_b") >= (threshold - 1e-9) * F.greatest("n_a", "n_b")
    pairs = weighed.join(centre, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()

    def sized(p: DataFrame) -> DataFrame:
        p = p.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
        return p.where(fits).select("a", "b")

    pairs = materialise(sized(pairs))
    sets = materialise(_sets(docs, sizes.join(known, "node", "left_semi"), id_col, text_col, words, weights).dropDuplicates(["node"]).join(known, "node", "left_semi"))
    links = materialise(_verified(pairs, sets, threshold))
    comp = components(links)

    # buckets with more than one component: look for the links that the centres did not show
    cells = materialise(_blocks(held.join(comp, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))))
    if not cells.isEmpty():
        short = _short_sets(sets.join(cells, "node", "left_semi"))
        found = cells.join(short, "node").groupBy("band", "x", "y").applyInArrow(_cross_search(threshold), "a binary, b binary").distinct()
        late = materialise(_verified(found, sets, threshold))
        if not late.isEmpty():
            comp = components(links.union(late))
    classes = nodes.join(comp, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    # of components of several nodes only, in a table of its own, so that a join with it can split a large component's rows
    lowest = materialise(classes.groupBy("comp").agg(F.min("rep").alias("class_id"), F.count("*").alias("k")).where("k > 1").drop("k"))
    named = materialise(classes.join(lowest, "comp", "left").select("node", F.coalesce("class_id", "rep").alias("class_id"), "comp"))
    return signed.select(F.col("id").alias(id_col), "node", "text_key").join(named, "node").select(id_col, "node", "class_id", "comp", "text_key")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without all but one of each class: the row with the smallest id stays, one without an id only if no row has one."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    first = found.groupBy("comp").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "text_key")).alias("k"))
    (key,) = free_names(docs, "_text_key")
    kept = first.select(F.col("k.id").alias("kept_id"), F.col("k.text_key").alias("kept_key"))
    rows = docs.withColumn(key, F.xxhash64(clean_text(text_col)))
    left = rows.join(kept, rows[id_col].eqNullSafe(kept.kept_id) & (rows[key] == kept.kept_key), "left_semi")
    return left.dropDuplicates([id_col, key]).select(*docs.columns)
