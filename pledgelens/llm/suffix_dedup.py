"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else too, in this or another document.
Sorting every suffix of the corpus would move hundreds of times its size, so suffixes that cannot or need not be
compared are settled before the sort, without loss:

1. Every window of `length` bytes has an anchor, its leftmost 16-gram of the smallest hash. Windows in a row with one
   anchor are a unit (about 90 windows), cut where the anchor lies 92 bytes in, so all windows of a unit share a core
   of 108 bytes. Equal windows have equal cores. Units are dealt by the hash of their core: a unit whose whole
   context occurs again is repeated as a whole; one whose core occurs in no other context has no other repeats; of
   each context of a core that occurs in several, one unit goes on.
2. These are dealt again by cores of 185 bytes, 16 windows each.
3. What is left (windows where two contexts begin to differ) is sorted: each task sorts its suffixes, whole, into runs
   and drops a run's repeats. Splitters from a hashed sample of the suffixes cut all runs into the same key ranges, so
   the ranges in order hold all suffixes in order. A range's runs are sent front-coded (the length of the prefix shared with the
   suffix before, and the other bytes), and a loser tree merges them. It keeps each run's common prefix with the last
   suffix that went out, compares bytes only behind it, and a suffix is a repeat where that prefix is the whole of it.

A core with many contexts in one slice sends two of them as evidence and takes the others on to the next step, and
repeats within a slice or run are sent once, so a passage that a third of the documents share puts no load on one task.
Repeated rows have one key; what is found of a key is kept once.

Steps 1 and 2 settle a window as a repeat by two equal 64-bit hashes (core and whole context), step 3 by its bytes.

Edge cases: null and empty texts have no byte; texts shorter than `length` keep all; repeated rows repeat each
other's strings; windows never cross documents; columns besides id and text don't matter; an empty table gives an
empty table.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.llm.common import RollingHash, by_value, clean_text, materialise, mix, slices

by_value(__name__)

GRAM, WIDE, NARROW, EVIDENCE = 16, 92, 16, 64
SPLIT, SAMPLES, MOST_PARTS = 16, 64, 4096  # bytes of a splitter, samples for each range, key ranges at most
UNIT = np.dtype([("core", "<u8"), ("whole", "<u8"), ("key", "<i8"), ("lo", "<i4"), ("size", "u1"), ("top", "u1"), ("again", "u1")])
MARK, OPEN = 0, 1


def anchors(roll: RollingHash, n: int, length: int) -> np.ndarray:
    """For each window of `length` bytes: the place of its leftmost 16-gram of the smallest hash."""
    at = np.arange(n - GRAM + 1)
    value, place = (roll.of(at, at + GRAM) >> np.uint64(32)).astype(np.uint32), at.astype(np.int32)
    width, reach = length - GRAM + 1, 1

    def joined(by: int):
        later = value[by:] < value[:-by]
        return np.minimum(value[by:], value[:-by]), np.where(later, place[by:], place[:-by])

    while reach * 2 <= width:
        value, place = joined(reach)
        reach *= 2
    return joined(width - reach)[1] if reach < width else place


def wide_units(data: np.ndarray, offsets: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """The units of a slice of texts; `lo` counts from each text's start."""
    if len(data) < length:
        return np.zeros(0, UNIT)
    roll = RollingHash(data)
    anchor = anchors(roll, len(data), length).astype(np.int64)
    p = np.arange(len(anchor))
    row = np.searchsorted(offsets, p, "right") - 1
    inside = p + length <= offsets[row + 1]
    p, anchor, row = p[inside], anchor[inside], row[inside]
    if not len(p):
        return np.zeros(0, UNIT)
    far = anchor - p >= WIDE
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (far[1:] != far[:-1])])
    lo, hi, a, left, row = p[new], p[np.r_[new[1:], len(p)] - 1], anchor[new], far[new], row[new]
    begin = np.where(left, a - WIDE, a)
    out = np.zeros(len(lo), UNIT)
    out["core"] = mix(roll.of(begin, begin + length - WIDE) + left.astype(np.uint64))
    out["whole"] = mix(roll.of(lo, hi + length) * np.uint64(3) + (a - lo).astype(np.uint64))
    out["key"], out["lo"], out["size"], out["top"] = key[row], lo - offsets[row], hi - lo + 1, a - lo
    return out


def narrow_units(data: np.ndarray, offsets: np.ndarray, key: np.ndarray, row: np.ndarray, lo: np.ndarray, size: np.ndarray, top: np.ndarray, length: int) -> np.ndarray:
    """Open units cut into those of 16 windows by the distance of the anchor."""
    first, last = (top - size + 1) // NARROW, top // NARROW
    n = last - first + 1
    i = np.repeat(np.arange(len(lo)), n)
    j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    a = lo[i] + top[i]
    begin, end = np.maximum(lo[i], a - NARROW * j - NARROW + 1), np.minimum(lo[i] + size[i] - 1, a - NARROW * j)
    base = offsets[row[i]]
    roll = RollingHash(data)
    core = a - NARROW * j + base
    out = np.zeros(len(i), UNIT)
    out["core"] = mix(roll.of(core, core + length - NARROW + 1) + j.astype(np.uint64))
    out["whole"] = mix(roll.of(begin + base, end + base + length) * np.uint64(3) + (a - begin).astype(np.uint64))
    out["key"], out["lo"], out["size"], out["top"] = key[row[i]], begin, end - begin + 1, a - begin
    return out


def _deal(units: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blobs of units by bucket (kind OPEN), and what the slice settles by itself (kind MARK: marks and open units, first field 0 or 1)."""
    units = units[np.lexsort((units["whole"], units["core"]))]
    new_core = np.r_[True, units["core"][1:] != units["core"][:-1]] if len(units) else np.zeros(0, bool)
    new = new_core.copy()
    new[1:] |= units["whole"][1:] != units["whole"][:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(units)])
    rest = units[~new]  # repeats of a context within the slice
    rest = rest[np.lexsort((rest["lo"], rest["key"]))]  # those of repeated rows once
    rest = rest[np.r_[True, (rest["key"][1:] != rest["key"][:-1]) | (rest["lo"][1:] != rest["lo"][:-1])]] if len(rest) else rest
    first = units[at]
    first["again"] = times > 1
    core = np.cumsum(new_core[at]) - 1
    many = np.bincount(core)[core] > EVIDENCE if len(core) else np.zeros(0, bool)
    place = np.arange(len(core)) - np.searchsorted(core, core)
    kind, bucket, blob = [], [], []
    goes = first[~many | (place < 2)]
    to = (mix(goes["core"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    goes, to = goes[order], to[order]
    cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    for x, y in zip(cut, np.r_[cut[1:], len(to)]):
        kind.append(OPEN)
        bucket.append(int(to[x]))
        blob.append(goes[x:y].tobytes())
    own = [(MARK, rest), (MARK, first[many & (times > 1)]), (OPEN, first[many & (place >= 2)])]
    for k, part in own:
        if len(part):
            part = part.copy()
            part["again"] = k
            kind.append(MARK)
            bucket.append(int(part["key"][0] % buckets))
            blob.append(part.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])


FOUND = "key long, lo int, size int, top int, kind int"


def _found(units: np.ndarray, kind: np.ndarray) -> pa.Table:
    return pa.table({"key": pa.array(units["key"]), "lo": pa.array(units["lo"]), "size": pa.array(units["size"].astype(np.int32)), "top": pa.array(units["top"].astype(np.int32)), "kind": pa.array(kind.astype(np.int32))})


def _settle(group: pa.Table) -> pa.Table:
    """Marks for the contexts that occur again, and one open unit for each context of a core that has several."""
    kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
    own = np.frombuffer(b"".join(b for k, b in zip(kinds, blobs) if k == MARK), UNIT)
    units = np.frombuffer(b"".join(b for k, b in zip(kinds, blobs) if k == OPEN), UNIT)
    units = units[np.lexsort((units["whole"], units["core"]))]
    if not len(units):
        return _found(own, own["again"])
    new_core = np.r_[True, units["core"][1:] != units["core"][:-1]]
    new = new_core.copy()
    new[1:] |= units["whole"][1:] != units["whole"][:-1]
    at = np.flatnonzero(new)
    again = (np.diff(np.r_[at, len(units)]) > 1) | (np.add.reduceat(units["again"], at, dtype=np.int64) > 0)
    core = np.cumsum(new_core[at]) - 1
    several = np.bincount(core)[core] > 1
    marked = units[np.repeat(again, np.diff(np.r_[at, len(units)]))]
    opened = units[at[several]]
    return _found(np.concatenate([marked, opened, own]), np.r_[np.full(len(marked), MARK), np.full(len(opened), OPEN), own["again"]])


# ---- sorted runs -------------------------------------------------------------------------------------------------

RUN_WINDOWS = 1 << 16


def sorted_run(windows: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, what each shares with the one before (bytes), their keys and places."""
    n, length = windows.shape
    if not n:
        return windows, np.zeros(0, np.int64), key, place
    words = -(-length // 8)
    padded = np.zeros((n, words * 8), np.uint8)
    padded[:, :length] = windows
    big = padded.view(">u8")
    order = np.lexsort((big[:, 1], big[:, 0]))
    # rows that agree in the first words with a neighbour are put in order by all their bytes, in the places that they hold
    same = (big[order][1:, :2] == big[order][:-1, :2]).all(axis=1)
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    part = order[tied]
    order[tied] = part[np.lexsort(big[part][:, ::-1].T)]
    windows = windows[order]
    differs = windows[1:] != windows[:-1]
    shared = np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), length)]
    return windows, shared, key[order], place[order]


def front_code(windows: np.ndarray, shared: np.ndarray) -> tuple[bytes, bytes]:
    """Shared prefix lengths (16 bits each) and the bytes behind them."""
    keep = np.arange(windows.shape[1])[None, :] >= shared[:, None]
    return shared.astype("<u2").tobytes(), windows[keep].tobytes()


class Run:
    """A front-coded run that gives its suffixes one by one; `prefix` is what a suffix shares with the last that the merge gave."""

    def __init__(self, shared: bytes, rest: bytes, length: int):
        self.shared, self.rest, self.length = np.frombuffer(shared, "<u2").tolist(), rest, length
        self.next, self.at, self.bytes, self.prefix = 0, 0, b"", 0

    def step(self) -> bool:
        if self.next == len(self.shared):
            return False
        self.prefix = self.shared[self.next]
        more = self.length - self.prefix
        self.bytes = self.bytes[: self.prefix] + self.rest[self.at : self.at + more]
        self.at += more
        self.next += 1
        return True


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Bytes that two suffixes of one length share, of which `known` are known."""
    n = len(a) - known
    apart = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return known + n - (apart.bit_length() + 7) // 8


def merge_runs(runs: list[Run]):
    """All suffixes of sorted runs in order, by a loser tree: (run, place in it, whether it equals the one given before).

    `prefix` of a waiting suffix is what it shares with the last winner on its path; of two suffixes, the one that shares more with
    that winner is smaller, and only where they share alike are the bytes behind the prefix compared.
    """
    k = 1
    while k < len(runs):
        k *= 2
    live = [r if r.step() else None for r in runs] + [None] * (k - len(runs))

    def less(x: int, y: int) -> bool:
        a, b = live[x], live[y]
        if a is None or b is None:
            return a is not None
        if a.prefix != b.prefix:
            return a.prefix > b.prefix
        i = common_prefix(a.bytes, b.bytes, a.prefix)
        first = x < y if i == a.length else a.bytes[i] < b.bytes[i]
        (b if first else a).prefix = i
        return first

    # play the first rounds bottom up; losers stay in the inner nodes
    loser, winner = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        x, y = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (x, y) if less(x, y) else (y, x)
    top, started = (winner[1] if k > 1 else 0), False
    while live[top] is not None:
        r = live[top]
        yield top, r.next - 1, started and r.prefix == r.length
        started = True
        if not r.step():
            live[top] = None
        node = (top + k) // 2
        while node:
            if less(loser[node], top):
                loser[node], top = top, loser[node]
            node //= 2


def _merge(group: pa.Table, length: int) -> pa.Table:
    """Places whose suffix occurs in two runs, or twice in one."""
    cols = {c: group.column(c).to_pylist() for c in ("shared", "rest", "again", "key", "place")}
    runs = [Run(*x, length) for x in zip(cols["shared"], cols["rest"])]
    again = [np.frombuffer(x, np.uint8) for x in cols["again"]]
    hit = [np.zeros(len(x), bool) for x in again]
    before = None
    for run, at, equal in merge_runs(runs):
        if equal:
            hit[run][at] = hit[before[0]][before[1]] = True
        before = run, at
    hits = [h | (a > 0) for h, a in zip(hit, again)]
    key = np.concatenate([np.frombuffer(x, np.int64)[h] for x, h in zip(cols["key"], hits)])
    place = np.concatenate([np.frombuffer(x, np.int32)[h] for x, h in zip(cols["place"], hits)])
    one = np.ones(len(key), np.int32)
    return pa.table({"key": key, "lo": place, "size": one, "top": one * 0, "kind": one * MARK})


def ranges_of(windows: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The key range of each suffix, by its first SPLIT bytes."""
    return np.searchsorted(splitters, np.ascontiguousarray(windows[:, :SPLIT]).view(f"S{SPLIT}")[:, 0], "right")


def _runs(windows: np.ndarray, key: np.ndarray, place: np.ndarray, splitters: np.ndarray):
    """Front-coded runs by key range, and marks for a run's own repeats."""
    windows, shared, key, place = sorted_run(windows, key, place)
    same = shared == windows.shape[1]
    at = np.flatnonzero(~same)
    again = np.diff(np.r_[at, len(same)]) > 1
    repeats = key[same], place[same]
    windows, shared, key, place = windows[at], shared[at], key[at], place[at]
    to = ranges_of(windows, splitters)
    cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(cut, np.r_[cut[1:], len(to)]):
        part = slice(a, b)
        own = shared[part].copy()
        own[0] = 0
        out.append((int(to[a]), *front_code(windows[part], own), again[part].astype(np.uint8).tobytes(), key[part].tobytes(), place[part].astype(np.int32).tobytes()))
    return out, repeats


# ---- the whole ---------------------------------------------------------------------------------------------------


def _covered(n: int, lo: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Bytes covered by the windows that start in the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + size - 1 + length, -1)
    return np.cumsum(edge[:n]) > 0


def _result(text: np.ndarray, lo: np.ndarray, size: np.ndarray, length: int) -> tuple[int, int, int, str]:
    gone = _covered(len(text), lo, size, length) if len(lo) else np.zeros(len(text), bool)
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), spans, sha256(text[~gone].tobytes()).hexdigest()


def _lists(part: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """Row numbers and flat values of list columns of equal lengths."""
    size = np.array([0 if x is None else x for x in part.column(names[0]).value_lengths().to_pylist()], np.int64)
    return (np.repeat(np.arange(part.num_rows), size), *(part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in names))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row; `length` from 200 bytes."""
    if length < 200:
        raise ValueError("length must be at least 200")
    rows = docs.select(F.col(id_col).alias("id"), clean_text(text_col).alias("body")).withColumn("key", F.xxhash64("id", "body"))
    id_type = docs.schema[id_col].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = int(max(64, total >> 23))

    def wide(batches):
        for part, data, offsets in slices(batches, "body"):
            yield _deal(wide_units(data, offsets, part.column("key").to_numpy(), length), buckets)

    dealt = "bucket int, kind int, blob binary"
    first = materialise(rows.select("key", "body").mapInArrow(wide, dealt).groupBy("bucket").applyInArrow(_settle, FOUND))

    def by_key(found: DataFrame, **names: str) -> DataFrame:
        """Each key's findings as lists, every one once."""
        g = found.groupBy("key").agg(F.collect_set(F.struct(*names.values())).alias("found"))
        return g.select("key", *(F.col(f"found.{c}").alias(n) for n, c in names.items()))


    def judge(batches):
        """Documents without open units are done; the others go on with their texts."""
        for part, data, offsets in slices(batches, "body"):
            row, lo, size, top, kind = _lists(part, "lo", "size", "top", "kind")
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            out = []
            for i in range(part.num_rows):
                s = slice(cut[i], cut[i + 1])
                waits = bool((kind[s] == OPEN).any())
                m = kind[s] == MARK
                out.append((None,) * 4 if waits else _result(data[offsets[i] : offsets[i + 1]], lo[s][m], size[s][m], length))
            waits = pa.array([x[0] is None for x in out])
            keep = lambda c: pa.array([v if w else None for v, w in zip(part.column(c).to_pylist(), waits.to_pylist())], part.column(c).type)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))), part.column("key"), *(keep(c) for c in ("body", "lo", "size", "top", "kind"))], ["id", *names, "key", "body", "lo", "size", "top", "kind"])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    result = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    lists = "lo array<int>, size array<int>, top array<int>, kind array<int>"
    judged = materialise(rows.join(by_key(first, lo="lo", size="size", top="top", kind="kind"), "key", "left").select("id", "key", "body", "lo", "size", "top", "kind").mapInArrow(judge, f"{result}, key long, body string, {lists}"))
    done = judged.where("n_bytes IS NOT NULL").select("id", *names)
    waiting = judged.where("n_bytes IS NULL").drop(*names)

    def narrow(batches):
        for part, data, offsets in slices(batches, "body"):
            row, lo, size, top, kind = _lists(part, "lo", "size", "top", "kind")
            o = kind == OPEN
            yield _deal(narrow_units(data, offsets, part.column("key").to_numpy(), row[o], lo[o], size[o], top[o], length), buckets)

    texts = waiting.dropDuplicates(["key"])
    second = materialise(texts.select("key", "body", "lo", "size", "top", "kind").mapInArrow(narrow, dealt).groupBy("bucket").applyInArrow(_settle, FOUND))
    opened = by_key(second.where(F.col("kind") == OPEN), lo="lo", size="size")

    def open_windows(batches):
        """The open windows of a slice, RUN_WINDOWS at a time: bytes, keys and places."""
        for part, data, offsets in slices(batches, "body"):
            row, lo, size = _lists(part, "lo", "size")
            place = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum())) if len(lo) else np.zeros(0, np.int64)
            row = np.repeat(row, size)
            key = part.column("key").to_numpy()[row]
            view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else np.zeros((0, length), np.uint8)
            for a in range(0, len(place), RUN_WINDOWS):
                b = slice(a, a + RUN_WINDOWS)
                yield view[place[b] + offsets[row[b]]], key[b], place[b]

    waits = texts.select("key", "body").join(opened, "key")
    n_open = second.where(F.col("kind") == OPEN).agg(F.sum("size")).first()[0] or 0
    parts = int(min(MOST_PARTS, max(8, n_open * length >> 25)))
    every = max(1, n_open // (parts * SAMPLES))  # one window in so many is a sample, chosen by a hash of its bytes

    def sample(batches):
        for windows, _, _ in open_windows(batches):
            heads = np.ascontiguousarray(windows[:, :SPLIT])
            chosen = mix(RollingHash(heads.ravel()).of(np.arange(len(heads)) * SPLIT, (np.arange(len(heads)) + 1) * SPLIT)) % np.uint64(every) == 0
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in heads[chosen]], pa.binary())], ["head"])

    # different heads only, a few for each range, so their number is bounded by the number of ranges
    heads = sorted(bytes(r.head) for r in waits.mapInArrow(sample, "head binary").distinct().collect()) if n_open else []
    splitters = np.unique(np.array([heads[len(heads) * k // parts] for k in range(1, parts)] if heads else [], f"S{SPLIT}"))

    def run(batches):
        for windows, key, place in open_windows(batches):
            blobs, (again_key, again_place) = _runs(windows, key, place, splitters)
            if len(again_key):
                blobs = [*blobs, (int(again_key[0] % parts), b"", b"", b"", again_key.tobytes(), again_place.astype(np.int32).tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([b[c] for b in blobs], pa.int32() if c == 0 else pa.binary()) for c in range(6)], ["part", "shared", "rest", "again", "key", "place"])

    def merged(group: pa.Table) -> pa.Table:
        plain = [not x for x in group.column("shared").to_pylist()]
        marks = group.filter(pa.array(plain))
        rest = group.filter(pa.array([not x for x in plain]))
        key = np.frombuffer(b"".join(marks.column("key").to_pylist()), np.int64)
        place = np.frombuffer(b"".join(marks.column("place").to_pylist()), np.int32)
        one = np.ones(len(key), np.int32)
        own = pa.table({"key": key, "lo": place, "size": one, "top": one * 0, "kind": one * MARK})
        return pa.concat_tables([own, _merge(rest, length)]) if rest.num_rows else own

    third = materialise(waits.mapInArrow(run, "part int, shared binary, rest binary, again binary, key binary, place binary").groupBy("part").applyInArrow(merged, FOUND))
    more = by_key(second.where(F.col("kind") == MARK).union(third), lo2="lo", size2="size")

    def close(batches):
        for part, data, offsets in slices(batches, "body"):
            row, lo, size, kind = _lists(part, "lo", "size", "kind")
            late, lo2, size2 = _lists(part, "lo2", "size2")
            cut, cut2 = np.searchsorted(row, np.arange(part.num_rows + 1)), np.searchsorted(late, np.arange(part.num_rows + 1))
            out = []
            for i in range(part.num_rows):
                s, t = slice(cut[i], cut[i + 1]), slice(cut2[i], cut2[i + 1])
                m = kind[s] == MARK
                out.append(_result(data[offsets[i] : offsets[i + 1]], np.r_[lo[s][m], lo2[t]], np.r_[size[s][m], size2[t]], length))
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["id", *names])

    late = waiting.join(more, "key", "left").select("id", "body", "lo", "size", "kind", "lo2", "size2").mapInArrow(close, result)
    return done.unionByName(late).withColumnRenamed("id", id_col)
