"""Language-model scoring with a probabilistic suffix tree over words, beside the unigram base score.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; each document is its words and one end token.
The alphabet is that of the base score: the V different training tokens and one symbol for every token outside
them. The root gives the outside symbol the share of training tokens that occur once, and each known token its
relative frequency of the rest. A context is up to `depth` tokens; its next-symbol distribution holds the successors
whose n-gram occurs at least `least` times, and is smoothed with the parent's distribution, which gets the mass of
all other successors. A context is kept if that distribution diverges from its parent's by more than the cost of its
parameters (log-likelihood gain over half a log of its count for each successor). Each token is scored in the state
of the longest kept suffix of what stands before it; a document starts after an end token.

The tree is never whole anywhere. Texts are read once and cut into chunks, whose words are counted by key and come back as
numbers; a chunk then sends each token, with up to `depth` tokens before it, to the bucket of its context's newest token.
All longer contexts, their successors and these successors' shorter n-grams meet in that bucket, so it grows its subtree
and scores its tokens alone; sums by document come back. A context with more than a third of a bucket of tokens is counted by
successors across buckets first (`heavy_level`), and its tokens are dealt out by the next older token. Rows between these
steps hold arrays as compressed byte planes. Tokens and contexts rarer than `least` are not sent further: nothing above
them can be an edge.

Edge cases: null and empty texts have the end token alone; rows with a null id are training rows; repeated rows count
as often as they occur; without training rows every token is outside; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.llm.common import LOWER, SPACE, RollingHash, by_value, discard, materialise, mix, pack, packed_lengths, slices, unpack, utf8, word_spans

by_value(__name__)

END = 1  # the number of the end token; 0: a token rarer than `least`, or none
SHARE = 1 << 17  # tokens of a chunk, and about as many of a bucket, that are worked on at once
PIECE = 1 << 20  # bytes of texts that are cut into words at once
TEXT, DOCS, TABLE = -1, -2, -3  # rows that are not a part's: a chunk's tokens, its documents; a heavy context's edges


def coded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all rows, coded, and how many each row has."""
    lengths, kept, per, at = [], [], [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        low = LOWER[data[offsets[at] : offsets[to]]]
        start, end, row = word_spans(low, offsets[at : to + 1] - offsets[at])
        lengths.append((end - start).astype(np.int32))
        kept.append(low[~SPACE[low]])
        per.append(np.bincount(row, minlength=to - at))
        at = to
    return strings(np.concatenate(lengths), np.concatenate(kept)).dictionary_encode(), np.concatenate(per)


def strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def by_rank(lengths: list[int]) -> np.ndarray:
    """Places in the parts' lists, one list after the other, in the order of rank in a list, then list."""
    part = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.arange(len(part)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.lexsort((part, rank))


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys, -1 where they are not there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, a place of each, and which of them each key is; in half the memory of np.unique."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys = keys[new]
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    which = np.empty(len(order), np.int32)
    which[order] = number
    return keys, order[new], which


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, a place of each, and sums of n."""
    keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return keys, first, np.bincount(which, n, len(keys)).astype(np.int64)


@dataclass
class Root:
    """Shares at the root; `limit`: how often an n-gram occurs at least."""

    n_all: int
    v: int
    outside: float
    ends: int
    limit: float

    def q(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (1 - self.outside) * np.maximum(c, 1) / max(1, self.n_all), self.outside)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n_all + 0.5 * (self.v + 1)))


@dataclass
class Heavy:
    """The heavy contexts of one length: place of the parent among those a token shorter << 32 | oldest token, sorted; how often
    they occur, in training, and before no edge; whether kept."""

    keys: np.ndarray
    n: np.ndarray
    total: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def q(self, h: np.ndarray, n: np.ndarray, below: np.ndarray) -> np.ndarray:
        return np.where(self.kept[h], (n + self.rest[h] * below) / self.total[h], below)

    def tail(self) -> np.ndarray:
        return np.where(self.kept, np.log10(np.maximum(self.rest, 1e-9) / np.maximum(self.total, 1)), 0.0)


class Chunk:
    """A chunk's tokens as places in its dictionary (`ids`, `c`), each document after an end token of its own; `back`: how many tokens
    of its document stand before each, up to `depth`, none before those that are not scored."""

    def __init__(self, blob: bytes, root: Root, depth: int):
        gaps, c, tokens, per, held = unpack(blob)
        self.ids = np.r_[0, END if root.ends >= root.limit else 0, np.cumsum(gaps)]
        self.c = np.r_[0, root.ends, c]
        self.depth = depth
        wide = per + 2
        first = np.cumsum(wide) - wide
        self.token = np.full(int(wide.sum()), 1, np.int32)
        inner = np.ones(len(self.token), bool)
        inner[first] = inner[first + per + 1] = False
        self.token[inner] = np.where(tokens > 0, tokens + 1, 0)
        del gaps, c, tokens, inner
        place = np.arange(len(self.token), dtype=np.int32)
        place -= np.repeat(first.astype(np.int32), wide)
        self.back = np.minimum(place, depth, out=place).astype(np.min_scalar_type(depth))
        self.doc = np.repeat(np.arange(len(per), dtype=np.int32), wide)
        self.train = held == 0

    def before(self, at: np.ndarray, d: int, used: np.ndarray) -> np.ndarray:
        """The token d places before each; 0 where the context is shorter."""
        return np.where(used >= d, self.token[np.maximum(at - d, 0)], 0)

    def known(self, at: np.ndarray) -> np.ndarray:
        token = self.token[at]
        return np.where(self.ids[token] > 0, token, 0)

    def shares(self):
        """Places of scored tokens, a share after the other, each with its context's length and the numbers of the tokens 1 to
        `depth` places before it; 0 from the first on that no context holds."""
        for a in range(0, len(self.token), SHARE):
            at = a + np.flatnonzero(self.back[a : a + SHARE])
            used, x = np.full(len(at), self.depth), []
            for d in range(1, self.depth + 1):
                used = np.minimum(used, self.back[at])
                number = self.ids[self.before(at, d, used)]
                used = np.where(number > 0, used, np.minimum(used, d - 1))
                x.append(number)
            if len(at):
                yield at, used, x


def heavy_places(x: list[np.ndarray], heavy: list[Heavy]) -> list[np.ndarray]:
    """For each length the place of the context x among the heavy ones, or -1."""
    out = [np.zeros(len(x[0]), np.int64)]
    for level, older in zip(heavy, x, strict=False):
        out.append(np.where((out[-1] >= 0) & (older > 0), found(level.keys, out[-1] << 32 | older), -1))
    return out[1:]


def subtree_scores(w: np.ndarray, x: list[np.ndarray], q0: np.ndarray, train: np.ndarray, limit: float, heavy: list[Heavy], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of each token's probability over that at the root. w, x: tokens and those before them; all tokens of each context
    that is not heavy are here; tables: of each length, heavy place << 32 | token, sorted, and the edges' probabilities."""
    diff, q, sel, g = np.zeros(len(w)), np.where(w > 0, q0, np.nan), np.arange(len(w), dtype=np.int32), np.zeros(len(w), np.int32)
    place = np.zeros(1, np.int64)
    for d, older in enumerate(x):
        on = older[sel] > 0
        sel, g = sel[on], g[on]
        if not len(sel):
            break
        contexts, _, g = grouped(g.astype(np.int64) << 32 | older[sel])
        up = place[contexts >> 32]
        place = np.where(up >= 0, found(heavy[d].keys, up << 32 | contexts & 0xFFFFFFFF), -1) if d < len(heavy) else np.full(len(contexts), -1)
        total = np.bincount(g, train[sel], len(contexts))
        on = ((total >= limit) | (place >= 0))[g]
        sel, g = sel[on], g[on]
        likely = ~np.isnan(q[sel])
        at, of = sel[likely], g[likely]
        _, first, which = grouped(of.astype(np.int64) << 32 | w[at])
        n, first, of = np.bincount(which, train[at], len(first)), at[first], of[first]
        below = q[first]
        del at
        edge = (n >= limit) & (place[of] < 0)
        safe = np.maximum(total, 1)
        rest = np.maximum(0, total - np.bincount(of[edge], n[edge], len(contexts)))
        p = (n + rest[of] * below) / safe[of]
        gain = np.bincount(of[edge], n[edge] * np.log(p[edge] / below[edge]), len(contexts)) + rest * np.log(np.maximum(rest, 1e-300) / safe)
        many = np.bincount(of[edge], minlength=len(contexts))
        kept = (many > 0) & (gain > 0.5 * many * np.log(total + 1))
        tail = np.where(kept, np.log10(np.maximum(rest, 1e-9) / safe), 0.0)
        now = np.where(edge, np.where(kept[of], p, below), np.nan)
        if (place >= 0).any():
            known = place[of] >= 0
            at_table = found(tables[d][0], place[of[known]] << 32 | w[first[known]])
            now[known] = np.r_[tables[d][1], np.nan][at_table]
            tail = np.where(place >= 0, heavy[d].tail()[np.maximum(place, 0)], tail)
        new = np.full(len(sel), np.nan)
        new[likely] = now[which]
        diff[sel] = np.where(np.isnan(new), diff[sel] + tail[g], np.log10(new) - np.log10(q0[sel]))
        q[sel] = new
    return diff


def targets(heavy: list[Heavy], ranges: list[tuple[np.ndarray, np.ndarray]], parts: int) -> list[list[np.ndarray]]:
    """Buckets that tokens of each heavy context go to: its own, and those of heavy contexts that continue it."""
    out = [[(a + np.arange(k)) % parts for a, k in zip(*r)] for r in ranges]
    for d in range(len(heavy) - 1, 0, -1):
        for mine, key in zip(out[d], heavy[d].keys):
            out[d - 1][key >> 32] = np.union1d(out[d - 1][key >> 32], mine)
    return out


def heavy_level(chunks: DataFrame, root: Root, heavy: list[Heavy], below: DataFrame | None, parts: int, most: int) -> tuple[DataFrame, Heavy | None]:
    """Counts the successors of the longest heavy contexts, dealt out by successor, and fills in heavy[-1]; the edges, and the
    heavy contexts one token longer."""
    d = len(heavy)

    def entries(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                chunk, pairs, children = Chunk(blob, root, d + 1), [], []
                for at, _, x in chunk.shares():
                    place = heavy_places(x, heavy)[-1]
                    on = np.flatnonzero((place >= 0) & chunk.train[chunk.doc[at]])
                    token = chunk.token[at[on]]
                    key, first, n = summed(place[on] << 32 | chunk.ids[token], np.ones(len(on)))
                    pairs.append((key, n, chunk.c[token[first]]))
                    on = np.flatnonzero((place >= 0) & (x[d] > 0))
                    child, _, m = summed(place[on] << 32 | x[d][on], np.ones(len(on)))
                    children.append((child, m))
                if not pairs:
                    continue
                key, n, c = (np.concatenate(y) for y in zip(*pairs))
                key, first, n = summed(key, n)
                c = c[first]
                child, m = (np.concatenate(y) for y in zip(*children))
                child, _, m = summed(child, m)
                a, b = (key & 0xFFFFFFFF) % parts, (child & 0xFFFFFFFF) % parts
                for p in np.union1d(a, b).tolist():
                    yield pa.record_batch([pa.array([p]), pa.array([0]), pa.array([pack(*np.divmod(key[a == p], 2**32), n[a == p], c[a == p], *np.divmod(child[b == p], 2**32), m[b == p])], pa.binary())], ["part", "kind", "blob"])

    def count(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        blobs = [unpack(x) for x in group.column("blob").to_pylist()]
        h, w, n, c, hc, xc, m = (np.concatenate(y) for y in zip(*(x for x, k in zip(blobs, kind) if k == 0))) if (kind == 0).any() else [np.zeros(0, np.int64)] * 7
        key, first, n = summed(h << 32 | w, n)
        h, w, c = h[first], w[first], c[first]
        every = np.bincount(h, n, len(heavy[-1].keys))
        edge = (w > 0) & (n >= root.limit)
        h, w, n, c = h[edge], w[edge], n[edge], c[edge]
        q = root.q(c)
        if d > 1:
            ph, pw, pn, pb = (np.concatenate(y) for y in zip(*(x for x, k in zip(blobs, kind) if k == 1))) if len(h) else [np.zeros(0, np.int64)] * 4
            order = np.argsort(pkey := ph << 32 | pw)
            q = heavy[-2].q(ph, pn, pb)[order][found(pkey[order], (heavy[-1].keys[h] >> 32) << 32 | w)] if len(h) else q
        child, _, m = summed(hc << 32 | xc, m)
        of = np.flatnonzero(every)
        rows = [(0, pack(h, w, n, q), None, None, None)] + [(1, None, int(i), int(every[i]), int(s)) for i, s in zip(of, np.bincount(h, n, len(every))[of])]
        rows += [(2, None, int(k), int(s), None) for k, s in zip(child[m >= most], m[m >= most])]
        return pa.table([pa.array([group.column("part")[0].as_py()] * len(rows)), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), *[pa.int64()] * 3)))], names=["part", "kind", "blob", "h", "n", "edges"])

    given = chunks.mapInArrow(entries, "part long, kind long, blob binary")
    if below is not None:
        given = given.unionByName(below.select("part", F.lit(1).cast("long").alias("kind"), "blob"))
    counted = materialise(given.groupBy("part").applyInArrow(count, "part long, kind long, blob binary, h long, n long, edges long"))
    top = heavy[-1]
    total, edges = np.zeros(len(top.keys)), np.zeros(len(top.keys))
    for r in counted.where("kind = 1").groupBy("h").agg(F.sum("n").alias("n"), F.sum("edges").alias("edges")).collect():
        total[r.h], edges[r.h] = r.n, r.edges
    top.total, top.rest = total, np.maximum(0, total - edges)
    top.kept = np.ones(len(top.keys), bool)
    longer = sorted((r.h, r.n) for r in counted.where("kind = 2").select("h", "n").collect())
    edges = counted.where("kind = 0").select("part", "blob")

    def gains(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                h, _, n, q = unpack(blob)
                gain, many = np.bincount(h, n * np.log(top.q(h, n, q) / q), len(total)).astype(float), np.bincount(h, minlength=len(total))
                of = np.flatnonzero(many)
                yield pa.record_batch([pa.array(of), pa.array(gain[of]), pa.array(many[of])], ["h", "gain", "many"])

    kept = np.zeros(len(total), bool)
    for r in edges.select("blob").mapInArrow(gains, "h long, gain double, many long").groupBy("h").agg(F.sum("gain").alias("gain"), F.sum("many").alias("many")).collect():
        rest, n = top.rest[r.h], total[r.h]
        kept[r.h] = r.gain + (rest * np.log(rest / n) if rest > 0 else 0) > 0.5 * r.many * np.log(n + 1)
    top.kept = kept
    return edges, Heavy(np.array([k for k, _ in longer]), np.array([n for _, n in longer])) if longer else None


def score_texts(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text", least: float = 2, depth: int = 3, chunk_bytes: int = 8 << 20, bucket: int = 2 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows where held_out is true are not learned from.

    bucket: about how many tokens are scored together.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("body"))
    id_type = docs.schema[id_col].dataType.simpleString()
    seen = rows.agg(F.sum(F.octet_length("body")).alias("bytes"), F.count("*").alias("rows"), F.count_if(~F.col("held")).alias("train")).first()
    ends, limit, most = seen.train, max(1, least), max(1, bucket // 3)
    lists = 1 + (seen.bytes or 0) // (2 * chunk_bytes)
    schema = f"chunk long, part long, blob binary, ids array<{id_type}>"
    names = ["chunk", "part", "blob", "ids"]

    def cut(batches):
        made = TaskContext.get().partitionId() << 32
        for batch, data, offsets in slices(batches, "body", chunk_bytes):
            words, per = coded_words(data, offsets)
            index, size = np.asarray(words.indices), len(words.dictionary)
            held = np.asarray(batch.column(batch.schema.get_field_index("held")))
            n, every = np.bincount(index[np.repeat(~held, per)], minlength=size), np.bincount(index, minlength=size)
            text, at = utf8(words.dictionary)
            part = (RollingHash(text).of(at[:-1], at[1:]) % np.uint64(lists)).astype(np.int64) if size else np.zeros(0, np.int64)
            order = np.lexsort((-every, part))
            ends_at = np.searchsorted(part[order], np.arange(lists + 1))
            number = np.empty(size, np.int64)
            number[order[by_rank(np.diff(ends_at))]] = np.arange(size)
            blobs = [pack(number[index], per, held.astype(np.uint8))]
            parts = [TEXT]
            for p, (a, b) in enumerate(zip(ends_at[:-1], ends_at[1:])):
                if a < b:
                    data, at = utf8(words.dictionary.take(pa.array(order[a:b])))
                    blobs.append(pack(np.diff(at), data, n[order[a:b]], every[order[a:b]]))
                    parts.append(p)
            ids = batch.column(batch.schema.get_field_index("id"))
            lists_of = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(parts), pa.int32()), ids)
            yield pa.record_batch([pa.array([made] * len(parts)), pa.array(parts), pa.array(blobs, pa.binary()), lists_of], names)
            made += 1

    def count(group: pa.Table) -> pa.Table:
        p = group.column("part")[0].as_py()
        blobs = [unpack(x) for x in group.column("blob").to_pylist()]
        coded = pa.concat_arrays([strings(x[0], x[1]) for x in blobs]).dictionary_encode()
        index = np.asarray(coded.indices)
        n, every = (np.bincount(index, np.concatenate([x[k] for x in blobs]), len(coded.dictionary)).astype(np.int64) for k in (2, 3))
        ids = np.empty(len(n), np.int64)
        ids[np.argsort(-n, kind="stable")] = 2 + p + lists * np.arange(len(n))
        ids[n < limit] = 0
        often = (every >= most) & (ids > 0)
        at = np.r_[0, np.cumsum([len(x[0]) for x in blobs])]
        out = [pack(ids[i], n[i]) for i in (index[a:b] for a, b in zip(at[:-1], at[1:]))]
        out.append(pack(np.array([n.sum(), (n > 0).sum(), (n == 1).sum(), every.sum()]), ids[often], every[often]))
        return pa.table({"chunk": pa.array([*group.column("chunk").to_pylist(), -1]), "part": pa.array([p] * len(out)), "blob": pa.array(out, pa.binary())})

    first = materialise(rows.mapInArrow(cut, schema))
    counts = materialise(first.where(F.col("part") >= 0).select("chunk", "part", "blob").groupBy("part").applyInArrow(count, "chunk long, part long, blob binary"))
    known = [unpack(r.blob) for r in counts.where("chunk < 0").select("blob").collect()]
    n_words, v, once, every = (int(sum(x[0][k] for x in known)) for k in range(4))
    n_all = n_words + ends
    root = Root(n_all, v + (ends > 0), (once + 0.5) / (n_all + 1), ends, limit)
    parts = 1 + (every + seen.rows) // bucket

    def number(group: pa.Table) -> pa.Table:
        """A chunk's tokens by their numbers, and its documents' root scores."""
        which = group.column("part").to_numpy()
        mine = int(np.flatnonzero(which == TEXT)[0])
        blobs = group.column("blob").to_pylist()
        tokens, per, held = unpack(blobs[mine])
        lengths, got = np.zeros(lists, np.int64), {}
        for p, blob in zip(which, blobs):
            if p >= 0:
                got[int(p)] = unpack(blob)
                lengths[p] = len(got[int(p)][0])
        ids, c = (np.concatenate([np.zeros(0, np.int64), *(got[p][k] for p in sorted(got))])[by_rank(lengths)] for k in (0, 1))
        doc = np.repeat(np.arange(len(per), dtype=np.int32), per)
        of = [f(np.r_[c, ends]) for f in (lambda n: (n > 0).astype(float), root.base, lambda n: np.log10(root.q(n)))]  # of words, then the end
        sums = [np.full(len(per), f[-1]) for f in of]
        for a in range(0, len(tokens), SHARE):
            here, some = doc[a : a + SHARE], tokens[a : a + SHARE]
            low = here[0]
            for f, to in zip(of, sums):
                part = np.bincount(here - low, f[some])
                to[low : low + len(part)] += part
        order = np.argsort(ids, kind="stable")[np.count_nonzero(ids == 0) :]
        place = np.zeros(len(ids), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        out = [pack(np.diff(ids[order], prepend=0), c[order], place[tokens], per, held.astype(np.uint8)), pack(per + 1, held.astype(np.uint8), sums[0].astype(np.int64), sums[1], sums[2])]
        ids = group.column("ids").slice(mine, 1).combine_chunks()
        return pa.table({"chunk": pa.array([group.column("chunk")[0].as_py()] * 2), "part": pa.array([TEXT, DOCS]), "blob": pa.array(out, pa.binary()), "ids": pa.concat_arrays([pa.nulls(1, ids.type), ids])})

    texts = first.where(F.col("part") == TEXT).unionByName(counts.where("chunk >= 0"), allowMissingColumns=True)
    numbered = materialise(texts.groupBy("chunk").applyInArrow(number, schema))
    discard(first, counts)
    chunks = numbered.where(F.col("part") == TEXT).select("blob", "chunk")

    often = sorted(zip(*(np.concatenate([x[k] for x in known]).tolist() for k in (1, 2)))) if known else []
    if ends >= limit and seen.rows >= most:
        often.insert(0, (END, seen.rows))
    heavy, edges = [], []
    more = Heavy(np.array([i for i, _ in often]), np.array([n for _, n in often])) if often else None
    while more is not None and len(heavy) < depth:
        heavy.append(more)
        below, more = heavy_level(chunks.select("blob"), root, heavy, edges[-1] if edges else None, parts, most)
        edges.append(below)

    def hashes(x: list[np.ndarray]) -> list[np.ndarray]:
        out = [np.zeros(len(x[0]), np.uint64)]
        for d, older in enumerate(x, 1):
            out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + older.astype(np.uint64) + np.uint64(d)))
        return out[1:]

    def apart(x: list[np.ndarray], by: list[np.ndarray]) -> np.ndarray:
        """A hash of the shortest context that is not heavy, with which all that it decides stays together; any where all are heavy."""
        out = by[0].copy()
        for d, place in enumerate(heavy_places(x, heavy), 1):
            here = np.flatnonzero(place >= 0)
            out[here] = np.where(x[d][here] > 0, by[d][here], mix(here.astype(np.uint64))) if d < depth else mix(here.astype(np.uint64))
        return out

    ranges: list[tuple[np.ndarray, np.ndarray]] = []  # of the heavy contexts: first bucket, buckets
    for d, level in enumerate(heavy):
        chain = [level.keys]
        for up in reversed(heavy[:d]):
            chain.append(up.keys[chain[-1] >> 32])
        ranges.append(((hashes([k & 0xFFFFFFFF for k in reversed(chain)])[-1] % np.uint64(parts)).astype(np.int64), np.minimum(parts, -(-level.n // most))))

    def send(batches):
        for batch in batches:
            for blob, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk, dealt = Chunk(blob, root, depth), []
                for at, used, ids in chunk.shares():
                    on = np.flatnonzero(used)
                    at, used, ids = at[on], used[on], [y[on] for y in ids]
                    by = hashes(ids)
                    to, own = (by[0] % np.uint64(parts)).astype(np.int64), apart(ids, by)
                    for d, place in enumerate(heavy_places(ids, heavy)):
                        here = np.flatnonzero(place >= 0)
                        start, wide = (r[place[here]] for r in ranges[d])
                        to[here] = (start + ((own[here] >> np.uint64(24)) % wide.astype(np.uint64)).astype(np.int64)) % parts
                    dealt.append((at.astype(np.int32), used.astype(chunk.back.dtype), to.astype(np.min_scalar_type(parts))))
                if not sum(len(y[0]) for y in dealt):
                    continue
                at, used, to = (np.concatenate(y) for y in zip(*dealt))
                order = np.argsort(to, kind="stable")
                at, used, to = at[order], used[order], to[order]
                cuts = np.searchsorted(to, np.arange(parts + 1))
                del dealt, order, to
                place, seen_here = np.zeros(len(chunk.ids), np.int64), np.zeros(len(chunk.ids), bool)
                blobs, filled = [], np.flatnonzero(np.diff(cuts))
                for p in filled:
                    i, u = at[cuts[p] : cuts[p + 1]], used[cuts[p] : cuts[p + 1]]
                    columns = [chunk.known(i), *(chunk.before(i, d, u) for d in range(1, depth + 1))]
                    seen_here[:] = False
                    for y in columns:
                        seen_here[y] = True
                    words = np.flatnonzero(seen_here)
                    place[words] = np.arange(len(words))
                    doc = chunk.doc[i]
                    blobs.append(pack(np.diff(chunk.ids[words], prepend=0), chunk.c[words], np.diff(doc, prepend=0), chunk.train[doc].astype(np.uint8), *(place[y] for y in columns)))
                yield pa.record_batch([pa.array(filled), pa.array([name] * len(blobs)), pa.array(blobs, pa.binary())], ["part", "chunk", "blob"])

    def grow(group: pa.Table) -> pa.Table:
        names = group.column("chunk").to_numpy()
        blobs = [x.as_buffer() for x in group.column("blob")]
        given = [unpack(x) for x, k in zip(blobs, names) if k == TABLE]
        tables = []
        for d in range(len(heavy)):
            mine = [x for x in given if x[0][0] == d]
            key, q = (np.concatenate(y) for y in zip(*((x[1] << 32 | x[2], x[3]) for x in mine))) if mine else (np.zeros(0, np.int64), np.zeros(0))
            order = np.argsort(key)
            tables.append((key[order], q[order]))
        del given
        names, blobs = names[names != TABLE], [x for x, k in zip(blobs, names) if k != TABLE]
        if not blobs:
            return pa.table({"chunk": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        ends_at = np.cumsum([packed_lengths(x)[3] for x in blobs]).tolist()
        size = ends_at[-1]
        shares = 1 + size // SHARE
        w, *x = columns = [np.empty(size, np.uint32) for _ in range(depth + 1)]
        c, slot, share = np.empty(size, np.min_scalar_type(n_all)), np.empty(size, np.uint32), np.empty(size, np.min_scalar_type(shares))
        docs, train, slots = [], [], [0]  # a slot for each document of a chunk
        for a, b, blob in zip([0, *ends_at], ends_at, blobs):
            gaps, count, steps, flag, *given = unpack(blob)
            ids = np.cumsum(gaps)
            for y, z in zip(columns, given):
                y[a:b] = ids[z]
            c[a:b] = count[given[0]]
            steps[0] += 1
            slot[a:b] = slots[-1] - 1 + np.cumsum(steps > 0)
            new = np.flatnonzero(steps)
            docs.append(steps[new])
            train.append(flag[new] > 0)
            slots.append(slots[-1] + len(new))
            for i in range(a, b, SHARE):
                older = [y[i : min(b, i + SHARE)].astype(np.int64) for y in x]
                share[i : i + SHARE][: len(older[0])] = (apart(older, hashes(older)) >> np.uint64(40)) % np.uint64(shares)
        train, sums = np.concatenate(train), np.zeros(slots[-1])
        for k in range(shares):
            at = np.flatnonzero(share == k).astype(np.int32)
            if len(at):
                np.add.at(sums, slot[at], subtree_scores(w[at], [y[at] for y in x], root.q(c[at]), train[slot[at]], limit, heavy, tables))
        out = []
        for steps, a, b in zip(docs, slots, slots[1:]):
            steps[0] -= 1
            out.append(pack(steps, sums[a:b]))
        return pa.table({"chunk": pa.array(names), "part": pa.array([group.column("part")[0].as_py()] * len(out)), "blob": pa.array(out, pa.binary())})

    sent = chunks.mapInArrow(send, "part long, chunk long, blob binary")
    where = targets(heavy, ranges, parts)
    for d, level in enumerate(edges):

        def deal(batches, d=d):
            to = np.concatenate(where[d])
            order = np.argsort(to, kind="stable")
            of = np.repeat(np.arange(len(where[d])), [len(x) for x in where[d]])[order]
            cuts = np.searchsorted(to[order], np.arange(parts + 1))
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    h, w, n, below = unpack(blob)
                    q = heavy[d].q(h, n, below)
                    for p in np.flatnonzero(np.diff(cuts)):
                        i = np.flatnonzero(np.isin(h, of[cuts[p] : cuts[p + 1]]))
                        if len(i):
                            yield pa.record_batch([pa.array([int(p)]), pa.array([TABLE]), pa.array([pack(np.full(len(i), d), h[i], w[i], q[i])], pa.binary())], ["part", "chunk", "blob"])

        sent = sent.unionByName(level.select("blob").mapInArrow(deal, "part long, chunk long, blob binary"))
    sums = sent.groupBy("part").applyInArrow(grow, "chunk long, part long, blob binary")

    def finish(group: pa.Table) -> pa.Table:
        which = group.column("part").to_numpy()
        mine = int(np.flatnonzero(which == DOCS)[0])
        blobs = [unpack(x) for x in group.column("blob").to_pylist()]
        tokens, held, n_known, base, score = blobs[mine]
        score = score.copy()
        for p, blob in sorted(((p, x) for p, x in zip(which.tolist(), blobs) if p >= 0), key=lambda x: x[0]):
            score[np.cumsum(blob[0])] += blob[1]
        ids = group.column("ids").slice(mine, 1).combine_chunks().flatten()
        return pa.table([ids, pa.array(held.astype(bool)), *(pa.array(x) for x in (tokens, n_known, np.full(len(tokens), n_all), base, score))], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    result = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    back = numbered.where(F.col("part") == DOCS).unionByName(sums, allowMissingColumns=True)
    return back.groupBy("chunk").applyInArrow(finish, result).withColumnRenamed("id", id_col)
