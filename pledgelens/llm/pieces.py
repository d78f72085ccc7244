"""SentencePiece encoding and decoding by vectorised merge rounds.

The vocabulary (pieces, scores, kinds) is read from a model file; the merging is done here. A text is cut before
every blank, since no piece of the vocabulary has a blank behind another character: one word is at most one blank
and the characters up to the next blank. The distinct words of a slice become one flat symbol array. In each round
the best pair rank of every word is found by a segmented minimum, its leftmost pairs are merged at once in all
words, and the arrays are compacted, until no pair remains. All occurrences of a pair merge together where no
piece that contains the new one ranks better; else only the leftmost, as the library does. In words of over 64
characters a round merges every pair that no better one can reach (the longest piece bounds the reach), so that rounds
do not grow with the word. Runs of blanks rank below every other merge and are cut into the longest pieces from the
left afterwards.

Edge cases: a null or empty text has the begin and end ids only and decodes to an empty text; characters without
a piece become byte pieces; U+2581 counts as a blank, as in the library; repeated rows give equal results.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pledgelens.llm.common import by_value, per_process, with_text_columns

by_value(__name__)

BLANK = "▁"
NONE = np.int64(2**40)


class Vocabulary:
    """Tables of one model file for the merge rounds: symbols, pair ranks, pieces' bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unk, self.size = sp.bos_id(), sp.eos_id(), sp.unk_id(), n
        normal = {names[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(BLANK in p.lstrip(BLANK) or (p.startswith(BLANK * 2) and p.strip(BLANK)) for p in normal):
            raise ValueError("pieces with a blank behind another character are not supported")
        self.byte_id = np.zeros(256, np.int32)
        self.piece_bytes: list[bytes] = []
        for i in range(n):
            if sp.is_byte(i):
                b = int(names[i][3:5], 16)
                self.byte_id[b] = i
                self.piece_bytes.append(bytes([b]))
            elif sp.is_control(i):
                self.piece_bytes.append(b"")
            else:
                self.piece_bytes.append((" ⁇ " if sp.is_unknown(i) else names[i].replace(BLANK, " ")).encode())
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.is_control = np.array([sp.is_control(i) for i in range(n)])
        self.blank_first = np.array([p.startswith(BLANK) for p in names])
        # symbols: pieces keep their ids; characters that only occur inside pieces get ids from n on
        symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            symbol[c] = n + len(symbol) - len(normal)
        self.n_symbols = n + len(symbol) - len(normal)
        self.inner = {v: k.encode() for k, v in symbol.items() if v >= n}
        code = [(ord(c), i) for c, i in symbol.items() if len(c) == 1]
        self.char = np.full(0x110000, -1, np.int32)
        self.char[[c for c, _ in code]] = [i for _, i in code]
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        rank = {p: order[sp.get_score(i)] for p, i in normal.items()}
        inside: dict[str, int] = {}  # the best rank of any longer piece that contains a piece
        for p in normal:
            for a in range(len(p)):
                for b in range(a + 1, len(p) + 1):
                    if b - a < len(p) and (q := p[a:b]) in normal:
                        inside[q] = min(inside.get(q, rank[p]), rank[p])
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in normal.items():
            if len(p) > 1 and not p.startswith(BLANK * 2):
                for k in range(1, len(p)):
                    if p[:k] in symbol and p[k:] in symbol:
                        pairs[symbol[p[:k]] * self.n_symbols + symbol[p[k:]]] = rank[p], i
        self.safe = np.zeros(self.n_symbols, bool)
        for p, i in normal.items():
            self.safe[i] = inside.get(p, rank[p] + 1) > rank[p]
        ranks = [rank[p] for p in normal if len(p) > 1 and not p.startswith(BLANK * 2)]
        if len(set(ranks)) < len(ranks):
            raise ValueError("pieces of equal scores are not supported")
        self.rank_bits = len(order).bit_length()
        self.reach = max((len(p) for p in normal if not p.startswith(BLANK * 2)), default=1)
        # an open-addressed table of the pairs: slot = (key * odd) >> shift, at most `probes` steps
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.value = np.full(((1 << self.bits) + 64, 2), NONE, np.int64)
        self.probes = 1
        slots = self.slot(np.fromiter(pairs, np.int64, len(pairs)))
        for s, (key, got) in zip(slots.tolist(), pairs.items()):
            at = s
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.value[at] = key, got
            self.probes = max(self.probes, at - s + 1)
        self.blank = symbol.get(BLANK, -1)
        runs = {len(p): i for p, i in normal.items() if not p.strip(BLANK)}
        # a run of blanks: as many of the longest piece as fit, then the pieces of the rest
        self.longest = max(runs)
        rest = [cut_run(k, runs) for k in range(self.longest + 1)]
        if rest[-1] != [self.longest]:
            raise ValueError("the pieces of blanks are not supported")
        self.rest = np.array([runs[x] for r in rest[:-1] for x in r], np.int32)
        self.rest_size = np.array([len(r) for r in rest[:-1]])
        self.rest_first = np.cumsum(self.rest_size) - self.rest_size
        self.longest_id = runs[self.longest]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Table position of each pair, or -1."""
        known = (left >= 0) & (right >= 0)
        key = np.where(known, left.astype(np.int64) * self.n_symbols + right, -2)
        at = self.slot(key)
        found = np.where(self.keys[at] == key, at, -1)
        todo = np.flatnonzero((found < 0) & known & (self.keys[at] >= 0))
        for step in range(1, self.probes):
            if not len(todo):
                break
            there = at[todo] + step
            hit = self.keys[there] == key[todo]
            found[todo[hit]] = there[hit]
            todo = todo[~hit & (self.keys[there] >= 0)]
        return found


def cut_run(n: int, runs: dict[int, int]) -> list[int]:
    """Sizes of the pieces of n blanks: equal ranks, so always the leftmost pair that makes a piece."""
    parts = [1] * n
    while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in runs), None)) is not None:
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def vocabulary(path: str) -> Vocabulary:
    return per_process(("vocabulary", path), lambda: Vocabulary(path))


def merge_words(v: Vocabulary, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the symbols of all words to the end. Returns symbols, their words, and the place each began at."""
    place = np.arange(len(symbol))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(symbol):
        at = v.look_up(symbol[:-1], symbol[1:])
        at[word[1:] != word[:-1]] = -1
        rank = np.full(len(symbol), NONE)
        rank[:-1] = np.where(at >= 0, v.value[at, 0], NONE)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(word)])
        best = np.minimum.reduceat(rank, first)
        live = np.repeat(best < NONE, size)
        if not live.all():
            done.append((symbol[~live], word[~live], place[~live]))
            if not live.any():
                break
            chosen = np.repeat(best, size)[live]
            rank, symbol, word, place, at = rank[live], symbol[live], word[live], place[live], np.append(at, -1)[live]
        else:
            chosen, at = np.repeat(best, size), np.append(at, -1)
        hit = np.flatnonzero(rank == chosen)
        # of overlapping pairs the leftmost, then every second one
        fresh = np.r_[True, np.diff(hit) > 1]
        order = np.arange(len(hit))
        start = np.maximum.accumulate(np.where(fresh, order, 0))
        hit = hit[(order - start) % 2 == 0]
        new = v.value[at[hit], 1]
        leftmost = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
        keep = leftmost | v.safe[new]
        hit, new = hit[keep], new[keep]
        symbol[hit] = new
        stay = np.ones(len(symbol), bool)
        stay[hit + 1] = False
        symbol, word, place = symbol[stay], word[stay], place[stay]
    if not done:
        return symbol, word, place
    symbol, word, place = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(place)
    return symbol[order], word[order], place[order]


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from each place on; places behind the end do not count."""
    out, have = np.r_[values, np.full(width, np.iinfo(np.int64).max)], 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out[: len(values)]


def merge_long_words(v: Vocabulary, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As merge_words, with rounds that do not grow with the words.

    A pair's turn is the worst rank met until it merges: its own, or the turn of the merge that made one of its symbols.
    A pair merges as soon as none whose turn is before its own lies within the longest piece to either side, since only
    a piece that reaches from there could take one of its symbols. Turns of pieces that are not `safe` are told apart by
    place, so what such a merge leads to comes before the next one; a run of equal pairs is paired off from its left end.
    """
    never = np.iinfo(np.int64).max
    at_bits = 62 - 2 * v.rank_bits
    if len(symbol) >= 1 << at_bits:
        raise ValueError(f"a text has more than {1 << at_bits} characters")
    place = np.arange(len(symbol))
    made = np.zeros(len(symbol), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for turns in itertools.count():
        at = v.look_up(symbol[:-1], symbol[1:])
        at[word[1:] != word[:-1]] = -1
        live = at >= 0
        if not live.any():
            done.append((symbol, word, place))
            break
        if turns % 8 == 7:  # words without a pair leave
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            goes = np.repeat(np.logical_or.reduceat(np.append(live, False), first), np.diff(np.r_[first, len(word)]))
            if 2 * np.count_nonzero(goes) < len(goes):
                done.append((symbol[~goes], word[~goes], place[~goes]))
                symbol, word, place, made = symbol[goes], word[goes], place[goes], made[goes]
                continue
        rank, new = v.value[at, 0], v.value[at, 1]
        turn = (rank << at_bits) + np.where(live & ~v.safe[np.where(live, new, 0)], place[:-1] + 1, 0)
        turn = np.maximum(turn, np.maximum(made[:-1], made[1:]))
        order = np.where(live, (turn << v.rank_bits) + rank, never)
        least = least_of(np.r_[np.full(v.reach, never), order], v.reach)
        run = np.r_[True, order[1:] != order[:-1]]
        index = np.arange(len(order))
        start = np.maximum.accumulate(np.where(run, index, 0))
        hit = live & (order <= least[: len(order)])[start] & (order <= np.r_[least[v.reach + 1 :], never]) & ((index - start) % 2 == 0)
        hit = np.flatnonzero(hit)
        symbol[hit], made[hit] = new[hit], turn[hit]
        stay = np.ones(len(symbol), bool)
        stay[hit + 1] = False
        symbol, word, place, made = symbol[stay], word[stay], place[stay], made[stay]
    symbol, word, place = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(place)
    return symbol[order], word[order], place[order]


LONG = 64


def merge_all(v: Vocabulary, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """merge_words for words of up to LONG characters, merge_long_words for the others; results in the order of the words."""
    long = np.bincount(word, minlength=1)[word] > LONG
    if not long.any():
        return merge_words(v, symbol, word)
    parts = []
    for at, merge in ((np.flatnonzero(~long), merge_words), (np.flatnonzero(long), merge_long_words)):
        s, w, place = merge(v, symbol[at], word[at])
        parts.append((s, w, at[place]))
    symbol, word, place = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(place)
    return symbol[order], word[order], place[order]


def spread(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each entry, one after another."""
    total = int(size.sum())
    begin = np.cumsum(size) - size
    return values[np.arange(total) - np.repeat(begin, size) + np.repeat(start, size)]


def encode_slice(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the texts of a slice, and offsets of the rows in them."""
    rows = len(offsets) - 1
    # U+2581 becomes a blank, and a blank goes before each text that is not empty
    text = data.tobytes()
    if b"\xe2\x96\x81" in text:
        parts = [text[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets[:-1], offsets[1:])]
        data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(x) for x in parts])]
    length = np.diff(offsets)
    some = length > 0
    buffer = np.insert(data, offsets[:-1][some], 32)
    begin = offsets[:-1] + np.cumsum(some) - some
    # every blank opens a word; of a run of blanks all but the last are words of their own
    is_blank = buffer == 32
    opens = is_blank.copy()
    opens[begin[some]] = True
    start = np.flatnonzero(opens)
    end = np.r_[start[1:], len(buffer)]
    row = np.searchsorted(begin[some], start, "right") - 1
    row = np.flatnonzero(some)[row] if len(start) else row
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[start, len(buffer)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buffer))])
    coded = words.dictionary_encode()
    code = np.asarray(coded.indices)
    ids, first, size, lead = encode_words(v, coded.dictionary)
    # runs of blanks: lone blanks, and the blank of a word whose first symbol stayed a blank
    lone = size[code] == 0
    split = lead[code] & ~lone
    counts = (lone | split).astype(np.int64)
    total = np.cumsum(counts)
    ends_run = ~lone[:-1] | (row[1:] != row[:-1])
    opens_run = np.r_[[True] * min(1, len(code)), ends_run][: len(code)].astype(bool)
    base = np.maximum.accumulate(np.where(opens_run, np.arange(len(code)), 0))
    blanks = np.where(np.r_[ends_run, [True] * min(1, len(code))].astype(bool), total - total[base] + counts[base], 0)
    chunks = blanks // v.longest + v.rest_size[blanks % v.longest]
    body = size[code] - split
    per_word = chunks + np.where(lone, 0, body)
    out_at = np.cumsum(per_word) - per_word
    ids_out = np.empty(int(per_word.sum()), np.int32)
    has = np.flatnonzero(blanks > 0)
    if len(has):
        whole, rest = blanks[has] // v.longest, blanks[has] % v.longest
        at = np.arange(len(ids_out))
        ids_out[spread(at, out_at[has], whole)] = v.longest_id
        ids_out[spread(at, out_at[has] + whole, v.rest_size[rest])] = spread(v.rest, v.rest_first[rest], v.rest_size[rest])
    full = np.flatnonzero(~lone & (body > 0))
    if len(full):
        ids_out[spread(np.arange(len(ids_out)), out_at[full] + chunks[full], body[full])] = spread(ids, first[code[full]] + split[full], body[full])
    tokens = np.bincount(row, per_word, rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
    ends = np.cumsum(tokens + 2)
    out = np.empty(int(ends[-1]) if rows else 0, np.int32)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = inner[ends - tokens - 2] = False
    out[inner] = ids_out
    out[ends - 1], out[ends - tokens - 2] = v.eos, v.bos
    return out, np.r_[0, ends]


def encode_words(v: Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct words (a blank and other characters): flat ids, first and size of each word, and whether its first id is a lone blank. A word that is only a blank has size 0."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and words.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
    point = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # first bytes of the characters
    word = np.searchsorted(offsets, lead, "right") - 1
    symbol = v.char[np.where(point == 32, ord(BLANK), point)].astype(np.int64)
    size = np.bincount(word, minlength=n)
    lone = size == 1
    lone &= raw[np.minimum(offsets[:-1], max(len(raw) - 1, 0))] == 32 if n else False
    use = ~lone[word]
    keep = np.flatnonzero(use)
    symbol, owner, place = merge_all(v, symbol[use], word[use])
    char = keep[place]
    # symbols without a piece of their own become their bytes
    bare = np.flatnonzero((symbol < 0) | (symbol >= v.size))
    width = np.ones(len(symbol), np.int64)
    char_end = np.r_[lead[1:], len(raw)]
    width[bare] = (char_end - lead)[char[bare]]
    ids = np.repeat(np.where((symbol >= 0) & (symbol < v.size), symbol, 0), width).astype(np.int32)
    if len(bare):
        to = np.cumsum(width) - width
        ids[spread(np.arange(len(ids)), to[bare], width[bare])] = v.byte_id[spread(raw, lead[char[bare]], width[bare])]
    per = np.bincount(np.repeat(owner, width), minlength=n) if len(owner) else np.zeros(n, np.int64)
    first = np.cumsum(per) - per
    opens = np.zeros(n, bool)
    full = per > 0
    opens[full] = ids[first[full]] == v.blank
    return ids, first, per, opens


def decode_slice(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Texts of the rows: pieces' bytes in a row, without the blank that stands before a text."""
    table = np.frombuffer(b"".join(v.piece_bytes), np.uint8)
    size = np.array([len(x) for x in v.piece_bytes], np.int64)
    first = np.cumsum(size) - size
    width = size[ids]
    flat = spread(table, first[ids], width)
    at = np.r_[0, np.cumsum(width)][offsets]
    shown = np.flatnonzero(~v.is_control[ids])
    head = np.searchsorted(shown, offsets[:-1])
    has = head < np.searchsorted(shown, offsets[1:])
    skip = np.zeros(len(offsets) - 1, np.int64)
    lead = shown[head[has]]
    skip[has] = v.blank_first[ids[lead]]
    whole = flat.tobytes()
    out = []
    for a, b in zip((at[:-1] + skip).tolist(), at[1:].tolist()):
        x = whole[a:b]
        try:
            x.decode()
        except UnicodeDecodeError:
            x = x.decode("utf-8", "replace").encode()
        out.append(x)
    return out


def encode_pieces(docs: DataFrame, model_path: str, *, text_col: str = "text") -> DataFrame:
    """Add ids (array of int, with begin and end ids); a column of that name is replaced."""

    def kernel(data, offsets):
        ids, at = encode_slice(vocabulary(model_path), data, offsets)
        return [pa.LargeListArray.from_arrays(pa.array(at), pa.array(ids)).cast(pa.list_(pa.int32()))]

    return with_text_columns(docs, text_col, "ids array<int>", kernel)


def piece_digests(docs: DataFrame, model_path: str, *, text_col: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 of the encoded and again decoded text; columns of these names are replaced."""
    from hashlib import sha256

    def kernel(data, offsets):
        v = vocabulary(model_path)
        ids, at = encode_slice(v, data, offsets)
        raw = memoryview(ids.astype("<u4")).cast("B")
        return [np.diff(at), [sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:])], [sha256(x).hexdigest() for x in decode_slice(v, ids, at)]]

    return with_text_columns(docs, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", kernel)


def encode_and_decode(docs: DataFrame, model_path: str, *, text_col: str = "text") -> DataFrame:
    """Add ids (array of int) and decoded_sha256, the SHA-256 of the text they decode to; columns of these names are replaced."""
    from hashlib import sha256

    def kernel(data, offsets):
        v = vocabulary(model_path)
        ids, at = encode_slice(v, data, offsets)
        return [pa.LargeListArray.from_arrays(pa.array(at), pa.array(ids)).cast(pa.list_(pa.int32())), [sha256(x).hexdigest() for x in decode_slice(v, ids, at)]]

    return with_text_columns(docs, text_col, "ids array<int>, decoded_sha256 string", kernel)


def decode_pieces(rows: DataFrame, model_path: str, *, ids_col: str = "ids") -> DataFrame:
    """Add decoded (string) from an array of ids; a null array decodes to an empty text, ids outside the vocabulary to nothing."""
    from pyspark.sql import types as T

    kept = rows.drop("decoded")

    def run(batches):
        v = vocabulary(model_path)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            clean = [[i for i in x or () if i is not None and 0 <= i < v.size] for x in lists]
            flat = np.fromiter((i for x in clean for i in x), np.int64)
            text = decode_slice(v, flat, np.r_[0, np.cumsum([len(x) for x in clean])].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.decode() for x in text], pa.string())], [*b.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("decoded", T.StringType())]))
