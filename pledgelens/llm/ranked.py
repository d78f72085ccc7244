"""Ranked lexical search by the Best Position Algorithm.

Terms are the maximal runs of letters, digits and non-ASCII characters, only A-Z lower-cased. Items are searched in blocks
of about `item_terms` terms; a block's terms are known to every task, so the documents need no shuffle:
1. one scan of the documents writes a forward table: for each document its number of terms and the block's terms in it;
2. the document frequencies, the number of documents and their length come from that table and give each term's weight;
3. tasks turn shards of the table into impact lists (one for each term, falling impact) and search them for each item.
The search reads the lists of an item side by side. A document met in one list is looked up in all others by direct
access, which gives its whole score and its place in each list. A list's best position is the end of its leading run of
seen places, whether they were read or looked up; a document not seen yet lies behind it in every list, so its score is at
most the sum of the impacts there. The search stops when this sum is strictly below the k-th best score, so that equal scores
with smaller ids are never missed. A block's items are first searched among about `sample` documents; the k-th best score there
is a floor that no result can be under, and shards stop below it too. A window keeps the k best of all shards.

Scores are integers, with sums and quotients as `weigh` and `impacts` have them.

Edge cases: null texts are empty; documents and items without terms take no part; every row is a document of its own,
also where ids are null (last among equals) or repeated; rows of one item id (null is one) are one item with all of their
terms, once each; fewer than k documents with a score above 0 give fewer rows; columns besides id and text don't matter;
empty tables give an empty table. An item's terms must fit in one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pledgelens.llm.common import by_value, clean_text, materialise, slices

by_value(__name__)

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
PIECE = 1 << 20
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
FIRST_DEPTH = 32


def term_counts(text: bytes) -> Counter:
    """How often each term occurs; long texts go through in pieces that end between terms."""
    text, counts, at = text.lower(), Counter(), 0
    while at < len(text):
        cut = BETWEEN.search(text, at + PIECE)
        to = cut.start() if cut else len(text)
        counts.update(TERM.findall(text, at, to))
        at = to
    return counts


def weigh(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N+2) / (2df+1))) for each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """A term's part of a document's score; `length` is the document's number of terms, `total` all documents'."""
    if len(length) and 90 * int(length.max()) * n_docs >= 2**63:
        raise ValueError("a document is too long for 64-bit scores")
    norm = 10 + (90 * length * n_docs) // max(1, total)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm))


class Shard:
    """Impact lists of some documents: for each term its documents by id, with impacts and places, and by falling impact."""

    def __init__(self, terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        by_term = np.argsort(term, kind="stable")  # postings come document by document
        self.doc, self.impact, sorted_terms = doc[by_term], impact[by_term], term[by_term]
        self.start = np.searchsorted(sorted_terms, np.arange(terms + 1))
        falling = np.lexsort((-self.impact, sorted_terms))
        self.place = np.empty(len(doc), np.int64)
        self.place[falling] = np.arange(len(doc))
        self.place -= self.start[sorted_terms]
        self.read_doc, self.read_impact = self.doc[falling], self.impact[falling]


def best_positions(shard: Shard, terms: np.ndarray, n_docs: int, ids: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents of a shard for an item that reach `floor`: (document, score); and how many were looked up."""
    lists = [(a, b) for a, b in zip(shard.start[terms], shard.start[terms + 1]) if b > a]
    seen = [np.zeros(b - a + 1, bool) for a, b in lists]  # the place behind the end is never seen
    best = [0] * len(lists)
    met = np.zeros(n_docs, bool)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, to, looked = 0, FIRST_DEPTH, 0
    floor = max(floor, 1)
    while True:
        read = [shard.read_doc[a + depth : min(a + to, b)] for a, b in lists]
        fresh = np.unique(np.concatenate(read)) if read else np.zeros(0, np.int64)
        fresh = fresh[~met[fresh]]
        met[fresh] = True
        looked += len(fresh)
        score = np.zeros(len(fresh), np.int64)
        for i, (a, b) in enumerate(lists):
            at = np.searchsorted(shard.doc[a:b], fresh)
            hit = np.flatnonzero(at < b - a)
            hit = hit[shard.doc[a + at[hit]] == fresh[hit]]
            at = a + at[hit]
            score[hit] += shard.impact[at]
            seen[i][shard.place[at]] = True
        good = score >= floor
        docs, scores = np.concatenate([docs, fresh[good]]), np.concatenate([scores, score[good]])
        if len(docs) > k:
            keep = np.lexsort((ids[docs], -scores))[:k]
            docs, scores = docs[keep], scores[keep]
        kth = int(scores[-1]) if len(docs) == k else floor
        bound = 0
        for i, (a, b) in enumerate(lists):
            best[i] += int(np.argmin(seen[i][best[i] :]))
            if a + best[i] < b:
                bound += int(shard.read_impact[a + best[i]])
        if bound < max(kth, floor):
            return docs, scores, looked
        depth, to = to, 2 * to


def forward_rows(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of each document that has a term; terms are the numbers of those in the vocabulary."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("n long, terms array<int>, tfs array<long>")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            kept, lengths, terms, tfs = [], [], [], []
            for row in range(rows.num_rows):
                counts = term_counts(data[offsets[row] : offsets[row + 1]].tobytes())
                if not counts:
                    continue
                held = sorted((vocabulary[t], counts[t]) for t in counts.keys() & vocabulary.keys())
                kept.append(row)
                lengths.append(counts.total())
                terms.append([t for t, _ in held])
                tfs.append([c for _, c in held])
            ids = rows.column(0).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, f.type) for x, f in zip((lengths, terms, tfs), list(arrow)[1:]))], schema=arrow)

    return docs.mapInArrow(run, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, lengths, and postings (document number, term, frequency) of up to SHARD_DOCS documents and about SHARD_POSTINGS postings."""

    def whole(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        terms, tfs = t.column("terms").combine_chunks(), t.column("tfs").combine_chunks()
        doc = np.repeat(np.arange(len(t)), terms.value_lengths().to_numpy(zero_copy_only=False))
        return t.column("id").combine_chunks(), t.column("n").to_numpy(), doc, terms.flatten().to_numpy(), tfs.flatten().to_numpy()

    parts, docs, postings = [], 0, 0
    for batch in batches:
        lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            done = lengths[at - 1] if at else 0
            fits = int(np.searchsorted(lengths, done + SHARD_POSTINGS - postings, "right"))
            to = min(batch.num_rows, at + SHARD_DOCS - docs, max(fits, at + (not parts)))
            if to > at:
                parts.append(batch.slice(at, to - at))
                docs, postings, at = docs + to - at, postings + int(lengths[to - 1] - done), to
            if docs == SHARD_DOCS or at < batch.num_rows:
                yield whole(parts)
                parts, docs, postings = [], 0, 0
    if parts:
        yield whole(parts)


def _searched(forward: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, total: int, floors: np.ndarray, k: int) -> DataFrame:
    """(item, id, score): each shard's best documents of each item, numbered as in `items`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("item", T.IntegerType()), forward.schema["id"], T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for ids, lengths, doc, term, tf in _shards(batches):
            shard = Shard(len(weights), doc, term, impacts(weights[term], tf, lengths[doc], n_docs, total))
            order = np.empty(len(ids), np.int64)  # ties go by id, nulls last
            order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            found = [best_positions(shard, t, len(ids), order, k, int(floors[i]))[:2] for i, t in enumerate(items)]
            item = np.repeat(np.arange(len(items)), [len(d) for d, _ in found])
            docs, scores = (np.concatenate([np.zeros(0, np.int64), *(f[x] for f in found)]) for x in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(docs)), pa.array(scores)], schema=arrow)

    return forward.mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_terms_table(items: DataFrame) -> DataFrame:
    """(item, term): each item's terms, once each."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([items.schema["item"], T.StructField("term", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            for row in range(rows.num_rows):
                terms = list(term_counts(data[offsets[row] : offsets[row + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array([row] * len(terms), pa.int64())), pa.array(terms, pa.binary())], schema=arrow)

    return items.mapInArrow(run, schema).distinct()


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_terms: int = 1 << 18, sample: int = 16_384) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents.

    item_terms: about how many item-term pairs are searched in one block of items; each block scans the documents once.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("id"), clean_text(text).alias("text"))
    asked = materialise(item_terms_table(items.select(F.col(item_id).alias("item"), clean_text(text).alias("text"))))
    blocks = -(-asked.count() // item_terms)
    schema = T.StructType([T.StructField(n, f) for n, f in ((item_id, items.schema[item_id].dataType), ("rank", T.IntegerType()), (doc_id, docs.schema[doc_id].dataType), ("score", T.LongType()))])
    done = spark.createDataFrame([], schema)
    for block in range(blocks):
        pairs = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        if not pairs:
            continue
        keys = list(dict.fromkeys(p["item"] for p in pairs))
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(bytes(p["term"]) for p in pairs))}
        number, terms = {key: i for i, key in enumerate(keys)}, [[] for _ in keys]
        for p in pairs:
            terms[number[p["item"]]].append(vocabulary[bytes(p["term"])])
        terms = [np.sort(np.array(t, np.int64)) for t in terms]
        forward = materialise(forward_rows(texts, vocabulary))
        n_docs, total = forward.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
            df[r["term"]] = r["n"]
        weights, floors = weigh(n_docs, df), np.zeros(len(keys), np.int64)
        if n_docs > 2 * sample:
            some = forward.where(F.pmod(F.xxhash64("id", "n", "terms"), F.lit(n_docs)) < sample)
            kth = _best(_searched(some, terms, weights, n_docs, total, floors, k), k).where(F.col("rank") == k)
            for r in kth.collect():
                floors[r["item"]] = r["score"]
        best = _best(_searched(forward, terms, weights, n_docs, total, floors, k), k)
        names = spark.createDataFrame(list(enumerate(keys)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("key", schema[0].dataType)]))
        part = best.join(names, "item").select(F.col("key").alias(item_id), F.col("rank"), F.col("id").alias(doc_id), "score")
        done = part if blocks == 1 else done.unionByName(part)
    return done
