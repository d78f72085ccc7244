"""Whitening against a full eigensolver, ranked search against scoring everything, WARC archives against their pages."""

import base64
import hashlib
import math
import random
import re
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pledgelens.llm import registry, warc
from pledgelens.llm.ranked import Shard, best_positions, ranked_search, term_counts
from pledgelens.llm.whitening import fit_whitening, leading, whiten

# --- whitening


def full_solution(vectors, scale=256):
    x = np.unique(np.floor(scale * np.array(vectors, float)), axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    return x, values[::-1], axes[:, ::-1]


def test_whitening_query_equals_full_eigensolver(spark, sf):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    x, values, axes = full_solution(list(rows.values()))
    mean = x.mean(axis=0)
    got = {(r.vec_id, r.component): r for r in registry.op11_whitening(spark, sf).collect()}
    assert set(got) == {(i, c) for i in rows for c in range(1, 5)}
    sign = {}
    for (i, c), r in got.items():
        own = np.floor(256 * np.array(rows[i], float))
        want = (own - mean) @ axes[:, c - 1] / math.sqrt(values[c - 1])
        sign.setdefault(c, 1 if want * r.whitened > 0 else -1)
        assert r.whitened == pytest.approx(sign[c] * want, abs=1e-8)
        assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-10) and r.identity_error < 1e-10
        n, total = len(x), x.sum(axis=0)
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, total))


def test_whitening_odd_rows(spark):
    rng = random.Random(3)
    good = [[rng.gauss(0, 1) * s for s in (5.0, 2.0, 1.0)] for _ in range(40)]
    rows = [(i, v, "kept") for i, v in enumerate(good)] + [(None, good[0], "null id"), (7, good[7], "again"), (90, None, "x"), (91, [], "x"), (92, [1.0, None, 2.0], "x"), (93, [1.0, float("nan"), 2.0], "x"), (94, [1.0, float("inf"), 2.0], "x"), (95, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(5)
    model = fit_whitening(df)
    x, values, _ = full_solution(good)
    assert model.n == len(x) and model.dim == 3 and model.values == pytest.approx(values, rel=1e-12)
    done = whiten(df.withColumnRenamed("whitened", "x"), model)
    assert done.columns == ["vec_id", "embedding", "x", "whitened"] and done.where("x = 'x'").count() == 0
    out = {(r.vec_id, r.x): r.whitened for r in done.collect()}
    assert len(out) == 42 and out[(None, "null id")] == out[(0, "kept")] and out[(7, "again")] == out[(7, "kept")]
    white = np.array([out[(i, "kept")] for i in range(40)])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(3)).max() < 1e-10
    one = spark.createDataFrame([(1, [0.5, 0.25])] * 3, "vec_id long, embedding array<double>")
    alone = fit_whitening(one)
    assert alone.n == 1 and len(alone.values) == 0 and {tuple(r.whitened) for r in whiten(one, alone).collect()} == {()}
    assert fit_whitening(df.limit(0)) is None and whiten(df.limit(0), None).count() == 0


def test_leading_components_of_hard_spectra():
    rng = np.random.default_rng(5)
    for values in (np.linspace(2, 1, 60), np.array([3.0] * 3 + [1.0] * 47), 0.5 ** np.arange(40), 1 + 1e-3 * rng.random(64), np.array([2.0] + [1.0] * 60 + [0.0] * 3)):
        axes = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        v = (axes * values) @ axes.T
        for trace in (0.0, values.sum()):
            got, vectors, residual = leading(lambda q: v @ q, len(values), 4, trace=trace)
            assert np.abs(v @ vectors - vectors * got).max() < 1e-11
        assert got == pytest.approx(np.sort(values)[::-1][:4], rel=1e-11) and residual <= 1e-12


# --- ranked search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_ranking(docs, items, k=10):
    counts = [(i, Counter(WORD.findall(lowered(t)))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(WORD.findall(lowered(t)))
    for item, terms in asked.items():
        df = {t: sum(t in c for _, c, _ in counts) for t in terms}
        found = []
        for i, c, n in counts:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_ranking_equals_scoring_everything(spark):
    rng = random.Random(9)
    words = ["w%d" % min(int(rng.paretovariate(0.7)), 300) for _ in range(6000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(i, t) for i, t in docs[:60]] + [(900 + i, docs[5][1]) for i in range(30)]  # repeated rows and ties
    docs += [(None, "w1 w2 w3"), (1000, None), (1001, ""), (1002, "..!"), (1003, "Ünï-CODE É w1"), (1004, "long " * 70000 + "rare")]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(25)] + [(3, "w1 rare"), (None, "w2 CODE ÜNÏ Ünï"), (70, None), (71, "nowhere"), (72, "?")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(7)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = plain_ranking(docs, items)
    for settings in ({}, {"item_terms": 60}, {"sample": 20}):
        got = ranked_search(d, q, **settings)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert ranked_search(d.limit(0), q).count() == 0 and ranked_search(d, q.limit(0)).count() == 0


def test_search_stops_early():
    """Two documents hold a rare term: the bound falls below them long before the common term's list ends."""
    n = 4000
    doc, term = np.concatenate([np.arange(n), [10, 700]]), np.concatenate([np.zeros(n, int), [1, 1]])
    order = np.lexsort((term, doc))
    impact = np.concatenate([np.arange(n) % 97 + 1, [100_000, 100_000]])
    shard = Shard(2, doc[order], term[order], impact[order])
    docs, scores, looked = best_positions(shard, np.array([0, 1]), n, np.arange(n), 2, 0)
    assert sorted(docs) == [10, 700] and looked < 100
    everything = np.bincount(doc, impact, n).astype(int)
    docs, scores, looked = best_positions(shard, np.array([0, 1]), n, np.arange(n), 50, 0)
    assert list(zip(-scores, docs)) == sorted(zip(-everything, range(n)))[:50]


def test_terms_in_pieces():
    text = ("Ab1 é-x" * 400_000).encode()
    assert term_counts(text) == Counter(re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()))


# --- WARC

FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"
HUGE = "WARC/1.1\r\nContent-Length: 99999999999999999999999999\r\n\r\n"


def base32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture()
def pages():
    rng = random.Random(4)
    said = [(i, f"http://h/{i}", "<p>" + "".join(rng.choices("abc é\n", k=rng.randint(0, 300))) + "</p>") for i in range(60)]
    said += [(100, "http://h/\r\nx", FAKE), (101, None, FAKE * 10), (102, "u", "WARC/1.1"), (103, "u", "x WARC/1.1\r"), (104, "u", HUGE + FAKE), (105, "u", "WARC/1.1\r\n" * 120)]
    said += [(106, "u", None), (107, "u", ""), (None, "u", "for a null id"), (None, "u", ""), (50, "v", said[50][2]), (200, "v", said[50][2]), (201, "v", FAKE), (202, "u", "y" * 1500)]
    return said


@pytest.mark.parametrize("split", [211, 1 << 20])
def test_archives_give_the_pages_back(spark, pages, split):
    df = spark.createDataFrame([(*p, "more") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in pages:
        again = (html or "") in first and first[html or ""] != i
        want.append((i, len((html or "").encode()), base32(html), "revisit" if again else "response", first[html or ""] if again else None, True))
    at = tempfile.mkdtemp(dir="/tmp") + "/archive"
    warc.write_warc(df, at)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)  # so that records and even magic lines cross splits
    try:
        read = warc.read_warc(spark, at)
        assert sorted(map(tuple, warc.page_records(read).collect()), key=str) == sorted(want, key=str)
        bodies = {r.record_id: bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bodies["<urn:page:101>"] == FAKE * 10 and "<urn:page:666>" not in bodies


def test_archives_compressed_small_and_empty(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    home = tempfile.mkdtemp(dir="/tmp")
    warc.write_warc(df, f"{home}/gz", compression="gzip", least_bytes=100)
    got = warc.page_records(warc.read_warc(spark, f"{home}/gz", payloads=False))
    small = got.where("payload_bytes < 100")
    assert got.count() == len(pages) and small.where("record_type = 'revisit'").count() == 0 and got.where("record_type = 'revisit'").count() == 2
    warc.write_warc(df.limit(0), f"{home}/none")
    assert warc.page_records(warc.read_warc(spark, f"{home}/none")).count() == 0


def test_damaged_archive(spark, pages):
    home = tempfile.mkdtemp(dir="/tmp")
    df = spark.createDataFrame(pages[:20], "page_id long, url string, html string").repartition(1)
    warc.write_warc(df, f"{home}/a")
    spark.read.text(f"{home}/a", wholetext=True).select(F.substring("value", 1, 3000)).write.mode("append").text(f"{home}/a")
    with pytest.raises(ValueError, match="end before"):
        warc.read_warc(spark, f"{home}/a")
    assert warc.read_warc(spark, f"{home}/a", damaged="skip").count() == 20
