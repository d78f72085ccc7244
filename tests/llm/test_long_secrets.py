"""Secrets in texts that repeat each part of each rule very often."""

import re
import time

import pytest
from pyspark.sql import functions as F

from pledgelens.llm.oracles import SECRETS
from pledgelens.llm.secrets import find_secrets, redact

HEAD, LINE = "-----BEGIN RSA PRIVATE KEY-----", "Ab0/" * 16
PIECES = ["token = '", HEAD + "\n", "-----BEGIN A", "-a", LINE + "\n", "ghp_a1", "eyJ", "eyJabcdefgh.ab"]


def spans(df):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in df.collect()}


def plain(text):
    out = []
    for kind, pattern, group, least in SECRETS:
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group] or "") >= least]
    order = [k for k, *_ in SECRETS]
    return [(k, a, b) for a, k, b in sorted(out, key=lambda x: (x[0], order.index(x[1])))]


def test_keys_without_an_end_line(spark):
    bodies = ["", " \r\n", " x", "\n" + LINE, "\n" + LINE + " \r\n" + LINE + "  \nshort line", f"\n{LINE}\n{LINE}\nAbc=", f"\n{LINE}==\n{LINE}", f"\n{LINE}.x", "\nAbc==\n" + LINE, "\nshort", f"\n{LINE}\n\n{LINE}", f"\n{LINE}\nwords behind it go on, here"]
    texts = [f"x {HEAD}{b}" for b in bodies] + [f"{HEAD}{b}{HEAD}{b}" for b in bodies] + ["eyJabcdefgh.abcdefgh.eyJabcdefgh.abcdefgh.abcdefgh eyJabcdefghi.short.x eyJa"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert spans(find_secrets(df)) == {i: plain(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("size", [500_000])
def test_texts_that_repeat_a_part(spark, size):
    began = time.time()
    texts = [p * (size // len(p)) for p in PIECES] + [HEAD + "\n" + (LINE + "\n") * 40_000]
    for i, t in enumerate(texts):
        df = spark.createDataFrame([(i,)], "doc_id long").withColumn("text", F.expr(f"repeat(decode(unhex('{PIECES[i].encode().hex()}'), 'UTF-8'), {size // len(PIECES[i])})") if i < len(PIECES) else F.lit(t))
        got = find_secrets(df).select(F.size("spans").alias("n"), F.try_element_at("spans", F.lit(1)).alias("first"), F.try_element_at("spans", F.lit(-1)).alias("last")).first()
        if i == len(texts) - 1:
            assert (got.n, got.first.kind, got.first.start, got.first.end) == (1, "private_key", 0, len(t) - 1)
            assert redact(find_secrets(df)).first().text == "<secret>\n"
        assert time.time() - began < 200, (i, texts[i][:40])
