"""The pipeline's stages on the smallest data: each works on what its predecessor kept."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from pledgelens.llm.common import materialise


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = labels.where("quality = 1 AND toxic = 0").join(docs, "doc_id", "left_semi")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        new = materialise(stage(spark, docs, sf))
        assert new.join(docs, "doc_id", "left_anti").isEmpty(), name
        if k + 1 < len(P.STAGES):
            assert new.columns == columns
        else:
            assert new.count() == docs.count() and new.where("n_tokens = size(ids)").count() == docs.count()
        docs = new
    assert docs.join(clean, "doc_id", "left_semi").count() > 0.6 * clean.count()


def test_piece_stage_against_the_library(spark):
    import hashlib

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {1: "the cat  sat", 2: "", 3: None, 4: "\U0001F600é漢\n\tx = 10", 5: "a" * 3000}
    got = {r.doc_id: r for r in P.pieces(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert (got[i].ids, got[i].n_tokens, got[i].decoded_sha256) == (ids, len(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_secret_stage_against_expressions(spark):
    texts = {1: "x AKIA" + "Z" * 16 + " y", 2: "no secret", 3: None, 4: "ab12" * 8 + " and ghp_" + "z" * 36}
    got = {r.doc_id: r for r in P.secrets(spark, spark.createDataFrame([(i, t, len(t or "")) for i, t in texts.items()], "doc_id long, text string, n_chars long"), "").collect()}
    want = {i: t and re.sub("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}|gh[pousr]_[A-Za-z0-9]{36,}", "<secret>", t) for i, t in texts.items()}
    assert {i: (r.text or "", r.n_chars) for i, r in got.items()} == {i: (t or "", len(t or "")) for i, t in want.items()}


def test_stages_keep_columns_and_take_odd_rows(spark, sf):
    """Callers' columns named like results or working columns, null and repeated rows, and empty tables."""
    extra = {c: F.lit(f"mine {c}") for c in ("score", "predicted", "tokens", "posteriors", "rate", "spans", "_key", "_text_key", "node", "record")}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90001, None), (90002, ""), (None, "a b c"), (90003, "token=abcdefgh " * 3), (90003, "token=abcdefgh " * 3)], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumns(extra)
    for name, stage in P.STAGES[:-1]:
        new = materialise(stage(spark, docs, sf))
        assert new.columns == docs.columns and [f.dataType for f in new.schema] == [f.dataType for f in docs.schema], name
        assert all(new.where(F.col(c) != f"mine {c}").isEmpty() for c in extra), name
        assert new.count() <= docs.count() and stage(spark, docs.limit(0), sf).count() == 0, name
        docs = new
    assert P.pieces(spark, docs, sf).count() == docs.count()
