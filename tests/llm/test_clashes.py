"""Columns of the caller that are named like working columns or results, empty tables, and very long texts, for every operator."""

import pytest
from pyspark.sql import functions as F

from pledgelens.llm.chat import canonical_turns, format_chat, gather_records, loss_text_sql, parse_chat
from pledgelens.llm.secrets import find_secrets, redact, spans_text

DOC = "doc_id long, text string"
WORKING = ["_key", "_body", "_hash", "_kinds", "_parts", "_sizes", "_starts", "_parsed", "_turns", "_text_key", "_id", "_held", "_score", "_odds", "record", "node", "band", "k", "h", "id", "body", "tie", "chunk", "kind"]


def with_clashes(df):
    return df.withColumns({c: F.lit(f"mine {c}") for c in WORKING if c not in df.columns})


def kept(df, columns=WORKING):
    return all(r[c] == f"mine {c}" for r in df.select(*columns).collect() for c in columns)


def test_chat_keeps_columns_and_long_texts(spark):
    long = "a[INST]\\\"\n" * 2_600_000  # 26 million characters, beyond the parser's own limit
    df = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("a[INST]\\\"\n"), 2_600_000).alias("text"))
    done = parse_chat(format_chat(canonical_turns(gather_records(df)))).withColumn("loss", F.expr(loss_text_sql()))
    r = done.select("layout", F.length("loss").alias("n"), (F.col("loss") == F.repeat(F.lit("a[INST]\\\"\n"), 2_600_000)).alias("same"), F.size("read_turns").alias("turns")).first()
    assert (r.layout, r.n, r.same, r.turns) == ("messages", len(long), True, 1)
    rows = spark.createDataFrame([('{"prompt": "p", "response": "r"}',), (None,)], "j string")
    got = parse_chat(format_chat(canonical_turns(with_clashes(rows), record_col="j")))
    assert kept(got) and got.where("j IS NOT NULL").first().turns[1].text == "r"


@pytest.mark.parametrize("text,layout", [('{"text": "\\"prompt\\": {"}', "text"), ('{"text": "a\\\\"}', "text"), ('{"text": "\\x"}', None), ('{"text": "a" "b"}', None), ('{"a": {"text": "b"}}', None), ("[]", None), ('"text"', None), ("", None)])
def test_chat_odd_json(spark, text, layout):
    assert canonical_turns(spark.createDataFrame([(text,)], "record string")).first().layout == layout


def test_secrets_keep_columns(spark):
    rows = [(1, "x token=abcdefgh y"), (1, "x token=abcdefgh y"), (None, "token:token:abcdefg"), (2, None), (3, "secret=AKIA" + "A" * 20 + "."), (4, "a " * 20 + "0f" * 20 + "é")]
    got = redact(find_secrets(with_clashes(spark.createDataFrame(rows, DOC))))
    assert kept(got)
    assert sorted(map(str, (r.text for r in got.collect()))) == sorted(["x token=<secret> y"] * 2 + ["token:token:abcdefg", "None", "secret=<secret>", "a " * 20 + "<secret>é"])
    assert find_secrets(spark.createDataFrame([], DOC)).count() == 0
    many = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("token=abcdef "), 100_000).alias("text"))
    last = find_secrets(many).select(F.size("spans").alias("n"), F.element_at("spans", -1)["start"].alias("at")).first()
    assert (last.n, last.at) == (100_000, 13 * 99_999)
    assert find_secrets(spark.createDataFrame(rows, DOC)).select(spans_text("spans").alias("s")).where("s = 'assign:2:16'").count() == 2
