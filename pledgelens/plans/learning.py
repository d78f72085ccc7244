"""Queries over classifier evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pledgelens.operators import ml as L

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRED = "CASE WHEN (doc_id * 7) % 10 < 7 THEN quality ELSE toxic END"


@query(f"""SELECT round(sum(tp) / cast(sum(support) AS double), 6) AS accuracy, round(avg(2.0e0 * tp / (support + said)), 6) AS macro_f1, count(*) AS classes FROM (
SELECT k, (SELECT count(*) FROM labels WHERE quality = k) AS support, (SELECT count(*) FROM labels WHERE {PRED} = k) AS said, (SELECT count(*) FROM labels WHERE quality = k AND {PRED} = k) AS tp FROM (SELECT DISTINCT quality AS k FROM labels))""")
def classification_scores(spark, sf_dir):
    return L.classification_scores(table(spark, sf_dir, "labels").withColumn("p", F.expr(PRED)), "quality", "p")


GOLD = "CASE WHEN doc_id % 28 = 0 THEN ' ' WHEN doc_id % 20 = 0 THEN '01' ELSE cast(quality AS string) END"
PACKET = "CASE WHEN doc_id % 9 = 0 THEN 'notice' ELSE cast(toxic AS string) END"


@query(f"""WITH s AS (SELECT doc_id, nullif(trim(CASE WHEN doc_id % 4 = 0 THEN {GOLD} END), '') AS g, CASE WHEN doc_id % 3 <> 1 THEN {PACKET} END AS p FROM labels),
x AS (SELECT d.doc_id, d.text, coalesce(g, p) AS label, CASE WHEN g IS NOT NULL THEN 'gold' WHEN p IS NOT NULL THEN 'packet' END AS source, CASE WHEN g <> p THEN 'packet=' || p END AS overruled FROM documents d LEFT JOIN s USING (doc_id))
SELECT doc_id, label AS quality, source, overruled, CASE WHEN label IS NULL THEN 'unlabelled' WHEN label = 'notice' THEN 'left_out:notice' WHEN label NOT IN ('0', '1') THEN 'unknown_value:' || label WHEN trim(coalesce(text, '')) = '' THEN 'empty' END AS reason FROM x""")
def gold_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    gold = labels.where("doc_id % 4 = 0").select("doc_id", F.expr(GOLD).alias("quality"))
    packet = labels.where("doc_id % 3 <> 1").select("doc_id", F.expr(PACKET).alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.gold_join(docs, [("gold", gold), ("packet", packet)], "doc_id", "quality", ["0", "1"], ("notice",))


@query("SELECT doc_id, CASE WHEN text LIKE '%Licen%' THEN 'notice' WHEN n_chars >= 500 THEN 'decided' ELSE 'contested' END AS part FROM documents")
def partition_corpus(spark, sf_dir):
    return L.partition_corpus(table(spark, sf_dir, "documents"), F.col("n_chars") >= 500, F.contains("text", F.lit("Licen"))).select("doc_id", "part")


@query("SELECT source, CASE WHEN size <= 30 THEN size ELSE cast(floor(greatest(300 - coalesce(whole, 0), 0) * size / cast(rest AS double)) AS bigint) END AS n FROM (SELECT source, size, sum(CASE WHEN size <= 30 THEN size END) OVER () AS whole, sum(CASE WHEN size > 30 THEN size END) OVER () AS rest FROM (SELECT source, count(*) AS size FROM documents GROUP BY 1))")
def stratified_sample_sizes(spark, sf_dir):
    return L.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 300).groupBy("source").agg(F.count("*").alias("n"))


@query()
def stratified_sample_rows(spark, sf_dir):
    """The sampled rows themselves; which ones, a hash says that SQL does not have (tested against sorting whole classes)."""
    return L.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 300)


def _gram_oracle(sizes: tuple[int, ...] = (2, 3, 4), dim: int = 1 << 14) -> str:
    """CRC-32 by its definition: a table from the polynomial, then one step for each UTF-8 byte of an n-gram."""
    table_ = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
    octets = "list_transform(range(0, octet_length(encode(g))), lambda i: cast('0x' || substr(hex(encode(g)), 2 * i + 1, 2) AS bigint))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t.v[(xor(c, b) & 255) + 1])), 4294967295)"
    grams = " UNION ALL ".join(f"SELECT item_id, unnest(list_transform(range(1, greatest(length(s) - {n} + 2, 1)), lambda i: substr(s, i, {n}))) AS g FROM d" for n in sizes)
    return f"""WITH t AS (SELECT {table_} AS v), d AS (SELECT item_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS s FROM benchmark),
g AS ({grams}), c AS (SELECT item_id, {crc} % {dim} AS slot, count(*) AS n FROM g, t GROUP BY 1, 2),
v AS (SELECT item_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS value FROM c)
SELECT item_id, count(*) AS slots, cast(sum(slot) AS bigint) AS slot_sum, round(max(value), 6) AS heaviest, round(sum(value * value), 6) AS length FROM v GROUP BY 1"""


@query(_gram_oracle())
def char_ngram_features(spark, sf_dir):
    x = L.char_ngram_hash(table(spark, sf_dir, "benchmark"), "item_id", "text")
    square = F.round(F.sum(F.col("value") * F.col("value")), 6).alias("length")
    return x.groupBy("item_id").agg(F.count("*").alias("slots"), F.sum("slot").alias("slot_sum"), F.round(F.max("value"), 6).alias("heaviest"), square)


def _fold_oracle(k: int = 5) -> str:
    """The groups one after the other, with the folds' sizes and class counts as lists."""
    places = f"range(1, {k + 1})"
    added = lambda xs, n: f"list_transform({places}, lambda f: x.{xs}[f] + CASE WHEN f = x.pick THEN {n} ELSE 0 END)"
    none = f"[{', '.join('cast(0 AS bigint)' for _ in range(k))}]"
    pick = f"list_sort(list_transform({places}, lambda f: [CASE WHEN o.main = 0 THEN w.h0[f] ELSE w.h1[f] END, w.s[f], f]))[1][3]"
    return f"""WITH RECURSIVE c AS (SELECT source, count(*) FILTER (WHERE quality = 0) AS n0, count(*) FILTER (WHERE quality = 1) AS n1 FROM documents JOIN labels USING (doc_id) GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n0 + n1 DESC, source) AS r, CASE WHEN n1 > n0 THEN 1 ELSE 0 END AS main FROM c),
w AS (SELECT cast(0 AS bigint) AS r, cast(NULL AS varchar) AS source, cast(0 AS bigint) AS pick, {none} AS s, {none} AS h0, {none} AS h1
 UNION ALL SELECT x.r, x.source, x.pick, {added('s', 'x.n0 + x.n1')}, {added('h0', 'x.n0')}, {added('h1', 'x.n1')}
 FROM (SELECT o.r, o.source, o.n0, o.n1, w.s, w.h0, w.h1, {pick} AS pick FROM w JOIN o ON o.r = w.r + 1) x)
SELECT source, cast(pick - 1 AS int) AS fold FROM w WHERE r > 0"""


@query(_fold_oracle())
def grouped_folds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality")
    return L.group_folds(docs, "source", "quality", 5)


@query()
def evaluate_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "source", "quality")
    return L.evaluate(docs, "doc_id", "text", "source", "quality", rule=(F.length("text") >= 500).cast("int"))
