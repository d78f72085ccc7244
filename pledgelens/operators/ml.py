"""Evaluation of text classifiers: features, folds, samples, scores."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pledgelens.operators.stacked import confusion, fit_stack, make_stack
from pledgelens.sources.store import written


def char_ngram_hash(df: DataFrame, key: str, text: str, dim: int = 1 << 14, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(key, slot, value): character n-grams by crc32 mod dim, each row's values scaled to length 1; runs of white space are one blank."""
    rows = df.select(key, F.explode(_all_grams(text, sizes)).alias("g")).select(key, (F.crc32(F.encode("g", "UTF-8")) % dim).alias("slot"))
    n = rows.groupBy(key, "slot").agg(F.count("*").alias("n"))
    norm = n.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return n.join(norm, key).select(key, "slot", (F.col("n") / F.col("norm")).alias("value"))


def _even(text: str | Column) -> Column:
    """The text with one blank for each run of white space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def _all_grams(text: str | Column, sizes: tuple[int, ...]) -> Column:
    t = _even(text)
    return F.concat(*(_grams(t, n) for n in sizes))


def char_ngram_vectors(df: DataFrame, text: str | Column, out: str, dim: int = 1 << 14, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Add the values of char_ngram_hash as a sparse vector of `dim` slots; a text without n-grams is the zero vector."""
    from pyspark.ml.feature import CountVectorizerModel, Normalizer

    slots = df.withColumn("_slots", F.transform(_all_grams(text, sizes), lambda g: (F.crc32(F.encode(g, "UTF-8")) % dim).cast("string")))
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="_slots", outputCol="_counts")
    return Normalizer(p=2.0, inputCol="_counts", outputCol=out).transform(model.transform(slots)).drop("_slots", "_counts")


def _grams(t: Column, n: int) -> Column:
    """All runs of n code points in one walk over the text: each match consumes one and looks ahead over n."""
    return F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)


def classification_scores(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: accuracy, macro F1 over classes with support (a class without a defined F1 counts 0), and the number of classes."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    long = counts.select(F.explode(F.array(F.struct(F.col("y").alias("k"), F.lit("y").alias("side")), F.struct(F.col("p").alias("k"), F.lit("p").alias("side")))).alias("s"), (F.col("y") == F.col("p")).alias("hit"), "n").select("s.k", "s.side", "hit", "n")
    per = long.groupBy("k").agg(F.sum(F.when(F.col("side") == "y", F.col("n"))).alias("support"), F.sum(F.when(F.col("side") == "p", F.col("n"))).alias("said"), F.sum(F.when((F.col("side") == "y") & F.col("hit"), F.col("n"))).alias("tp"))
    per = per.where("support IS NOT NULL").withColumns({"tp": F.coalesce("tp", F.lit(0)), "said": F.coalesce("said", F.lit(0))})
    f1 = 2.0 * F.col("tp") / (F.col("support") + F.col("said"))
    return per.agg(F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg(f1), 6).alias("macro_f1"), F.count("*").alias("classes"))


def class_scores(df: DataFrame, y: str, pred: str, by: tuple[str, ...] = (), n: Column | None = None) -> DataFrame:
    """(by, class, support, tp, precision, recall, f1) of each class that is true or predicted; rows count n times.

    A measure with denominator 0 is null; F1 is 0 for a class with support and no hit.
    """
    counts = df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.sum(n if n is not None else F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))
    long = counts.select(*by, F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.explode(sides).alias("s")).select(*by, "s.class", "s.support", "s.said", "hit")
    per = long.groupBy(*by, "class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum(F.when(F.col("support") > 0, F.col("hit")).otherwise(0)).alias("tp"))
    over = lambda a, b: F.when(b > 0, a / b)
    tp, support, said = F.col("tp"), F.col("support"), F.col("said")
    return per.select(*by, "class", "support", "tp", over(tp, said).alias("precision"), over(tp, support).alias("recall"), over(2.0 * tp, F.when((support > 0) | (tp > 0), support + said)).alias("f1"))


#: Rows that a bin of hash values holds on average.
BIN_ROWS = 4096


def stratified_sample(df: DataFrame, cls: str, key: str, n: int, small: int = 30) -> DataFrame:
    """Classes of up to `small` rows whole, the rest of n shared out in proportion; within a class the rows whose keys hash lowest.

    A class is cut into bins of hash values, more of them the larger it is. Counts of the bins say which one a class's quota
    ends in; bins before it are taken whole, and only that bin's rows are put in order. Rows of one key share a bin. A null
    class is one.
    """
    rows = df.withColumn("_h", F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0)))
    sizes = df.groupBy(cls).agg(F.count("*").alias("size"))
    totals = sizes.agg(F.sum(F.when(F.col("size") <= small, F.col("size"))).alias("whole"), F.sum(F.when(F.col("size") > small, F.col("size"))).alias("rest"))
    left = F.greatest(F.lit(n) - F.coalesce(totals.select("whole").scalar(), F.lit(0)), F.lit(0))
    rest = totals.select("rest").scalar()
    want = F.when(F.col("size") <= small, F.col("size")).otherwise(F.floor(left * F.col("size") / rest))
    bits = F.least(F.lit(32), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / BIN_ROWS)))).cast("int")
    quota = sizes.select(F.col(cls).alias("_c"), want.alias("_want"), bits.alias("_bits"))
    binned = rows.join(quota, F.col(cls).eqNullSafe(F.col("_c"))).withColumn("_bin", F.expr("shiftright(_h, 32 - _bits)")).drop("_c", "_bits")
    counts = binned.groupBy(F.col(cls).alias("_c"), "_bin", "_want").agg(F.count("*").alias("_t"))
    upto = F.sum("_t").over(Window.partitionBy("_c").orderBy("_bin"))
    last = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_t") < F.col("_want")))
    last = last.select("_c", F.col("_bin").alias("_last"), (F.col("_want") - F.col("_upto") + F.col("_t")).alias("_more"))
    cut = binned.join(last, F.col(cls).eqNullSafe(F.col("_c")))
    order = Window.partitionBy(cls).orderBy("_h", key)
    inside = cut.where(F.col("_bin") == F.col("_last")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_more"))
    return cut.where(F.col("_bin") < F.col("_last")).select(*df.columns).unionByName(inside.select(*df.columns))


def group_folds(df: DataFrame, group: str, y: str, k: int = 5, seed: int | None = None) -> DataFrame:
    """(group, fold): whole groups, largest first, each to the fold with the fewest rows of its main class (ties: the smallest fold).

    Groups of one size follow their names, or with a seed a hash of seed and name.

    Only the groups' class counts come to the driver; their number is that of the groups (companies), checked here.
    """
    return _folds_frame(df, group, [(g, f) for g, f in _deal(_group_counts(df, group, y), k, seed).items()], "fold int")


def _group_counts(df: DataFrame, group: str, y: str) -> dict:
    """Each group's rows by class, on the driver."""
    counts = df.groupBy(group, y).agg(F.count("*").alias("n"))
    if counts.select(group).distinct().count() > 1_000_000:
        raise ValueError("too many groups to deal one by one")
    by: dict = {}
    for r in counts.collect():
        by.setdefault(r[group], {})[r[y]] = r["n"]
    return by


def _deal(by: dict, k: int, seed: int | None) -> dict:
    size, held, out = [0] * k, [dict() for _ in range(k)], {}
    name = lambda g: (0 if seed is None else zlib.crc32(f"{seed}:{g}".encode()), str(g))
    for g in sorted(by, key=lambda g: (-sum(by[g].values()), name(g))):
        main = max(sorted(by[g], key=str), key=lambda c: by[g][c])
        fold = min(range(k), key=lambda f: (held[f].get(main, 0), size[f], f))
        for c, n in by[g].items():
            held[fold][c] = held[fold].get(c, 0) + n
            size[fold] += n
        out[g] = fold
    return out


def _folds_frame(df: DataFrame, group: str, rows: list, fold: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, f"{group} {df.schema[group].dataType.simpleString()}, {fold}")


def all_folds(x: DataFrame, group: str, y: str, k: int, repeats: int) -> DataFrame:
    """(_g, folds array<int>): the fold of each group in each repeat; the groups' counts are read once."""
    by = _group_counts(x, group, y)
    dealt = [_deal(by, k, 1000 + rep) for rep in range(repeats)]
    return _folds_frame(x, group, [(g, [d[g] for d in dealt]) for g in by], "folds array<int>").withColumnRenamed(group, "_g")


def evaluate(df: DataFrame, key: str, text: str, group: str, y: str, k: int = 5, repeats: int = 5, dim: int = 1 << 14, rule: Column | None = None, embedding: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(system, class, folds, macro_f1, macro_f1_sd, accuracy, accuracy_sd, recall, recall_sd, support) over repeated grouped folds.

    Systems: `rule` (a column that names the class, not fitted), class-weighted multinomial logistic regressions on the
    character n-grams of the whole text and of its last segment, and one on `embedding`, a table (key, vec) of precomputed
    vectors of one length, where rows without one take no part. Means and population deviations are over folds and repeats;
    undefined measures are left out. Rows without a class take no part. The k * repeats models of a system are fitted side by
    side, one pass over the data for a step of all. Only confusion counts come to the driver, and sums of a model's size.
    """
    from pledgelens.functions.text import last_segment

    x = df.where(F.col(y).isNotNull()).select(key, F.col(group).alias("_group"), F.col(y).cast("string").alias("y"), F.col(text).alias("_text"), (rule if rule is not None else F.lit(None)).cast("string").alias("_rule"))
    names = sorted(r.y for r in x.select("y").distinct().collect())
    folds = all_folds(x, "_group", "y", k, repeats)
    dealt = x.join(folds, F.col("_group").eqNullSafe(F.col("_g"))).withColumn("label", (F.array_position(F.array(*map(F.lit, names)), F.col("y")) - 1).cast("int"))
    dealt = written(dealt.withColumn("_last", F.coalesce(last_segment("_text"), F.col("_text"))).drop("_g", "_group"))
    systems = {
        "char_full": (dealt.select("label", "folds", _even("_text").alias("features")), dim, True),
        "char_last_segment": (dealt.select("label", "folds", _even("_last").alias("features")), dim, True),
    }
    if embedding is not None:
        there = dealt.join(embedding.select(key, F.col("vec").cast("array<double>").alias("features")), key).where("features IS NOT NULL")
        width = there.select(F.size("features").alias("n")).first()
        if width is not None:
            systems["embedding"] = (there.select("label", "folds", "features"), width["n"], False)
    found = []
    if rule is not None:
        said = dealt.select("y", "_rule", F.posexplode("folds").alias("rep", "fold")).groupBy("rep", "fold", "y", "_rule").count().collect()
        found += [("rule", r["rep"], r["fold"], r["y"], r["_rule"], r["count"]) for r in said]
    for system, (rows, width, sparse) in systems.items():
        stack = make_stack(rows, width, len(names), repeats, k, sparse)
        if stack.tasks:
            w = fit_stack(stack, tolerance=tolerance)
            found += [(system, rep, fold, names[c], names[p], n) for rep, fold, c, p, n in confusion(stack, w) if stack.total[rep * k + fold] > 0]
    counts = df.sparkSession.createDataFrame(found, "system string, rep int, fold int, y string, p string, n long")
    per = class_scores(counts, "y", "p", ("system", "rep", "fold"), F.col("n"))
    whole = per.where("support > 0").groupBy("system", "rep", "fold").agg(F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"))
    moments = lambda *c: [f(x).alias(x + s) for x in c for f, s in ((F.avg, ""), (F.stddev_pop, "_sd"))]
    total = whole.groupBy("system").agg(F.count("*").alias("folds"), *moments("macro_f1", "accuracy"))
    classes = per.where("class IS NOT NULL").groupBy("system", "class").agg(*moments("recall"), F.sum("support").alias("support"))
    return total.join(classes, "system").select("system", "class", "folds", "macro_f1", "macro_f1_sd", "accuracy", "accuracy_sd", "recall", "recall_sd", "support")


def gold_join(docs: DataFrame, sources: list[tuple[str, DataFrame]], key: str, label: str, classes: list[str] | None = None, left_out: tuple[str, ...] = ()) -> DataFrame:
    """(key, label, source, overruled, reason): every document with its label, or the reason why it takes no part.

    `sources` come in order of precedence; the first that has a label for a document which is not blank decides, and
    `overruled` names the others' labels that differ, as source=label. The reasons, the first that holds: `unlabelled`, `contested`
    (the deciding source has several labels, the largest is shown), `left_out:<label>` for labels that stand outside the classes on
    purpose, `unknown_value:<label>` for any other outside them, `empty` for a blank text.
    """
    each = None
    for rank, (name, rows) in enumerate(sources):
        said = rows.select(key, F.trim(F.col(label).cast("string")).alias("_l")).where("_l <> ''")
        part = said.groupBy(key).agg(F.max("_l").alias("_l"), F.count_distinct("_l").alias("_k")).select(key, F.lit(rank).alias("_rank"), F.lit(name).alias("_source"), "_l", "_k")
        each = part if each is None else each.unionByName(part)
    g = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rank", "_source", "_l", "_k"))).alias("_all"))  # a row for each source
    first = F.col("_all")[0]
    others = F.filter(F.slice("_all", 2, len(sources)), lambda s: s["_l"] != first["_l"])
    overruled = F.nullif(F.array_join(F.transform(others, lambda s: F.concat(s["_source"], F.lit("="), s["_l"])), ","), F.lit(""))
    j = docs.join(g.select(key, first["_l"].alias("_label"), first["_source"].alias("_source"), first["_k"].alias("_k"), overruled.alias("_overruled")), key, "left")
    value = F.col("_label")
    reason = F.when(value.isNull(), "unlabelled").when(F.col("_k") > 1, "contested").when(value.isin(*left_out), F.concat(F.lit("left_out:"), value))
    if classes is not None:
        reason = reason.when(~value.isin(*classes), F.concat(F.lit("unknown_value:"), value))
    reason = reason.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty")
    return j.select(key, value.alias(label), F.col("_source").alias("source"), F.col("_overruled").alias("overruled"), reason.alias("reason"))


def partition_corpus(df: DataFrame, decided: Column, notice: Column) -> DataFrame:
    return df.withColumn("part", F.when(notice, "notice").when(decided, "decided").otherwise("contested"))
