"""Mixing sources to target weights by soft membership; all in Spark SQL.

A labelled table gives some documents a domain. A naive Bayes classifier predicts every document's domain posteriors
from its tokens' hashes, each of `SLOTS` slots there or not. It is fitted on a bounded sample of `max_docs` labelled
documents and holds the log odds of every slot that tells one of the rarer domains apart from the rest beyond chance (a
two-proportion z test at `sure` deviations), so a text that shows nothing of these is the largest domain's. The model is one row with an array of slots, which tasks look up by place. Posteriors are rounded to thousandths, so
that equal ones can be summed.

Non-negative rates, one for each document, are then fitted by projected
gradient steps on least squares, so that the expected token totals of the domains, the sums of
rate * tokens * posterior, match the targets: sum over domains of (total - target)**2 / target, with a small ridge
towards rate 1; `most` bounds the rates from above as well. Gradients are taken in the metric weighted by tokens, in
which a document's rate depends on its
posteriors alone; so the corpus is summed once to a row for each different posterior vector, each step is one
aggregate of a few numbers over these rows, and a document's rate is a fold over the steps' residuals. Steps end when
each domain is within `close` of its own target, or after `max_steps`; the totals reached are returned beside the targets.

Edge cases: a null or empty text has no token and the posteriors of a text without known tokens; a null label is no
label; of several labels of an id the largest domain number counts; without labels all domains are equally likely;
a domain that has no document keeps its target unmet; an empty table gives an empty table; all other columns stay,
whatever their names, but columns named like results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgelens.llm.common import clean_text, materialise
from pledgelens.llm.native import free_names

WORD = "[^\\x20\\x09-\\x0D]+"
#: Marks that become blanks before a text is cut into tokens.
MARKS = "\t\n\x0b\x0c\r.,;:!?\"'()[]{}<>"


SLOTS = 1 << 16


@dataclass(frozen=True)
class DomainModel:
    """The score of domain k is base[k] + the sum of a slot's entries k over the text's different slots; most slots have no entries.

    slots: a table of one row, with the slots' entries as `gains`; None for a model without any.
    """

    domains: list[str]
    base: list[float]
    slots: DataFrame | None = None


def slots_of(text: str | Column) -> Column:
    """The slots of a text's lower-case tokens; marks and white space part them."""
    tokens = F.split(F.translate(F.lower(clean_text(text)), MARKS, " " * len(MARKS)), " ")
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int"))


#: The slot of the empty token, which blanks in a row give.
EMPTY = "pmod(xxhash64(''), {n})"


def fit_domains(docs: DataFrame, domain_of: DataFrame, domains: list[str], *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 16_000, least: int = 3, sure: float = 5.0) -> DomainModel:
    """domain_of: (id, domain number). The sample is the `max_docs` labelled ids that hash lowest; a slot is in at least `least` documents of a domain."""
    ids = domain_of.where(F.col(id_col).isNotNull() & F.col("domain").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("domain").alias("domain"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(ids), "id").select("domain", F.array_distinct(slots_of("body")).alias("slots"))
    n, spark = len(domains), docs.sparkSession
    # the number of documents by domain stands beside the counts, as slot -1
    marked = sample.select("domain", F.explode(F.array_append("slots", F.lit(-1))).alias("slot"))
    seen = materialise(marked.groupBy("slot").agg(*(F.count_if(F.col("domain") == k).alias(f"n{k}") for k in range(n))))
    whole = seen.where("slot = -1").first()
    size = [whole[f"n{k}"] if whole else 0 for k in range(n)]
    total = sum(size)
    if not total:
        return DomainModel(domains, [0.0] * n)
    tell, p = F.lit(False), [(F.col(f"n{k}") + 0.5) / (size[k] + 1) for k in range(n)]
    largest = max(range(n), key=lambda k: size[k])
    for k in range(n):
        rest = total - size[k]
        if size[k] and rest and k != largest:
            inside, outside = F.col(f"n{k}"), sum((F.col(f"n{j}") for j in range(n) if j != k), F.lit(0))
            both = (inside + outside + 1) / (total + 2)
            z = (inside / size[k] - outside / rest) / F.sqrt(both * (1 - both) * (1 / size[k] + 1 / rest))
            tell = tell | ((inside >= least) & (z >= sure))
    told = seen.where((F.col("slot") >= 0) & (F.col("slot") != F.expr(EMPTY.format(n=SLOTS)))).where(tell)
    absent = told.agg(*(F.coalesce(F.sum(F.log(1 - p[k])), F.lit(0.0)).alias(f"b{k}") for k in range(n))).first()
    base = [float(np.log((size[k] + 1) / (total + n))) + absent[f"b{k}"] for k in range(n)]
    entries = told.select(F.col("slot").cast("long").alias("id"), F.array(*(F.log(x) - F.log(1 - x) for x in p)).alias("g"))
    slots = spark.range(SLOTS).join(entries, "id", "left").agg(F.sort_array(F.collect_list(F.struct("id", "g"))).alias("s")).select(F.col("s.g").alias("gains"))
    return DomainModel(domains, base, materialise(slots))


def add_posteriors(docs: DataFrame, model: DomainModel, *, text_col: str = "text") -> DataFrame:
    """Add tokens (long, words between white space) and posteriors (array, a thousandth's steps)."""
    rows = docs.drop("tokens", "posteriors")
    gains, found, score, odds = free_names(rows, "_gains", "_found", "_score", "_odds")
    made = rows.withColumn("tokens", F.regexp_count(clean_text(text_col), F.lit(WORD)).cast("long"))
    if model.slots is not None:
        # a subquery of one value; the next projection takes it in, and its functions look up the array by reference
        made = made.withColumn(gains, F.array(model.slots.select("gains").scalar()))
        told = F.transform(gains, lambda g: F.transform(F.array_distinct(F.filter(slots_of(text_col), lambda s: g[s].isNotNull())), lambda s: g[s]))[0]
        made = made.select(*rows.columns, "tokens", told.alias(found))
        made = made.withColumn(score, F.expr("array(" + ", ".join(f"aggregate({found}, {b!r}D, (s, g) -> s + g[{k}])" for k, b in enumerate(model.base)) + ")"))
    else:
        made = made.withColumn(score, F.expr("array(" + ", ".join(f"{b!r}D" for b in model.base) + ")"))
    made = made.withColumn(odds, F.expr(f"transform({score}, x -> exp(x - array_max({score})))"))
    made = made.withColumn("posteriors", F.expr(f"transform({odds}, x -> round(x / aggregate({odds}, 0D, (s, y) -> s + y), 3))"))
    return made.select(*rows.columns, "tokens", "posteriors")


def _rate(steps: list[list[float]], eta: float, ridge: float, most: float | None) -> Column:
    """A document's rate after the steps' scaled residuals: a fold over them, each step projected on [0, most]."""
    if not steps:
        return F.lit(1.0)
    held = "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in s) + ")" for s in steps) + ")"
    dot = "aggregate(zip_with(posteriors, g, (p, x) -> p * x), 0D, (s, x) -> s + x)"
    moved = f"greatest(0D, r - {eta!r}D * ({dot} + {ridge!r}D * (r - 1D)))"
    return F.expr(f"aggregate({held}, 1D, (r, g) -> {moved if most is None else f'least({most!r}D, {moved})'})")


@dataclass(frozen=True)
class Mixture:
    steps: list[list[float]]
    eta: float
    ridge: float
    targets: list[float]
    reached: list[float]
    most: float | None = None


def fit_rates(rows: DataFrame, weights: list[float], *, total: float | None = None, spare: float = 1.0, ridge: float = 1e-3, max_steps: int = 60, close: float = 1e-3, most: float | None = None) -> Mixture:
    """rows: tokens and posteriors. weights: the domains' shares of `total` tokens; by default the total at which the domain of the largest weight is used once, times `spare`. `most`: the largest rate."""
    n = len(weights)
    cells = materialise(rows.groupBy("posteriors").agg(F.sum("tokens").cast("double").alias("tokens")))
    moments = cells.agg(F.sum("tokens").alias("t"), *(F.sum(F.col("tokens") * F.col("posteriors")[i] * F.col("posteriors")[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)), *(F.sum(F.col("tokens") * F.col("posteriors")[k]).alias(f"e{k}") for k in range(n))).first()
    all_tokens = moments.t or 0.0
    if not all_tokens:
        return Mixture([], 0.0, ridge, [0.0] * n, [0.0] * n, most)
    w = np.array(weights, float) / sum(weights)
    natural = np.array([moments[f"e{k}"] for k in range(n)])
    main = int(w.argmax())
    goal = w * (total if total is not None else spare * natural[main] / w[main])
    scale = 1 / np.maximum(goal, 1e-6 * all_tokens)
    m = np.array([[moments[f"m{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    eta = float(1 / (np.linalg.eigvalsh(np.sqrt(scale)[:, None] * m * np.sqrt(scale)[None, :]).max() + ridge))
    steps: list[list[float]] = []
    reached = natural
    for _ in range(max_steps):
        if (np.abs(reached - goal) * scale).max() <= close:
            break
        steps.append([float(x) for x in (reached - goal) * scale])
        got = cells.withColumn("rate", _rate(steps, eta, ridge, most)).agg(*(F.sum(F.col("tokens") * F.col("rate") * F.col("posteriors")[k]).alias(f"e{k}") for k in range(n))).first()
        reached = np.array([got[f"e{k}"] for k in range(n)])
    return Mixture(steps, eta, ridge, goal.tolist(), reached.tolist(), most)


def add_rates(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """Add rate (double) to rows with posteriors."""
    return rows.drop("rate").withColumn("rate", _rate(mixture.steps, mixture.eta, mixture.ridge, mixture.most))


#: The domains and weights of the test data's marks; any others go through the parameters.
DOMAINS = ["clean", "low", "toxic"]
WEIGHTS = [0.94, 0.03, 0.03]


def label_domains(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Domain numbers from the quality and toxic marks."""
    return labels.select(id_col, F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("domain"))


def mix_documents(docs: DataFrame, domain_of: DataFrame, *, domains: list[str] = DOMAINS, weights: list[float] = WEIGHTS, spare: float = 1.0, most: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Mixture]:
    """Documents without their texts, with tokens, posteriors and rate, and the fitted mixture. domain_of: (id, domain number)."""
    model = fit_domains(docs, domain_of, domains, id_col=id_col, text_col=text_col)
    held = materialise(add_posteriors(docs, model, text_col=text_col).drop(text_col))
    mixture = fit_rates(held, weights, spare=spare, most=most)
    return add_rates(held, mixture), mixture


def keep_by_rate(docs: DataFrame, domain_of: DataFrame, *, domains: list[str] = DOMAINS, weights: list[float] = WEIGHTS, spare: float = 1.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose hash, as a share of its range, is under their rate. Rates are fitted within 0 and 1, since no document is repeated."""
    model = fit_domains(docs, domain_of, domains, id_col=id_col, text_col=text_col)
    own = free_names(docs.drop("tokens", "posteriors", "rate"), *(f"_own{i}" for i in range(len(docs.columns))))
    names = dict(zip(docs.columns, own))  # the caller's columns, whatever their names
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    rows = materialise(add_posteriors(rows, model, text_col=names[text_col]))
    mixture = fit_rates(rows, weights, spare=spare, most=1.0)
    chance = F.pmod(F.xxhash64(F.col(names[id_col]), clean_text(names[text_col])), F.lit(1 << 30)) / float(1 << 30)
    return add_rates(rows, mixture).where(chance < F.col("rate")).select(*(F.col(n).alias(c) for c, n in names.items()))
