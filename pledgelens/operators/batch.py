"""Scoring batches, refreshes, the tables served from them, and published snapshots."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from pledgelens.operators import loads as L
from pledgelens.operators import metrics as M
from pledgelens.operators import scores as S
from pledgelens.operators import screening as X
from pledgelens.sources.store import Generations, written

ENGINES = ("gap", "mna", "opacity")

SNAPSHOT_COLUMNS = {
    "valueup_scores": ["corp_code", "corp_name", "market", "execution_score", "progress_rate", "achievement_rate", "washing_flag", "buyback_status", "score_basis"],
    "sector_valuation_map": ["corp_code", "sector", "market", "pbr", "per", "ev_ebit"],
    "roe_pbr_scatter": ["corp_code", "market", "roe", "pbr"],
    "dividend_buyback": ["corp_code", "year", "quarter", "dividend_total", "payout_ratio", "total_return_ratio", "period_status"],
    "macro_layer": ["indicator", "date", "value", "frequency"],
}


@dataclass
class RunResult:
    engine: str
    as_of: str
    scored: int = 0
    deleted: int = 0
    failed: list[str] = field(default_factory=list)
    subset: bool = False

    @property
    def complete(self) -> bool:
        return not self.failed

    @property
    def publishable(self) -> bool:
        """Ranks over a subset are never publishable."""
        return self.complete and not (self.subset and self.engine != "gap")


def score_engine(engine: str, t, as_of: str, cfg: S.Config = S.Config(), corp_codes: list[str] | None = None, metrics: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """One engine's rows of a day; an empty universe of facts is an error before anything is written.

    metrics and chosen: the valuation metrics and the plans in force, where they are at hand.
    """
    metrics = M.valuation_metrics(t.financials, t.prices) if metrics is None else metrics
    metrics_d = M.reports_as_of(metrics, as_of)
    if engine == "gap":
        chosen = S.choose_plans(t.valueup_plan, as_of) if chosen is None else chosen
        out = S.valueup_score(chosen, metrics_d, M.reports_as_of(t.financials, as_of), as_of, cfg)
        return out.where(F.col("corp_code").isin(corp_codes)) if corp_codes else out
    if engine == "mna":
        own = M.latest_as_of(t.ownership, ["corp_code"], ["as_of"], as_of, "as_of")
        if metrics.where(M.known_at(as_of)).isEmpty() and t.ownership.where(F.col("as_of") <= as_of).isEmpty():
            raise ValueError("neither metrics nor ownership: nothing to rank")
        return S.mna_score(metrics_d, own, t.company, t.macro_indicator, as_of, cfg, corp_codes)
    if engine == "opacity":
        chosen = S.choose_plans(t.valueup_plan, as_of) if chosen is None else chosen
        if chosen.isEmpty():
            raise ValueError("no plan: nothing to rank")
        out = S.opacity_score(chosen, t.company, as_of, cfg)
        return out.where(F.col("corp_code").isin(corp_codes)) if corp_codes else out
    raise ValueError(f"unknown engine {engine!r}")


def stored_scores(spark: SparkSession, out: str, engine: str, as_of: str) -> DataFrame | None:
    """An engine's rows in force of a day, None if there are none."""
    rows = Generations(spark, out).read(engine, as_of)
    return None if rows is None else rows.withColumn("as_of", F.lit(as_of))


def run_scoring(t, out: str, as_of: str, engines: tuple[str, ...] = ENGINES, corp_codes: list[str] | None = None, metrics: DataFrame | None = None, chosen: DataFrame | None = None) -> list[RunResult]:
    """Write each engine's rows of a day; an engine that fails leaves its old rows and does not stop the others.

    Rows without a basis any more are deleted (counted). With `corp_codes` only these companies are scored anew or
    deleted: all others keep their rows. The new rows are a generation of their own, staged whole; one pointer swap puts
    them in force, so that a failure at any moment leaves the old ones. Engines run side by side.
    """
    if corp_codes is not None and not corp_codes:
        raise ValueError("corp_codes is empty; leave it out to score all companies")
    spark = t.company.sparkSession
    store = Generations(spark, out)

    def run(e: str) -> RunResult:
        r = RunResult(e, as_of, subset=corp_codes is not None)
        try:
            store.sweep(e, as_of)
            new = score_engine(e, t, as_of, corp_codes=corp_codes, metrics=metrics, chosen=chosen)
            old = stored_scores(spark, out, e, as_of)
            scope = None if corp_codes is None else spark.createDataFrame([(c,) for c in sorted(set(corp_codes))], "corp_code string")
            generation = store.stage(e, as_of, (new if old is None else L.reconcile(old.select(*new.columns), new, as_of, scope)).drop("as_of"))
            rows = store.staged(e, as_of, generation)
            if old is not None:
                gone = old.select("corp_code").join(rows.select("corp_code"), "corp_code", "left_anti")
                r.deleted = (gone if scope is None else gone.join(scope, "corp_code", "left_semi")).count()
            r.scored = (rows if scope is None else rows.join(scope, "corp_code", "left_semi")).count()
            store.commit(e, as_of, generation)
        except Exception as x:  # the failure is the result
            r.failed.append(f"{e}: {x}")
        return r

    with ThreadPoolExecutor(max(1, len(engines))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), engines))


def refresh_company(t, out: str, corp_code: str, as_of: str | None = None, metrics: DataFrame | None = None, chosen: DataFrame | None = None) -> list[RunResult]:
    """Score one company anew in a day's rows (by default the latest day that was scored) and rank all opacity again; each stage has its own result."""
    if as_of is None:
        as_of = Generations(t.company.sparkSession, out).days("gap")[-1]
    return [*run_scoring(t, out, as_of, ("gap",), [corp_code], metrics, chosen), *run_scoring(t, out, as_of, ("opacity",), chosen=chosen)]


#: Tables beside the engines' that a screening page reads.
SERVED = ("history", "metrics", "own_gap", "plans")


def serve_day(t, out: str, as_of: str) -> list[RunResult]:
    """All that a day's pages read: the metrics once, from them the three engines, and the smaller facts beside them.

    Reports, plans, last prices and the plans in force are written once, side by side; all else reads what was written.
    """
    spark = t.company.sparkSession
    store = Generations(spark, out)

    def put(name: str, df: DataFrame) -> DataFrame:
        store.sweep(name, as_of)
        generation = store.stage(name, as_of, df)
        store.commit(name, as_of, generation)
        return store.staged(name, as_of, generation)

    def beside(jobs: dict) -> tuple[dict, ThreadPoolExecutor]:
        pool = ThreadPoolExecutor(max(1, len(jobs)))
        return {n: pool.submit(inheritable_thread_target(spark)(f)) for n, f in jobs.items()}, pool

    first, pool = beside({"financials": lambda: written(t.financials), "valueup_plan": lambda: written(t.valueup_plan), "price": lambda: written(M.latest_price(t.prices))})
    with pool:
        t = replace(t, financials=first["financials"].result(), valueup_plan=first["valueup_plan"].result())
        price = first["price"].result()
    second, pool = beside({"history": lambda: put("history", M.valuation_metrics(t.financials, t.prices, price)), "chosen": lambda: written(S.choose_plans(t.valueup_plan, as_of))})
    with pool:
        history, chosen = second["history"].result(), second["chosen"].result()
    facts = {
        "metrics": lambda: M.reports_as_of(history, as_of).join(price, "corp_code", "full"),
        "own_gap": lambda: X.lowest_gaps(M.plan_own_gap(t.valueup_plan, history)),
        "plans": lambda: X.plan_reasons(t.valueup_plan),
    }
    jobs, pool = beside({n: lambda n=n, f=f: put(n, f()) for n, f in facts.items()})
    with pool:
        done = run_scoring(t, out, as_of, metrics=history, chosen=chosen)
        for j in jobs.values():
            j.result()
    return done


def stored_screening(spark: SparkSession, company: DataFrame, out: str, as_of: str) -> DataFrame:
    """The screening rows of a day from stored tables alone; an engine that was not run has no rows."""
    store = Generations(spark, out)
    metrics, lowest, plans = (store.read(n, as_of) for n in ("metrics", "own_gap", "plans"))
    if metrics is None or lowest is None or plans is None:
        raise ValueError(f"{as_of} is not served from {out}")
    gap, mna, opacity = (stored_scores(spark, out, e, as_of) for e in ENGINES)
    known = metrics.where("year IS NOT NULL")
    return X.screening_rows(company, gap, mna, opacity, known, metrics.select("corp_code", "market_cap"), lowest, plans)


#: Written before each file's text, so that spreadsheet programs read it as UTF-8.
BYTE_ORDER_MARK = "\ufeff"


def publish_snapshot(views: dict[str, DataFrame], out: str, as_of: str, generated_at: str) -> dict:
    """Write the five tables as CSV of a new generation and then the manifest that names it; a failure leaves the old one in force."""
    if set(views) != set(SNAPSHOT_COLUMNS):
        raise ValueError(f"views must be {sorted(SNAPSHOT_COLUMNS)}")
    for name, df in views.items():
        if df.columns != SNAPSHOT_COLUMNS[name]:
            raise ValueError(f"{name} has columns {df.columns}")
    spark = next(iter(views.values())).sparkSession
    generation, rows = f"gen={uuid.uuid4().hex}", {}
    for name, df in views.items():
        at = f"{out}/{generation}/view={name}"
        marked = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])  # the mark stands before the header
        marked.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(at)
        rows[name] = spark.read.option("header", True).schema(df.schema).option("enforceSchema", True).csv(at).count()
    manifest = {"as_of": as_of, "generated_at": generated_at, "generation": generation, "views": rows}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return manifest


def read_snapshot(spark: SparkSession, out: str, name: str) -> DataFrame:
    manifest = json.loads(spark.read.text(f"{out}/manifest").first()[0])
    return spark.read.option("header", True).schema(", ".join(f"{c} string" for c in SNAPSHOT_COLUMNS[name])).csv(f"{out}/{manifest['generation']}/view={name}")
