"""Filters, sorts, pages and statistics over the scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgelens.functions.text import is_notice, references_external
from pledgelens.functions.values import finite
from pledgelens.operators.metrics import known_at
from pledgelens.operators.scores import disclosed_axes

SUPPORTED_MARKETS = ["KOSPI", "KOSDAQ"]
MACRO_SLOTS = ["base_rate", "bond_3y", "usd_krw", "cpi"]


@dataclass(frozen=True)
class ScreenFilter:
    """All limits are optional; a null value never passes one. sector is a literal prefix."""

    corp_code: str | None = None
    market: str | None = None
    sector: str | None = None
    min_execution: float | None = None
    max_execution: float | None = None
    min_mna: float | None = None
    max_mna: float | None = None
    min_opacity: float | None = None
    max_opacity: float | None = None
    min_roe: float | None = None
    max_pbr: float | None = None
    max_ev_ebit: float | None = None
    max_debt_ratio: float | None = None
    min_total_return: float | None = None
    min_market_cap: int | None = None
    max_market_cap: int | None = None
    max_own_gap: float | None = None
    buyback_executed: bool | None = None
    buyback_status: str | None = None

    def __post_init__(self):
        for k, v in self.__dict__.items():
            if isinstance(v, float) and not math.isfinite(v) or isinstance(v, str) and not v.strip():
                raise ValueError(f"{k} must be a finite number or a text that is not blank")

    LIMITS = {"execution": "execution_score", "mna": "mna_target_score", "opacity": "opacity_rank", "roe": "roe", "pbr": "pbr", "ev_ebit": "ev_ebit", "debt_ratio": "debt_ratio", "total_return": "total_return_ratio", "market_cap": "market_cap", "own_gap": "lowest_own_gap"}

    def conditions(self) -> list[Column]:
        out = [F.col(k) == getattr(self, k) for k in ("corp_code", "market", "buyback_status") if getattr(self, k) is not None]
        if self.sector is not None:
            out.append(F.startswith(F.col("sector"), F.lit(self.sector)))
        if self.buyback_executed is not None:
            out.append(F.col("buyback_executed").eqNullSafe(self.buyback_executed))
        for short, name in self.LIMITS.items():
            low, high = getattr(self, f"min_{short}", None), getattr(self, f"max_{short}", None)
            out += ([F.col(name) >= low] if low is not None else []) + ([F.col(name) <= high] if high is not None else [])
        return out


#: Investor presets of the serving screen.
PRESETS = {"opaque": ScreenFilter(min_opacity=0.7), "modest_target": ScreenFilter(max_own_gap=0.0), "bought_not_retired": ScreenFilter(buyback_status="purchased_only", min_total_return=40.0)}


def sort_keys(sort: str | None, allowed: list[str], tie: list[str]) -> list[Column]:
    """`field` or `-field`, nulls last either way, then the tie columns; an unknown or blank field is an error."""
    if sort is None:
        return [F.col(t) for t in tie]
    field = sort.removeprefix("-")
    if field not in allowed:
        raise ValueError(f"cannot sort by {sort!r}")
    own = F.col(field).desc_nulls_last() if sort.startswith("-") else F.col(field).asc_nulls_last()
    axes = [F.when(F.coalesce("score_basis", F.lit("")) == "", 0).otherwise(F.size(F.split("score_basis", "\\+"))).desc()] if field == "execution_score" else []
    return [own, *axes, *(F.col(t) for t in tie)]


@dataclass(frozen=True)
class Page:
    items: DataFrame
    filtered: DataFrame
    page: int
    size: int

    def total(self) -> int:
        return self.filtered.count()


def paged(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> Page:
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return Page(df.orderBy(*order).offset((page - 1) * size).limit(size), df, page, size)


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def list_metrics(metrics: DataFrame, company: DataFrame, *, market=None, sector=None, max_pbr=None, min_roe=None, max_debt_ratio=None, min_payout=None, sort: str | None = None, page: int = 1, size: int = 20) -> Page:
    rows = metrics.join(company.select("corp_code", "corp_name", "market", "sector"), "corp_code")
    conditions = [F.col(c) == v for c, v in (("market", market), ("sector", sector)) if v is not None]
    conditions += [F.col(c) <= v for c, v in (("pbr", max_pbr), ("debt_ratio", max_debt_ratio)) if v is not None]
    conditions += [F.col(c) >= v for c, v in (("roe", min_roe), ("payout_ratio", min_payout)) if v is not None]
    return paged(where_all(rows, conditions), sort_keys(sort, metrics.columns, ["corp_code", "year", "quarter"]), page, size)


def lowest_own_gap(scores: DataFrame, own_gap: DataFrame) -> DataFrame:
    """The smallest gap of each company's scored plan over its disclosed metrics; no row without one."""
    return scores.select("corp_code", F.col("source_plan_id").alias("plan_id")).join(own_gap.drop("corp_code"), "plan_id").where("own_gap IS NOT NULL").groupBy("corp_code").agg(F.min("own_gap").alias("lowest_own_gap"))


SCREEN_SORTS = ["corp_code", "execution_score", "mna_target_score", "opacity_rank", "roe", "pbr", "ev_ebit", "debt_ratio", "total_return_ratio", "market_cap", "lowest_own_gap"]


def lowest_gaps(own_gap: DataFrame) -> DataFrame:
    """(source_plan_id, lowest_own_gap): each plan's smallest known gap."""
    return own_gap.where("own_gap IS NOT NULL").groupBy(F.col("plan_id").alias("source_plan_id")).agg(F.min("own_gap").alias("lowest_own_gap"))


def plan_reasons(plans: DataFrame) -> DataFrame:
    """(source_plan_id, plan_body_signal, plan_date, unrankable_reason): what a page says of the plan behind a score.

    The reason of a plan without a disclosed axis: it is declared that nothing is attached, it points to a document
    outside its text, it only announces a plan, or nothing is known. Unknown marks and texts are no reason.
    """
    said = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(disclosed_axes() > 0, F.lit(None).cast("string"))
        .when(said(F.col("attachment_absent")), "undisclosed")
        .when(said(references_external("raw_text")), "unreadable")
        .when(said(is_notice("raw_text")), "notice")
        .otherwise("unstated")
    )
    return plans.select(F.col("plan_id").alias("source_plan_id"), F.col("body_signal").alias("plan_body_signal"), F.col("disclosure_date").alias("plan_date"), reason.alias("unrankable_reason"))


def screening_rows(company: DataFrame, gap: DataFrame | None, mna: DataFrame | None, opacity: DataFrame | None, metrics_d: DataFrame, price: DataFrame, lowest: DataFrame, plans: DataFrame) -> DataFrame:
    """Companies with any score of the day and the plan in force, with flags that tell a score that was not run from one that is null.

    lowest and plans are as `lowest_gaps` and `plan_reasons` give them. An engine without rows (None) was not run.
    """
    spark = company.sparkSession
    none = lambda fields: spark.createDataFrame([], "corp_code string, as_of string, " + fields)
    own = ["execution_score", "progress_rate", "washing_flag", "buyback_executed", "buyback_retired", "buyback_status", "buyback_timing", "score_basis", "source_plan_id"]
    gap = gap if gap is not None else none("execution_score double, progress_rate double, washing_flag boolean, buyback_executed boolean, buyback_retired boolean, buyback_status string, buyback_timing string, score_basis string, source_plan_id long")
    mna = mna if mna is not None else none("mna_target_score double, population_basis string")
    opacity = opacity if opacity is not None else none("opacity_rank double, opacity_count int, opacity_basis string")
    g = gap.select("corp_code", *own, F.col("as_of").alias("g"))
    m = mna.select("corp_code", "mna_target_score", "population_basis", F.col("as_of").alias("m"))
    o = opacity.select("corp_code", "opacity_rank", "opacity_count", "opacity_basis", F.col("as_of").alias("o"))
    x = company.join(g, "corp_code", "left").join(m, "corp_code", "left").join(o, "corp_code", "left").where("coalesce(g, m, o) IS NOT NULL")
    x = x.join(metrics_d.select("corp_code", "roe", "pbr", "ev_ebit", "debt_ratio", "total_return_ratio", "retired_return_ratio"), "corp_code", "left").join(price, "corp_code", "left")
    # the plan and its smallest gap come by the plan's id
    x = x.join(lowest, "source_plan_id", "left").join(plans, "source_plan_id", "left")
    flags = {"as_of": F.coalesce("g", "m", "o"), "has_valueup": F.col("g").isNotNull(), "has_mna": F.col("m").isNotNull(), "has_opacity": F.col("o").isNotNull()}
    return x.withColumns(flags).drop("g", "m", "o", "stock_code")


def matching_presets(rows: DataFrame, presets: dict[str, ScreenFilter] | None = None) -> DataFrame:
    """The rows of each preset that they pass, in one pass: rows with `preset`, one for each."""
    passed = []
    for name, f in (PRESETS if presets is None else presets).items():
        hit = F.lit(True)
        for c in f.conditions():
            hit = hit & c
        passed.append(F.when(hit, F.lit(name)))
    return rows.withColumn("preset", F.explode(F.array_compact(F.array(*passed))))


def screen(rows: DataFrame, f: ScreenFilter, sort: str | None = None, page: int = 1, size: int = 20) -> Page:
    return paged(where_all(rows, f.conditions()), sort_keys(sort, SCREEN_SORTS, ["corp_code"]), page, size)


def market_comparison(company: DataFrame, metrics_d: DataFrame, gap: DataFrame) -> DataFrame:
    """A row for each supported market on either side: averages over finite values, and judged and flagged plans."""
    c = company.where(F.col("market").isin(SUPPORTED_MARKETS)).select("corp_code", "market")
    a = metrics_d.join(c, "corp_code").groupBy("market").agg(F.count("*").alias("n_companies"), *(F.round(F.avg(finite(m)), 6).alias(f"avg_{m}") for m in ("roe", "pbr", "ev_ebit")))
    b = gap.join(c, "corp_code").groupBy("market").agg(F.count("washing_flag").alias("n_judged"), F.count_if("washing_flag").alias("n_washing"))
    j = a.join(b, "market", "full")
    return j.withColumn("washing_ratio", F.when(F.col("n_judged") > 0, F.round(F.col("n_washing") / F.col("n_judged"), 6)))


def market_summary(company: DataFrame, gap: DataFrame, mna: DataFrame) -> DataFrame:
    """One row of totals; companies count in every market, scores in the supported ones. No scores, no row."""
    c = company.select("corp_code", "market")
    ok = F.col("market").isin(SUPPORTED_MARKETS)
    x = c.join(gap.select("corp_code", "execution_score", "washing_flag", F.lit(1).alias("g")), "corp_code", "left").join(mna.select("corp_code", "mna_target_score"), "corp_code", "left")
    out = x.agg(
        F.count("*").alias("n_companies"),
        F.count_if(ok & F.col("g").isNotNull()).alias("n_plans"),
        F.count(F.when(ok, F.col("execution_score"))).alias("n_scored"),
        F.count_if(ok & F.col("washing_flag")).alias("n_washing"),
        F.round(F.avg(F.when(ok, F.col("mna_target_score"))), 6).alias("avg_mna"),
    )
    return out.where("n_plans > 0")


def macro_snapshot(macro: DataFrame, as_of: str | None = None) -> DataFrame:
    """Four rows, one for each indicator slot: the latest observation up to a day, even if its value is null."""
    spark = macro.sparkSession
    rows = macro if as_of is None else macro.where(F.col("date") <= as_of)
    last = rows.groupBy("indicator").agg(F.max_by(F.struct("date", "value", "frequency"), "date").alias("r")).select("indicator", "r.*").withColumn("value", finite("value"))
    slots = spark.sql("SELECT explode(array(" + ", ".join(f"'{m}'" for m in MACRO_SLOTS) + ")) AS indicator")
    return slots.join(last, "indicator", "left")


def returns_breakdown(financials: DataFrame, metrics: DataFrame) -> DataFrame:
    """Annual reports with what was paid, bought and retired, and its ratios."""
    return financials.where("quarter = 4").select("corp_code", "year", "quarter", "dividend_total", "buyback_amount_krw", "buyback_retired_krw").join(metrics.select("corp_code", "year", "quarter", "payout_ratio", "total_return_ratio", "retired_return_ratio"), ["corp_code", "year", "quarter"], "left").drop("quarter")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and non-null counts of each column, in one pass: (column, n, known)."""
    one = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    return one.select("n", F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', `{c}`" for c in columns) + ") AS (column, known)")).select("column", "n", "known")


def payout_axis(gap: DataFrame, plans: DataFrame, metrics_d: DataFrame) -> DataFrame:
    """Uncapped achievement of the return promise: total return first; a target of zero falls through to the payout."""
    x = gap.select("corp_code", F.col("source_plan_id").alias("plan_id")).join(plans.select("plan_id", "target_total_return_ratio", "target_payout_ratio"), "plan_id").join(metrics_d.select("corp_code", "total_return_ratio", "payout_ratio"), "corp_code", "left")
    total, payout = F.coalesce(F.col("target_total_return_ratio") != 0, F.lit(False)), F.coalesce(F.col("target_payout_ratio") != 0, F.lit(False))
    target = F.when(total, F.col("target_total_return_ratio")).when(payout, F.col("target_payout_ratio"))
    actual = F.when(total, F.col("total_return_ratio")).when(payout, F.col("payout_ratio"))
    return x.select("corp_code", F.when(total, "total_return").when(payout, "payout").alias("axis"), target.alias("target"), actual.alias("actual"), F.round(F.when(target > 0, actual / target), 3).alias("achievement"))


def return_composition(breakdown: DataFrame, last_n: int = 5, jump_pp: float = 10.0) -> DataFrame:
    """Shares of dividend, buyback and retirement in what was returned, and jumps of the total return ratio, over the last years."""
    from pyspark.sql import Window

    w = Window.partitionBy("corp_code").orderBy(F.desc("year"))
    x = breakdown.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last_n)
    before = F.lag("total_return_ratio").over(Window.partitionBy("corp_code").orderBy("year"))
    paid = F.col("dividend_total") + F.col("buyback_amount_krw")
    share = lambda c: F.round(F.when(paid > 0, c * 100.0 / paid), 2)
    retired = F.when(F.col("buyback_retired_krw").isNotNull() & F.col("buyback_amount_krw").isNotNull(), F.least("buyback_retired_krw", "buyback_amount_krw"))
    return x.select("corp_code", "year", share(F.col("dividend_total")).alias("dividend_share"), share(F.col("buyback_amount_krw")).alias("bought_share"), share(retired).alias("retired_share"), (F.abs(F.col("total_return_ratio") - before) >= jump_pp).alias("jump"))


def investment_tags(rows: DataFrame) -> DataFrame:
    """Tags that known values earn; an unknown value earns none."""
    tags = {"high_roe": F.col("roe") >= 10, "low_pbr": F.col("pbr") <= 1, "retired_buyback": F.col("buyback_status") == "retired", "cheap": F.col("valuation_score") >= 0.7, "able": F.col("capacity_score") >= 0.7, "open_ownership": F.col("ownership_score") >= 0.7}
    return rows.withColumn("tags", F.concat_ws(",", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tags.items())))))


def cell_status(rows: DataFrame) -> DataFrame:
    """Why each score cell of a screening row is empty, or ok: valueup_status, mna_status, opacity_status.

    An engine that was not run differs from a value that is unknown. The acquisition score does not fit banks and insurers.
    An opacity rank may be missing because the plan is in another metric, or for the plan's unrankable reason; `unstated`
    and no reason are plainly unranked.
    """
    special = F.startswith("sector", F.lit("641")) | F.startswith("sector", F.lit("65"))
    valueup = F.when(~F.col("has_valueup"), "not_run").when(F.col("execution_score").isNull(), "unknown").otherwise("ok")
    mna = F.when(~F.col("has_mna"), "not_run").when(F.col("mna_target_score").isNotNull(), "ok").when(special, "unsupported_sector").otherwise("unknown")
    named = F.when(F.col("unrankable_reason").isin("undisclosed", "unreadable", "notice"), F.col("unrankable_reason"))
    opacity = F.when(F.col("has_opacity") & F.col("opacity_rank").isNotNull(), "ok").when(F.col("plan_body_signal") == "other_metric", "other_metric").otherwise(F.coalesce(named, F.lit("unranked")))
    return rows.withColumns({"valueup_status": valueup, "mna_status": mna, "opacity_status": opacity})


def resolve_days(gap_days: DataFrame, mna_days: DataFrame, requested: DataFrame, date_col: str = "as_of") -> DataFrame:
    """(requested, as_of, error, warning): the day of a snapshot for each request (null: the latest day of both engines).

    A requested day must be in both engines' tables: else as_of is null and error names those that lack it. Without a
    request, no common day is the error `no_common_day`, and an engine with a newer day is a warning, as that day
    is not in the snapshot. Several engines are comma-joined. One aggregate of the days, joined to the requests.
    """
    days = gap_days.select(F.col(date_col).alias("day"), F.lit(1).alias("g"), F.lit(0).alias("m")).unionByName(mna_days.select(F.col(date_col).alias("day"), F.lit(0).alias("g"), F.lit(1).alias("m")))
    each = days.where("day IS NOT NULL").groupBy("day").agg(F.max("g").alias("g"), F.max("m").alias("m"))
    last = lambda c: F.max(F.when(c, F.col("day")))
    whole = each.agg(last((F.col("g") == 1) & (F.col("m") == 1)).alias("common"), last(F.col("g") == 1).alias("last_g"), last(F.col("m") == 1).alias("last_m"))
    x = requested.join(each.withColumnRenamed("day", "requested"), "requested", "left").crossJoin(F.broadcast(whole))
    asked, g, m = F.col("requested").isNotNull(), F.coalesce("g", F.lit(0)) == 1, F.coalesce("m", F.lit(0)) == 1
    lacking = F.concat_ws(",", F.when(~g, "valueup"), F.when(~m, "mna"))
    newer = F.concat_ws(",", F.when(F.col("last_g") > F.col("common"), "valueup"), F.when(F.col("last_m") > F.col("common"), "mna"))
    return x.select(
        "requested",
        F.when(asked & g & m, F.col("requested")).when(~asked, F.col("common")).alias("as_of"),
        F.when(asked, F.when(lacking != "", F.concat(F.lit("missing:"), lacking))).when(F.col("common").isNull(), "no_common_day").alias("error"),
        F.when(~asked & (newer != ""), F.concat(F.lit("newer:"), newer)).alias("warning"),
    )


def latest_common_as_of(a: DataFrame, b: DataFrame, date_col: str = "as_of") -> DataFrame:
    """The latest date that both tables have."""
    return a.select(date_col).distinct().join(b.select(date_col).distinct(), date_col, "left_semi").agg(F.max(date_col).alias(date_col))


def latest_any_as_of(*tables: DataFrame, date_col: str = "as_of") -> DataFrame:
    """The latest date of any table; tables without rows are passed over."""
    out = tables[0].agg(F.max(date_col).alias(date_col))
    for t in tables[1:]:
        out = out.unionByName(t.agg(F.max(date_col).alias(date_col)))
    return out.agg(F.max(date_col).alias(date_col))


def snapshot_views(company: DataFrame, gap: DataFrame, metrics_d: DataFrame, metrics: DataFrame, financials: DataFrame, macro: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The five tables of a published snapshot."""
    head = company.select("corp_code", "stock_code", "corp_name", "market", "sector")
    known = financials.where(known_at(as_of)).select("corp_code", "year", "quarter", "dividend_total", "buyback_amount", "buyback_retired_amount")
    return {
        "valueup_scores": gap.join(head, "corp_code").select("corp_code", "corp_name", "market", "execution_score", "progress_rate", "achievement_rate", "washing_flag", "buyback_status", "score_basis"),
        "sector_valuation_map": head.join(metrics_d.select("corp_code", "pbr", "per", "ev_ebit"), "corp_code").select("corp_code", "sector", "market", "pbr", "per", "ev_ebit"),
        "roe_pbr_scatter": head.join(metrics_d.select("corp_code", "roe", "pbr"), "corp_code").where("roe IS NOT NULL OR pbr IS NOT NULL").select("corp_code", "market", "roe", "pbr"),
        "dividend_buyback": known.join(metrics.select("corp_code", "year", "quarter", "payout_ratio", "total_return_ratio"), ["corp_code", "year", "quarter"], "left").select("corp_code", "year", "quarter", "dividend_total", "payout_ratio", "total_return_ratio", F.expr("CASE WHEN buyback_retired_amount > 0 THEN 'retired' WHEN buyback_amount > 0 THEN 'purchased_only' WHEN buyback_amount IS NOT NULL OR buyback_retired_amount IS NOT NULL THEN 'none' END").alias("period_status")),
        "macro_layer": macro.select("indicator", "date", "value", "frequency"),
    }


def unscored_kpi(view: DataFrame) -> DataFrame:
    return view.agg(F.count("execution_score").alias("n_scored"), F.count_if(F.col("execution_score").isNull()).alias("n_unscored"))
