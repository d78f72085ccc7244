"""Plan choice and the three scores: execution, acquisition target, opacity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgelens.functions.values import clamp01, sector_bucket
from pledgelens.operators.metrics import latest_as_of
from pledgelens.operators.rank import rank_few, rank_indicators
from pledgelens.sources.store import written


@dataclass(frozen=True)
class Config:
    w_achievement: float = 0.5
    w_buyback: float = 0.3
    w_payout: float = 0.2
    w_valuation: float = 0.35
    w_capacity: float = 0.25
    w_ownership: float = 0.25
    w_macro: float = 0.15
    progress_min: float = 0.5
    achievement_max: float = 0.6
    peer_min: int = 5

    def __post_init__(self):
        for group in ((self.w_achievement, self.w_buyback, self.w_payout), (self.w_valuation, self.w_capacity, self.w_ownership, self.w_macro)):
            if abs(sum(group) - 1) > 1e-6:
                raise ValueError(f"weights must sum to 1: {group}")


def axis_columns() -> dict[str, Column]:
    """Whether each axis of a plan is disclosed."""
    return {
        "roe": F.col("target_roe").isNotNull(),
        "payout": F.col("target_payout_ratio").isNotNull() | F.col("target_total_return_ratio").isNotNull(),
        "period": F.col("period_start").isNotNull(),
        "buyback": F.col("buyback_planned").isNotNull(),
    }


def disclosed_axes() -> Column:
    return sum((c.cast("int") for c in axis_columns().values()), F.lit(0))


def choose_plans(plans: DataFrame, as_of: str) -> DataFrame:
    """The plan in force of each company on a day, with used_fallback.

    Candidates go newest first. A reference to an older filing's date is followed, a refiling is passed over, and from
    there the first plan with a disclosed axis counts. All moves go to older plans, so one fold over the places does it;
    the array holds one company's disclosures, whole, so that the plans are read once. A plan_id names one plan.
    """
    rows = plans.where(F.col("disclosure_date") <= as_of).withColumn("axes", disclosed_axes())
    rest = [x for x in plans.columns if x not in ("corp_code", "plan_id")]
    item = F.struct(F.col("disclosure_date").alias("d"), F.col("plan_id").alias("id"), F.col("body_reference_date").alias("ref"), F.col("body_signal").alias("sig"), "axes", F.struct(*rest).alias("plan"))
    c = rows.groupBy("corp_code").agg(F.reverse(F.sort_array(F.collect_list(item))).alias("c"))
    follow = "try_element_at(filter(sequence(0, size(c) - 1), j -> j > k AND c[j].d = c[k].ref), 1)"
    step = f"CASE WHEN k <> cur THEN cur ELSE coalesce({follow}, CASE WHEN c[k].sig = 'refiling' AND k < size(c) - 1 THEN k + 1 END, cur) END"
    c = c.withColumn("cur", F.expr(f"aggregate(sequence(0, size(c) - 1), 0, (cur, k) -> {step})"))
    c = c.withColumn("pick", F.expr("coalesce(try_element_at(filter(sequence(0, size(c) - 1), j -> j >= cur AND c[j].axes > 0), 1), cur)"))
    chosen = c.select("corp_code", F.expr("c[pick]").alias("p"), F.expr("cur <> 0 OR pick <> cur").alias("used_fallback"))
    return chosen.where("corp_code IS NOT NULL AND p.id IS NOT NULL").select("corp_code", F.col("p.id").alias("plan_id"), "used_fallback", "p.plan.*")


TARGET_FIELDS = ["target_roe", "target_payout_ratio", "target_total_return_ratio", "target_pbr", "period_start", "period_end", "buyback_planned"]


def merge_attachments(plans: DataFrame, attachments: DataFrame) -> DataFrame:
    """Plans with the nulls that a usable attachment fills; the body wins. Of several attachments the newest counts."""
    ok = attachments.where("parse_error IS NULL AND NOT coalesce(needs_review, false)")
    last = ok.groupBy("plan_id").agg(F.max_by(F.struct(*TARGET_FIELDS), "attachment_id").alias("a"))
    j = plans.join(last, "plan_id", "left")
    filled = F.array_compact(F.array(*(F.when(F.col(f).isNull() & F.col(f"a.{f}").isNotNull(), F.lit(f)) for f in TARGET_FIELDS)))
    conflict = F.array_compact(F.array(*(F.when(F.col(f) != F.col(f"a.{f}"), F.lit(f)) for f in TARGET_FIELDS)))
    j = j.withColumn("filled_fields", filled).withColumn("conflict_fields", conflict)
    return j.withColumns({f: F.coalesce(F.col(f), F.col(f"a.{f}")) for f in TARGET_FIELDS}).drop("a")


def progress_rate(start: str, end: str, as_of: str) -> Column:
    """Share of the plan's days, from the first of its start year to the last of its end year, that have passed."""
    s, e = F.substring(start, 1, 4).try_cast("int"), F.substring(end, 1, 4).try_cast("int")
    first, last = F.concat(s.cast("string"), F.lit("-01-01")).cast("date"), F.concat(e.cast("string"), F.lit("-12-31")).cast("date")
    return clamp01(F.when(e > s, F.datediff(F.lit(as_of).cast("date"), first) / F.datediff(last, first)))


def valueup_score(chosen: DataFrame, metrics_d: DataFrame, financials_d: DataFrame, as_of: str, cfg: Config = Config()) -> DataFrame:
    """Execution of the plan in force against the latest known report, over committed axes only."""
    m = metrics_d.select("corp_code", F.col("roe").alias("actual_roe"), F.col("payout_ratio").alias("actual_payout"), F.col("total_return_ratio").alias("actual_total_return"))
    f = financials_d.select("corp_code", F.col("year").alias("fin_year"), "buyback_amount", "buyback_retired_amount", "buyback_amount_krw")
    x = chosen.join(m, "corp_code", "left").join(f, "corp_code", "left")
    ratio = lambda a, t: F.when(F.col(t) > 0, F.col(a) / F.col(t))
    x = x.withColumn("progress_rate", progress_rate("period_start", "period_end", as_of))
    x = x.withColumn("achievement_rate", F.when(F.col("progress_rate").isNotNull(), ratio("actual_roe", "target_roe")))
    bought = F.when(F.col("buyback_amount") >= 0, F.col("buyback_amount") > 0)
    x = x.withColumn("buyback_executed", F.when(F.col("buyback_amount_krw") > 0, True).otherwise(bought))
    x = x.withColumn("buyback_retired", F.when(F.col("buyback_retired_amount") >= 0, F.col("buyback_retired_amount") > 0))
    x = x.withColumn("buyback_status", F.when(F.col("buyback_executed").isNull() | F.col("buyback_retired").isNull(), "unknown").when(F.col("buyback_retired"), "retired").when(F.col("buyback_executed"), "purchased_only").otherwise("none"))
    x = x.withColumn("buyback_timing", F.expr("""CASE WHEN NOT coalesce(buyback_retired, false) OR fin_year IS NULL THEN NULL
        WHEN try_cast(substring(period_start, 1, 4) AS int) <= try_cast(substring(period_end, 1, 4) AS int)
          THEN CASE WHEN fin_year BETWEEN try_cast(substring(period_start, 1, 4) AS int) AND try_cast(substring(period_end, 1, 4) AS int) THEN 'in_period' ELSE 'outside_period' END
        WHEN fin_year > try_cast(substring(disclosure_date, 1, 4) AS int) THEN 'after_disclosure'
        WHEN fin_year < try_cast(substring(disclosure_date, 1, 4) AS int) THEN 'before_disclosure'
        WHEN try_cast(substring(disclosure_date, 1, 4) AS int) IS NOT NULL THEN 'same_year_unknown' END"""))
    committed = {
        "roe": (F.col("target_roe").isNotNull() & F.col("progress_rate").isNotNull(), cfg.w_achievement, clamp01(F.col("achievement_rate"))),
        "buyback": (F.coalesce("buyback_planned", F.lit(False)), cfg.w_buyback, F.col("buyback_executed").cast("double")),
        "total_return": (F.col("target_total_return_ratio").isNotNull(), cfg.w_payout, clamp01(ratio("actual_total_return", "target_total_return_ratio"))),
        "payout": (F.col("target_payout_ratio").isNotNull() & F.col("target_total_return_ratio").isNull(), cfg.w_payout, clamp01(ratio("actual_payout", "target_payout_ratio"))),
    }
    weight = sum((F.when(c, w).otherwise(0.0) for c, w, _ in committed.values()), F.lit(0.0))
    raw = sum((F.when(c, F.lit(w) * v).otherwise(0.0) for c, w, v in committed.values()), F.lit(0.0))  # null if a committed value is
    x = x.withColumn("execution_score", F.when(weight > 0, 100 * clamp01(raw / F.when(weight > 0, weight))))
    basis = F.concat_ws("+", *(F.when(c, F.lit(k)) for k, (c, _, _) in committed.items()))
    x = x.withColumn("score_basis", F.when(F.col("execution_score").isNotNull(), basis))
    x = x.withColumn("excluded_axes", F.when(F.col("target_roe").isNotNull() & F.col("progress_rate").isNull() & F.col("execution_score").isNotNull(), "roe:no_period"))
    washing = (F.col("progress_rate") >= cfg.progress_min) & (F.col("achievement_rate") < cfg.achievement_max) & F.col("buyback_planned") & ~F.col("buyback_retired")
    return x.select("corp_code", F.lit(as_of).alias("as_of"), "target_roe", "actual_roe", (F.col("actual_roe") - F.col("target_roe")).alias("roe_gap"), "achievement_rate", "progress_rate", "execution_score", washing.alias("washing_flag"), "buyback_executed", "buyback_retired", "buyback_status", "buyback_timing", "score_basis", "excluded_axes", F.col("plan_id").alias("source_plan_id"), "used_fallback")


def macro_score(macro: DataFrame, as_of: str, indicator: str = "base_rate") -> DataFrame:
    """One row: how low the indicator's latest value is within its own history up to a day; null where that is unknown."""
    rows = macro.where((F.col("indicator") == indicator) & (F.col("date") <= as_of))
    now = latest_as_of(rows, ["indicator"], ["date"], as_of, "date").select("indicator", F.col("value").alias("now"))
    past = rows.where("value IS NOT NULL AND NOT isnan(value)").join(now, "indicator")
    agg = past.agg(F.count_if(F.col("value") < F.col("now")).alias("below"), F.count_if(F.col("value") == F.col("now")).alias("equal"), F.count("*").alias("n"), F.max("now").alias("now"))
    rank = (F.col("below") + F.greatest(F.col("equal") - 1, F.lit(0)) / 2.0) / F.when(F.col("n") > 1, F.col("n") - 1)
    return agg.select(F.when(F.col("now").isNotNull(), 1.0 - rank).alias("macro_score"))


VALUATION = {"ev_ebit": True, "pbr": True}
CAPACITY = {"debt_ratio": True, "net_cash": False, "ebit_margin": False}
OWNERSHIP = {"largest_shareholder_pct": True, "treasury_stock_pct": False}


def indicator_rows(df: DataFrame, bucket: str, indicators: dict[str, bool]) -> DataFrame:
    """(corp_code, bucket, indicator, value): a row for each company and indicator."""
    named = ", ".join(f"'{c}', cast({c} AS double)" for c in indicators)
    return df.select("corp_code", F.expr(bucket).alias("bucket"), F.expr(f"stack({len(indicators)}, {named}) AS (indicator, value)"))


def mna_score(metrics_d: DataFrame, ownership_d: DataFrame, company: DataFrame, macro: DataFrame, as_of: str, cfg: Config = Config(), corp_codes: list[str] | None = None) -> DataFrame:
    """Acquisition attractiveness by peer percentiles. Populations hold all companies; a subset is cut last.

    All indicators of both tables are written once as one long table and ranked in one pass.
    """
    bucket = company.select("corp_code", sector_bucket("sector").alias("bucket"))
    inner = {**VALUATION, **CAPACITY}
    long = indicator_rows(metrics_d.select("corp_code", *inner).join(bucket, "corp_code", "left"), "bucket", inner)
    long = written(long.unionByName(indicator_rows(ownership_d, "cast(NULL AS string)", OWNERSHIP)))
    ranked = rank_indicators(long, ["corp_code"], {**inner, **OWNERSHIP}, list(inner), cfg.peer_min)
    mean = lambda names: sum((F.col(f"p_{c}") for c in names), F.lit(0.0)) / len(names)
    factors = ranked.select("corp_code", "basis", mean(VALUATION).alias("valuation_score"), mean(CAPACITY).alias("capacity_score"), mean(OWNERSHIP).alias("ownership_score"))
    x = company.select("corp_code").join(factors, "corp_code").withColumn("macro_score", macro_score(macro, as_of).scalar())
    total = 100 * (cfg.w_valuation * F.col("valuation_score") + cfg.w_capacity * F.col("capacity_score") + cfg.w_ownership * F.col("ownership_score") + cfg.w_macro * F.col("macro_score"))
    x = x.where("valuation_score IS NOT NULL OR capacity_score IS NOT NULL OR ownership_score IS NOT NULL")
    if corp_codes is not None:
        x = x.where(F.col("corp_code").isin(corp_codes))
    judged = F.expr("valuation_score IS NOT NULL OR capacity_score IS NOT NULL")
    return x.select("corp_code", F.lit(as_of).alias("as_of"), total.alias("mna_target_score"), "valuation_score", "capacity_score", "ownership_score", "macro_score", F.when(judged, F.col("basis")).alias("population_basis"))


def opacity_score(chosen: DataFrame, company: DataFrame, as_of: str, cfg: Config = Config()) -> DataFrame:
    """Percentile of the number of undisclosed axes among plans that disclose at least one."""
    x = chosen.withColumn("opacity_count", 4 - disclosed_axes()).where("opacity_count < 4")
    x = x.select("corp_code", "opacity_count").join(company.select("corp_code", sector_bucket("sector").alias("bucket")), "corp_code", "left")
    x = rank_few(x, "opacity_count", "opacity_rank", "bucket", cfg.peer_min)
    return x.where("opacity_rank IS NOT NULL").select("corp_code", F.lit(as_of).alias("as_of"), "opacity_rank", "opacity_count", F.col("basis").alias("opacity_basis"))
