"""Valuation ratios, point-in-time reads, own-past and peer baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pledgelens.functions.values import col, guarded, sector_bucket
from pledgelens.operators.rank import exact_medians


def latest_price(prices: DataFrame) -> DataFrame:
    """corp_code and the market cap of its last day; one shuffle with partial aggregates."""
    return prices.groupBy("corp_code").agg(F.max_by(F.struct("market_cap"), "date").alias("p")).select("corp_code", "p.market_cap")


def yoy(c: str) -> Column:
    """Growth over the row of the year before, per cent."""
    w = Window.partitionBy("corp_code", "quarter").orderBy("year")
    now, past = col(c).cast("double"), F.lag(c).over(w).cast("double")
    return F.round((now - past) * 100.0 / F.nullif(past, F.lit(0.0)), 2)


def valuation_metrics(financials: DataFrame, prices: DataFrame, price: DataFrame | None = None) -> DataFrame:
    """One row of ratios for each report; a denominator that is not above zero gives null.

    price: the rows of `latest_price`, where they are at hand.
    """
    f = financials.join(latest_price(prices) if price is None else price, "corp_code", "left")
    ev = F.col("market_cap") + F.col("total_debt") - F.col("cash")
    return f.select(
        "corp_code",
        "year",
        "quarter",
        "available_at",
        guarded("net_income", "equity", 100.0).alias("roe"),
        guarded("net_income", "total_assets", 100.0).alias("roa"),
        guarded("market_cap", "equity").alias("pbr"),
        guarded("market_cap", "net_income").alias("per"),
        guarded(ev, "operating_income").alias("ev_ebit"),
        guarded("total_liabilities", "equity", 100.0).alias("debt_ratio"),
        guarded("dividend_total", "net_income", 100.0).alias("payout_ratio"),
        guarded(F.col("dividend_total") + F.col("buyback_amount_krw"), "net_income", 100.0).alias("total_return_ratio"),
        guarded(F.col("dividend_total") + F.col("buyback_retired_krw"), "net_income", 100.0).alias("retired_return_ratio"),
        guarded("buyback_retired_krw", "buyback_amount_krw", 100.0).alias("retirement_rate"),
        (F.col("cash") - F.col("total_debt")).alias("net_cash"),
        guarded("operating_income", "revenue", 100.0).alias("ebit_margin"),
        yoy("revenue").alias("yoy_revenue_growth"),
        yoy("net_income").alias("yoy_income_growth"),
    )


def known_at(as_of: str, available_at: str = "available_at", year: str = "year", quarter: str = "quarter") -> Column:
    """Whether a report was known on a day: by its date if that is known, else by its year."""
    y = int(as_of[:4])
    return F.when(F.col(available_at).isNotNull(), F.col(available_at) <= as_of).otherwise((F.col(year) < y) | (F.col(year) == y) & (F.col(quarter) < 4))


def latest_as_of(df: DataFrame, keys: list[str], order: list[str], as_of: str, date_col: str) -> DataFrame:
    """The last row of each key up to a day, whatever its values are."""
    last = df.where(F.col(date_col) <= as_of).groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return last.select("r.*")


def reports_as_of(reports: DataFrame, as_of: str) -> DataFrame:
    """The latest known report of each company, even if a wanted value is null in it."""
    known = reports.where(known_at(as_of)).groupBy("corp_code").agg(F.max_by(F.struct(*reports.columns), F.struct("year", "quarter")).alias("r"))
    return known.select("r.*")


OWN_GAP_METRICS = [("roe", "target_roe"), ("payout_ratio", "target_payout_ratio"), ("total_return_ratio", "target_total_return_ratio")]


def plan_own_gap(plans: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each plan's disclosed targets against the company's own value one year (else two years) before the disclosure.

    One equi-join on the company; if a year has several reports the latest quarter counts.
    """
    long = plans.where("disclosure_date IS NOT NULL").select(
        "plan_id",
        "corp_code",
        F.substring("disclosure_date", 1, 4).try_cast("int").alias("dy"),
        F.expr("stack(3, " + ", ".join(f"'{m}', {t}" for m, t in OWN_GAP_METRICS) + ") AS (metric, target)"),
    )
    past = metrics.select("corp_code", "year", "quarter", F.expr("stack(3, " + ", ".join(f"'{m}', {m}" for m, _ in OWN_GAP_METRICS) + ") AS (metric, past)")).where("past IS NOT NULL")
    year = past.groupBy("corp_code", "year", "metric").agg(F.max_by("past", "quarter").alias("past"))
    base = long.where("target IS NOT NULL").withColumn("y", F.explode(F.array(F.col("dy") - 1, F.col("dy") - 2)))
    found = base.join(year.withColumnRenamed("year", "y"), ["corp_code", "metric", "y"], "left")
    keys = ["plan_id", "corp_code", "metric", "target"]
    out = found.groupBy(*keys).agg(F.max(F.when(F.col("past").isNotNull(), F.struct("y", "past"))).alias("b"))
    return out.select(*keys, F.col("b.y").alias("baseline_year"), F.col("b.past").alias("own_past"), F.round(F.col("target") - F.col("b.past"), 2).alias("own_gap"))


def peer_medians(metrics: DataFrame, company: DataFrame, min_n: int = 5) -> DataFrame:
    """Exact median of each metric (of its hundredths, so that halves round up) by sector bucket and year, null below `min_n` peers; the count is always there."""
    rows = metrics.join(company.select("corp_code", sector_bucket("sector").alias("bucket")), "corp_code").where("bucket IS NOT NULL")
    long = rows.select("bucket", "year", F.expr("stack(3, " + ", ".join(f"'{m}', {m}" for m, _ in OWN_GAP_METRICS) + ") AS (metric, value)")).where("value IS NOT NULL")
    hundredths = long.select("bucket", "year", "metric", F.round(F.col("value") * 100).cast("bigint").alias("_v"))
    out = exact_medians(hundredths, ["bucket", "year", "metric"])
    return out.select("bucket", "year", "metric", F.col("n").alias("peer_n"), F.when(F.col("n") >= min_n, F.round("median") / 100).alias("peer_median"))


def ambition(plans: DataFrame, metrics: DataFrame, company: DataFrame, min_n: int = 5) -> DataFrame:
    """A row for each plan and disclosed metric: gap to the own past and to the peers of the same baseline year."""
    gap = plan_own_gap(plans, metrics).join(plans.select("plan_id", (F.substring("disclosure_date", 1, 4).try_cast("int") - 1).alias("last_year")), "plan_id")
    gap = gap.join(company.select("corp_code", sector_bucket("sector").alias("bucket")), "corp_code", "left").withColumn("year", F.coalesce("baseline_year", "last_year"))
    return gap.join(peer_medians(metrics, company, min_n), ["bucket", "year", "metric"], "left").select("plan_id", "metric", "target", "baseline_year", "own_past", "own_gap", "bucket", "peer_n", "peer_median", F.round(F.col("target") - F.col("peer_median"), 2).alias("peer_gap"))
