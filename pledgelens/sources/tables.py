"""Fixed schemas of the base tables and their reader; nothing is inferred, so leading zeros stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "company": "corp_code string, stock_code string, corp_name string, market string, sector string",
    "financials": "corp_code string, year int, quarter int, fs_div string, revenue bigint, net_income bigint, operating_income bigint, depreciation bigint, equity bigint, total_assets bigint, total_liabilities bigint, cash bigint, total_debt bigint, dividend_total bigint, buyback_amount bigint, buyback_retired_amount bigint, buyback_amount_krw bigint, buyback_retired_krw bigint, available_at string",
    "prices": "corp_code string, date string, close bigint, volume bigint, trading_value bigint, market_cap bigint",
    "ownership": "corp_code string, as_of string, largest_shareholder_pct double, treasury_stock_pct double",
    "macro_indicator": "indicator string, date string, value double, frequency string",
    "valueup_plan": "plan_id bigint, corp_code string, disclosure_date string, rcept_no string, target_roe double, target_payout_ratio double, target_total_return_ratio double, target_pbr double, period_start string, period_end string, buyback_planned boolean, body_signal string, body_reference_date string, attachment_absent boolean, raw_text string",
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A base table with its schema; a CSV or JSON landing with a malformed row fails."""
    reader = spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST")
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    return reader.csv(path, header=True) if kind == "csv" else reader.json(path) if kind == "json" else reader.parquet(path)
