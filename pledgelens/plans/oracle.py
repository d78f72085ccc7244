"""DuckDB SQL building blocks: the domain tables and the derived tables that queries are compared with."""

from __future__ import annotations

from pledgelens.sources.domain import TABLE_SQL

AS_OF = "2001-03-31"
KNOWN = f"(CASE WHEN available_at IS NOT NULL THEN available_at <= '{AS_OF}' ELSE year < 2001 OR (year = 2001 AND quarter < 4) END)"
BUCKET = "CASE WHEN regexp_full_match(substr(trim(sector), 1, 2), '[0-9]{2}') THEN substr(trim(sector), 1, 2) END"


def guarded(n: str, d: str, factor: str = "1.0e0") -> str:
    return f"round(CASE WHEN {d} > 0 THEN cast({n} AS double) * {factor} / {d} END, 2)"


def ranked(source: str, value: str, group: str, out: str, low: bool) -> str:
    """Mid-rank by plain counting windows over all rows of `source`."""
    ok = f"{value} IS NOT NULL"
    n = f"count({value}) OVER (PARTITION BY {group})"
    rank = f"(rank() OVER (PARTITION BY {group}, {ok} ORDER BY {value}) - 1 + (count(*) OVER (PARTITION BY {group}, {ok}, {value}) - 1) / 2.0e0) / ({n} - 1)"
    return f"CASE WHEN {ok} AND {n} > 1 THEN {'1.0e0 - ' if low else ''}{rank} END AS {out}"


VM = f"""SELECT f.corp_code, f.year, f.quarter, f.available_at,
 {guarded('f.net_income', 'f.equity', '100.0e0')} AS roe, {guarded('f.net_income', 'f.total_assets', '100.0e0')} AS roa,
 {guarded('lp.market_cap', 'f.equity')} AS pbr, {guarded('lp.market_cap', 'f.net_income')} AS per,
 {guarded('(lp.market_cap + f.total_debt - f.cash)', 'f.operating_income')} AS ev_ebit,
 {guarded('f.total_liabilities', 'f.equity', '100.0e0')} AS debt_ratio, {guarded('f.dividend_total', 'f.net_income', '100.0e0')} AS payout_ratio,
 {guarded('(f.dividend_total + f.buyback_amount_krw)', 'f.net_income', '100.0e0')} AS total_return_ratio,
 {guarded('(f.dividend_total + f.buyback_retired_krw)', 'f.net_income', '100.0e0')} AS retired_return_ratio,
 {guarded('f.buyback_retired_krw', 'f.buyback_amount_krw', '100.0e0')} AS retirement_rate,
 f.cash - f.total_debt AS net_cash, {guarded('f.operating_income', 'f.revenue', '100.0e0')} AS ebit_margin,
 round((cast(f.revenue AS double) - lag(f.revenue) OVER w) * 100.0e0 / nullif(lag(f.revenue) OVER w, 0), 2) AS yoy_revenue_growth,
 round((cast(f.net_income AS double) - lag(f.net_income) OVER w) * 100.0e0 / nullif(lag(f.net_income) OVER w, 0), 2) AS yoy_income_growth
FROM financials f LEFT JOIN (SELECT corp_code, market_cap FROM (SELECT *, row_number() OVER (PARTITION BY corp_code ORDER BY date DESC) AS rn FROM prices) WHERE rn = 1) lp ON lp.corp_code = f.corp_code
WINDOW w AS (PARTITION BY f.corp_code, f.quarter ORDER BY f.year)"""

AXES = "cast(target_roe IS NOT NULL AS int) + cast(target_payout_ratio IS NOT NULL OR target_total_return_ratio IS NOT NULL AS int) + cast(period_start IS NOT NULL AS int) + cast(buyback_planned IS NOT NULL AS int)"

INNER = [("ev_ebit", True), ("pbr", True), ("debt_ratio", True), ("net_cash", False), ("ebit_margin", False)]


def _mna() -> str:
    per = ", ".join(ranked("mb", c, "1", f"w_{c}", low) + ", " + ranked("mb", c, "bucket", f"s_{c}", low) for c, low in INNER)
    pick = lambda c: f"(CASE WHEN ready AND bucket IS NOT NULL THEN s_{c} ELSE w_{c} END)"
    return f"""SELECT c.corp_code, '{AS_OF}' AS as_of, 100 * (0.35e0 * v + 0.25e0 * k + 0.25e0 * o + 0.15e0 * q.macro_score) AS mna_target_score, v AS valuation_score, k AS capacity_score, o AS ownership_score, q.macro_score,
 CASE WHEN v IS NOT NULL OR k IS NOT NULL THEN basis END AS population_basis
FROM company c LEFT JOIN (
 SELECT corp_code, basis, ({pick('ev_ebit')} + {pick('pbr')}) / 2 AS v, ({pick('debt_ratio')} + {pick('net_cash')} + {pick('ebit_margin')}) / 3 AS k FROM (
  SELECT corp_code, bucket, ready, CASE WHEN bucket IS NULL THEN 'market' WHEN ready THEN 'sector:' || bucket ELSE 'market_fallback' END AS basis, {per} FROM (
   SELECT m.*, {BUCKET} AS bucket, least({', '.join(f'count({c}) OVER (PARTITION BY {BUCKET})' for c, _ in INNER)}) >= 5 AS ready FROM vmd m LEFT JOIN company USING (corp_code)) mb)) m USING (corp_code)
LEFT JOIN (SELECT corp_code, (a + b) / 2 AS o FROM (SELECT corp_code, {ranked('own', 'largest_shareholder_pct', '1', 'a', True)}, {ranked('own', 'treasury_stock_pct', '1', 'b', False)} FROM own)) o USING (corp_code)
CROSS JOIN macro q WHERE v IS NOT NULL OR k IS NOT NULL OR o IS NOT NULL"""


GAP = f"""SELECT corp_code, '{AS_OF}' AS as_of, target_roe, actual_roe, actual_roe - target_roe AS roe_gap, achievement_rate, progress_rate,
 CASE WHEN w > 0 AND NOT unknown THEN 100 * greatest(0, least(1, raw / w)) END AS execution_score, washing_flag, buyback_executed, buyback_retired, buyback_status, buyback_timing,
 CASE WHEN w > 0 AND NOT unknown THEN basis END AS score_basis, CASE WHEN target_roe IS NOT NULL AND progress_rate IS NULL AND w > 0 AND NOT unknown THEN 'roe:no_period' END AS excluded_axes, plan_id AS source_plan_id, used_fallback
FROM (SELECT *,
  CASE WHEN c_roe THEN 0.5e0 ELSE 0 END + CASE WHEN c_buy THEN 0.3e0 ELSE 0 END + CASE WHEN c_tr OR c_pay THEN 0.2e0 ELSE 0 END AS w,
  (c_roe AND achievement_rate IS NULL) OR (c_buy AND buyback_executed IS NULL) OR (c_tr AND r_tr IS NULL) OR (c_pay AND r_pay IS NULL) AS unknown,
  CASE WHEN c_roe THEN 0.5e0 * greatest(0, least(1, achievement_rate)) ELSE 0 END + CASE WHEN c_buy AND buyback_executed THEN 0.3e0 ELSE 0 END + CASE WHEN c_tr THEN 0.2e0 * greatest(0, least(1, r_tr)) WHEN c_pay THEN 0.2e0 * greatest(0, least(1, r_pay)) ELSE 0 END AS raw,
  concat_ws('+', CASE WHEN c_roe THEN 'roe' END, CASE WHEN c_buy THEN 'buyback' END, CASE WHEN c_tr THEN 'total_return' WHEN c_pay THEN 'payout' END) AS basis,
  (progress_rate >= 0.5) AND (achievement_rate < 0.6) AND buyback_planned AND NOT buyback_retired AS washing_flag,
  CASE WHEN buyback_executed IS NULL OR buyback_retired IS NULL THEN 'unknown' WHEN buyback_retired THEN 'retired' WHEN buyback_executed THEN 'purchased_only' ELSE 'none' END AS buyback_status,
  CASE WHEN buyback_retired IS NOT TRUE OR fin_year IS NULL THEN NULL WHEN s <= e THEN CASE WHEN fin_year BETWEEN s AND e THEN 'in_period' ELSE 'outside_period' END
   WHEN fin_year > dy THEN 'after_disclosure' WHEN fin_year < dy THEN 'before_disclosure' WHEN dy IS NOT NULL THEN 'same_year_unknown' END AS buyback_timing
 FROM (SELECT *, coalesce(buyback_planned, false) AS c_buy, target_roe IS NOT NULL AND progress_rate IS NOT NULL AS c_roe, target_total_return_ratio IS NOT NULL AS c_tr, target_payout_ratio IS NOT NULL AND target_total_return_ratio IS NULL AS c_pay,
   CASE WHEN progress_rate IS NOT NULL AND target_roe > 0 THEN actual_roe / target_roe END AS achievement_rate,
   CASE WHEN target_total_return_ratio > 0 THEN total_return_ratio / target_total_return_ratio END AS r_tr, CASE WHEN target_payout_ratio > 0 THEN payout_ratio / target_payout_ratio END AS r_pay
  FROM (SELECT p.*, m.roe AS actual_roe, m.payout_ratio, m.total_return_ratio, f.year AS fin_year, cast(period_start AS int) AS s, cast(period_end AS int) AS e, cast(substr(disclosure_date, 1, 4) AS int) AS dy,
    CASE WHEN f.buyback_amount_krw > 0 THEN true WHEN f.buyback_amount >= 0 THEN f.buyback_amount > 0 END AS buyback_executed, CASE WHEN f.buyback_retired_amount >= 0 THEN f.buyback_retired_amount > 0 END AS buyback_retired,
    CASE WHEN cast(period_end AS int) > cast(period_start AS int) THEN greatest(0, least(1, date_diff('day', cast(period_start || '-01-01' AS date), date '{AS_OF}') / cast(date_diff('day', cast(period_start || '-01-01' AS date), cast(period_end || '-12-31' AS date)) AS double))) END AS progress_rate
   FROM chosen p LEFT JOIN vmd m ON m.corp_code = p.corp_code LEFT JOIN fin_d f ON f.corp_code = p.corp_code)))"""

OWN_GAP_BLOCKS = " UNION ALL ".join(
    f"""SELECT p.plan_id, p.corp_code, '{m}' AS metric, p.{t} AS target, coalesce(a.y, b.y) AS baseline_year, coalesce(a.v, b.v) AS own_past, round(p.{t} - coalesce(a.v, b.v), 2) AS own_gap
 FROM valueup_plan p LEFT JOIN (SELECT corp_code, year AS y, max_by({m}, quarter) AS v FROM vm WHERE {m} IS NOT NULL GROUP BY 1, 2) a ON a.corp_code = p.corp_code AND a.y = cast(substr(p.disclosure_date, 1, 4) AS int) - 1
 LEFT JOIN (SELECT corp_code, year AS y, max_by({m}, quarter) AS v FROM vm WHERE {m} IS NOT NULL GROUP BY 1, 2) b ON b.corp_code = p.corp_code AND b.y = cast(substr(p.disclosure_date, 1, 4) AS int) - 2 WHERE p.{t} IS NOT NULL"""
    for m, t in (("roe", "target_roe"), ("payout_ratio", "target_payout_ratio"), ("total_return_ratio", "target_total_return_ratio"))
)

PEERS = " UNION ALL ".join(
    f"SELECT {BUCKET} AS bucket, year, '{m}' AS metric, count({m}) AS peer_n, CASE WHEN count({m}) >= 5 THEN round(median(cast(round({m} * 100) AS bigint))) / 100 END AS peer_median FROM vm JOIN company USING (corp_code) WHERE {BUCKET} IS NOT NULL AND {m} IS NOT NULL GROUP BY 1, 2"
    for m in ("roe", "payout_ratio", "total_return_ratio")
)

#: Derived tables in an order in which each uses only those before it.
DERIVED = {
    "vm": VM,
    "vmd": f"SELECT * FROM vm WHERE {KNOWN} QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY year DESC, quarter DESC) = 1",
    "fin_d": f"SELECT * FROM financials WHERE {KNOWN} QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY year DESC, quarter DESC) = 1",
    "own": f"SELECT * FROM ownership WHERE as_of <= '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY as_of DESC) = 1",
    "cand": f"SELECT *, {AXES} AS axes, row_number() OVER (PARTITION BY corp_code ORDER BY disclosure_date DESC, plan_id DESC) - 1 AS k, count(*) OVER (PARTITION BY corp_code) AS n FROM valueup_plan WHERE disclosure_date <= '{AS_OF}'",
    "nxt": "SELECT a.corp_code, a.k, coalesce((SELECT min(b.k) FROM cand b WHERE b.corp_code = a.corp_code AND b.k > a.k AND b.disclosure_date = a.body_reference_date), CASE WHEN a.body_signal = 'refiling' AND a.k < a.n - 1 THEN a.k + 1 END) AS nk FROM cand a",
    "walk": "SELECT corp_code, k FROM cand WHERE k = 0 UNION ALL SELECT w.corp_code, x.nk FROM walk w JOIN nxt x ON x.corp_code = w.corp_code AND x.k = w.k WHERE x.nk IS NOT NULL",
    "cur": "SELECT corp_code, max(k) AS cur FROM walk GROUP BY 1",
    "pick": "SELECT corp_code, cur, coalesce((SELECT min(c.k) FROM cand c WHERE c.corp_code = cur.corp_code AND c.k >= cur.cur AND c.axes > 0), cur) AS pick FROM cur",
    "chosen": "SELECT c.* EXCLUDE (k, n, axes), p.cur <> 0 OR p.pick <> p.cur AS used_fallback, c.axes FROM cand c JOIN pick p ON p.corp_code = c.corp_code AND p.pick = c.k",
    "macro": f"SELECT CASE WHEN count(now) > 0 AND count(value) > 1 THEN 1.0e0 - (count(*) FILTER (WHERE value < now) + greatest(count(*) FILTER (WHERE value = now) - 1, 0) / 2.0e0) / (count(value) - 1) END AS macro_score FROM (SELECT value, (SELECT value FROM macro_indicator WHERE indicator = 'base_rate' AND date <= '{AS_OF}' ORDER BY date DESC LIMIT 1) AS now FROM macro_indicator WHERE indicator = 'base_rate' AND date <= '{AS_OF}')",
    "gap": GAP,
    "mna": _mna(),
    "opa_in": f"SELECT corp_code, 4 - axes AS opacity_count, {BUCKET} AS bucket, count(*) OVER (PARTITION BY {BUCKET}) >= 5 AS ready FROM chosen LEFT JOIN company USING (corp_code) WHERE axes > 0",
    "opa": f"SELECT corp_code, '{AS_OF}' AS as_of, CASE WHEN ready AND bucket IS NOT NULL THEN s ELSE w END AS opacity_rank, opacity_count, CASE WHEN bucket IS NULL THEN 'market' WHEN ready THEN 'sector:' || bucket ELSE 'market_fallback' END AS opacity_basis FROM (SELECT *, {ranked('opa_in', 'opacity_count', '1', 'w', False)}, {ranked('opa_in', 'opacity_count', 'bucket', 's', False)} FROM opa_in) WHERE CASE WHEN ready AND bucket IS NOT NULL THEN s ELSE w END IS NOT NULL",
    "own_gap": OWN_GAP_BLOCKS,
    "peers": PEERS,
}
NEEDS = {"walk": ["nxt", "cand"], "cur": ["walk"], "pick": ["cur"], "chosen": ["pick"], "gap": ["chosen", "vmd", "fin_d"], "mna": ["vmd", "own", "macro"], "opa": ["opa_in"], "opa_in": ["chosen"], "own_gap": ["vm"], "peers": ["vm"], "vmd": ["vm"], "nxt": ["cand"]}
BASE = {"vm": ["financials", "prices"], "fin_d": ["financials"], "own": ["ownership"], "cand": ["valueup_plan"], "own_gap": ["valueup_plan"], "opa_in": ["company"], "mna": ["company"], "macro": ["macro_indicator"], "peers": ["company"]}


def with_tables(select: str, *names: str) -> str:
    """The select behind the definitions of the named tables and all that these use."""
    todo, got = list(names), set()
    while todo:
        n = todo.pop()
        if n not in got:
            got.add(n)
            todo += NEEDS.get(n, []) + BASE.get(n, [])
    parts = [(n, s) for n, s in [*TABLE_SQL.items(), *DERIVED.items()] if n in got]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in parts) + "\n" + select
