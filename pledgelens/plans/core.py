"""Queries over ratios, scores, screening and statistics, each with its DuckDB oracle."""

from __future__ import annotations

import hashlib
import inspect
import uuid
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.functions import text, values
from pledgelens.functions.values import cap_bucket, period_buyback_status, sector_bucket
from pledgelens.operators import batch as B
from pledgelens.operators import metrics as M
from pledgelens.operators import rank as R
from pledgelens.operators import scores as S
from pledgelens.operators import screening as X
from pledgelens.plans.oracle import AS_OF, AXES, BUCKET, KNOWN, ranked, with_tables
from pledgelens.sources import domain
from pledgelens.sources.domain import Tables, domain_tables, kept, state_of
from pledgelens.sources.store import Generations, shared_dir, written
from pledgelens.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(select: str | None = None, *needs: str):
    """Register a function of the domain tables, and its oracle."""

    def add(f):
        @wraps(f)
        def run(spark, sf_dir) -> DataFrame:
            return f(domain_tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if select is not None:
            ORACLES[f.__name__] = with_tables(select, *needs)
        return f

    return add


def vm(t: Tables) -> DataFrame:
    return M.valuation_metrics(t.financials, t.prices)


def vmd(t: Tables) -> DataFrame:
    return M.reports_as_of(vm(t), AS_OF)


def gap(t: Tables, metrics_d: DataFrame | None = None) -> DataFrame:
    return S.valueup_score(S.choose_plans(t.valueup_plan, AS_OF), vmd(t) if metrics_d is None else metrics_d, M.reports_as_of(t.financials, AS_OF), AS_OF)


def mna(t: Tables, metrics_d: DataFrame | None = None) -> DataFrame:
    return S.mna_score(vmd(t) if metrics_d is None else metrics_d, M.latest_as_of(t.ownership, ["corp_code"], ["as_of"], AS_OF, "as_of"), t.company, t.macro_indicator, AS_OF)


def opacity(t: Tables) -> DataFrame:
    return S.opacity_score(S.choose_plans(t.valueup_plan, AS_OF), t.company, AS_OF)


def day_facts(t: Tables) -> tuple[Tables, DataFrame]:
    """The tables with the reports written once, and the day's metrics, written once too, for queries over several scores."""
    t = kept(t, "financials")
    return t, written(vmd(t))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("SELECT * FROM vm", "vm")
def valuation_metrics(t):
    return vm(t)


@query("SELECT m.*, c.corp_name, c.market, c.sector FROM vm m JOIN company c USING (corp_code) WHERE market = 'KOSPI' AND roe >= 5 ORDER BY roe DESC NULLS LAST, corp_code, year, quarter LIMIT 50 OFFSET 50", "vm", "company")
def metrics_list_page(t):
    return X.list_metrics(vm(t), t.company, market="KOSPI", min_roe=5.0, sort="-roe", page=2, size=50).items


@query("SELECT * FROM vm WHERE corp_code IN (SELECT corp_code FROM company WHERE market = 'KOSDAQ')", "vm", "company")
def metrics_history(t):
    return vm(t).join(t.company.where("market = 'KOSDAQ'").select("corp_code"), "corp_code", "left_semi")


@query(f"SELECT corp_code, year, CASE WHEN buyback_retired_amount > 0 THEN 'retired' WHEN buyback_amount > 0 THEN 'purchased_only' WHEN buyback_amount IS NOT NULL OR buyback_retired_amount IS NOT NULL THEN 'none' END AS status FROM financials", "financials")
def buyback_status_by_period(t):
    return t.financials.select("corp_code", "year", period_buyback_status("buyback_amount", "buyback_retired_amount").alias("status"))


@query("SELECT corp_code, market_cap FROM prices QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY date DESC) = 1", "prices")
def latest_price(t):
    return M.latest_price(t.prices)


@query("SELECT * FROM vmd", "vmd")
def metrics_as_of(t):
    return vmd(t)


@query("SELECT * FROM own", "own")
def ownership_as_of(t):
    return M.latest_as_of(t.ownership, ["corp_code"], ["as_of"], AS_OF, "as_of")


@query("SELECT * FROM own_gap", "own_gap")
def plan_own_gap(t):
    return M.plan_own_gap(t.valueup_plan, vm(t))


@query("SELECT * FROM peers", "peers")
def peer_medians(t):
    return M.peer_medians(vm(t), t.company)


@query(f"""SELECT g.plan_id, g.metric, g.target, g.baseline_year, g.own_past, g.own_gap, b.bucket, p.peer_n, p.peer_median, round(g.target - p.peer_median, 2) AS peer_gap
FROM own_gap g JOIN valueup_plan v USING (plan_id) LEFT JOIN (SELECT corp_code, {BUCKET} AS bucket FROM company) b ON b.corp_code = g.corp_code
LEFT JOIN peers p ON p.bucket = b.bucket AND p.metric = g.metric AND p.year = coalesce(g.baseline_year, cast(substr(v.disclosure_date, 1, 4) AS int) - 1)""", "own_gap", "peers", "company")
def ambition(t):
    return M.ambition(t.valueup_plan, vm(t), t.company)


@query(f"SELECT corp_code, roe, {ranked('vmd', 'roe', '1', 'pct', False)} FROM vmd", "vmd")
def mid_rank_market(t):
    return R.mid_rank(vmd(t).select("corp_code", "roe"), "roe", "pct")


@query(f"SELECT corp_code, bucket, pbr, {ranked('x', 'pbr', 'bucket', 'pct', True)} FROM (SELECT corp_code, pbr, {BUCKET} AS bucket FROM vmd LEFT JOIN company USING (corp_code)) x", "vmd", "company")
def mid_rank_sector(t):
    rows = vmd(t).select("corp_code", "pbr").join(t.company.select("corp_code", sector_bucket("sector").alias("bucket")), "corp_code", "left")
    return R.mid_rank(rows, "pbr", "pct", [F.col("bucket")], True)


@query(f"""SELECT corp_code, bucket, coalesce(ready AND bucket IS NOT NULL, false) AS ready, CASE WHEN bucket IS NULL THEN 'market' WHEN ready THEN 'sector:' || bucket ELSE 'market_fallback' END AS basis
FROM (SELECT corp_code, {BUCKET} AS bucket, least(count(ev_ebit) OVER w, count(pbr) OVER w, count(debt_ratio) OVER w, count(net_cash) OVER w, count(ebit_margin) OVER w) >= 5 AS ready FROM vmd LEFT JOIN company USING (corp_code) WINDOW w AS (PARTITION BY {BUCKET}))""", "vmd", "company")
def population_basis(t):
    rows = vmd(t).join(t.company.select("corp_code", sector_bucket("sector").alias("bucket")), "corp_code", "left")
    return R.population_basis(rows, [*S.VALUATION, *S.CAPACITY], "bucket").select("corp_code", "bucket", "ready", "basis")


@query("SELECT round(macro_score, 6) AS macro_score FROM macro", "macro")
def macro_percentile(t):
    return rounded(S.macro_score(t.macro_indicator, AS_OF), "macro_score")


@query("SELECT corp_code, plan_id, used_fallback FROM chosen", "chosen")
def chosen_plans(t):
    return S.choose_plans(t.valueup_plan, AS_OF).select("corp_code", "plan_id", "used_fallback")


@query("SELECT plan_id, axes, 4 - axes AS opacity_count, axes = 0 AS unrankable FROM cand", "cand")
def plan_axes(t):
    return t.valueup_plan.where(F.col("disclosure_date") <= AS_OF).select("plan_id", S.disclosed_axes().alias("axes")).selectExpr("plan_id", "axes", "4 - axes AS opacity_count", "axes = 0 AS unrankable")


GAP_ROUND = ["roe_gap", "achievement_rate", "progress_rate", "execution_score"]


@query("SELECT * REPLACE (round(roe_gap, 6) AS roe_gap, round(achievement_rate, 6) AS achievement_rate, round(progress_rate, 6) AS progress_rate, round(execution_score, 6) AS execution_score) FROM gap", "gap")
def valueup_score(t):
    return rounded(gap(t), *GAP_ROUND)


MNA_ROUND = ["mna_target_score", "valuation_score", "capacity_score", "ownership_score", "macro_score"]


@query("SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in MNA_ROUND) + ") FROM mna", "mna")
def mna_score(t):
    return rounded(mna(t), *MNA_ROUND)


@query("SELECT * REPLACE (round(opacity_rank, 6) AS opacity_rank) FROM opa", "opa")
def opacity_score(t):
    return rounded(opacity(t), "opacity_rank")


@query("""SELECT g.corp_code, c.corp_name, c.market, round(g.roe_gap, 6) AS roe_gap, g.washing_flag, p.disclosure_date, (SELECT max(disclosure_date) FROM cand x WHERE x.corp_code = g.corp_code) <> p.disclosure_date AS older_plan
FROM gap g JOIN company c USING (corp_code) LEFT JOIN valueup_plan p ON p.plan_id = g.source_plan_id WHERE c.market = 'KOSPI' AND g.progress_rate >= 0.1 ORDER BY g.roe_gap ASC NULLS LAST, g.corp_code LIMIT 100""", "gap", "company", "cand")
def gap_analysis_page(t):
    newest = t.valueup_plan.where(F.col("disclosure_date") <= AS_OF).groupBy("corp_code").agg(F.max("disclosure_date").alias("newest"))
    x = gap(t).join(t.company.where("market = 'KOSPI'"), "corp_code").where("progress_rate >= 0.1")
    x = x.join(t.valueup_plan.select(F.col("plan_id").alias("source_plan_id"), "disclosure_date"), "source_plan_id", "left").join(newest, "corp_code", "left")
    rows = x.select("corp_code", "corp_name", "market", F.round("roe_gap", 6).alias("roe_gap"), "washing_flag", "disclosure_date", (F.col("newest") != F.col("disclosure_date")).alias("older_plan"))
    return X.paged(rows, X.sort_keys("roe_gap", ["roe_gap"], ["corp_code"]), 1, 100).items


@query("SELECT m.corp_code, c.corp_name, round(m.mna_target_score, 6) AS mna_target_score, m.population_basis FROM mna m JOIN company c USING (corp_code) WHERE starts_with(c.sector, '2') ORDER BY m.mna_target_score DESC NULLS LAST, m.corp_code LIMIT 100", "mna", "company")
def mna_ranking_page(t):
    rows = mna(t).join(t.company.where("startswith(sector, '2')"), "corp_code").select("corp_code", "corp_name", F.round("mna_target_score", 6).alias("mna_target_score"), "population_basis")
    return X.paged(rows, X.sort_keys("-mna_target_score", ["mna_target_score"], ["corp_code"]), 1, 100).items


def score_store(t: Tables) -> str:
    """The folder of the scores over the present state of the base tables, by the present rules."""
    spark = t.company.sparkSession
    rules = "".join(inspect.getsource(m) for m in (domain, values, text, M, R, S, X, B))
    return f"{shared_dir(spark)}/scores-{state_of(spark, t.at)}-{hashlib.sha256(rules.encode()).hexdigest()[:16]}"


def screen_rows(t):
    """The stored day's screening rows; the day is scored and stored first where that has not been done for these tables."""
    spark, root = t.company.sparkSession, score_store(t)
    store = Generations(spark, root)
    if any(store.current(name, AS_OF) is None for name in (*B.ENGINES, *B.SERVED)):
        if failed := [x for r in B.serve_day(t, root, AS_OF) for x in r.failed]:
            raise ValueError("; ".join(failed))
    return B.stored_screening(spark, t.company, root, AS_OF)


@query("SELECT 'gap' AS engine, count(*) AS scored, 0 AS deleted, true AS publishable FROM gap UNION ALL SELECT 'mna', count(*), 0, true FROM mna UNION ALL SELECT 'opacity', count(*), 0, true FROM opa", "gap", "mna", "opa")
def score_batch(t):
    """A whole scoring run of the day into the store that the screening queries read, and what each engine did."""
    done = B.serve_day(t, score_store(t), AS_OF)
    rows = [(r.engine, r.scored, r.deleted, r.publishable) for r in done]
    return t.company.sparkSession.createDataFrame(rows, "engine string, scored long, deleted long, publishable boolean")


SCREEN = f"""(SELECT c.corp_code, c.corp_name, c.market, c.sector, g.execution_score, g.progress_rate, g.washing_flag, g.buyback_executed,
 g.buyback_retired, g.buyback_status, g.buyback_timing, g.score_basis, g.source_plan_id, p.body_signal AS plan_body_signal,
 p.disclosure_date AS plan_date, p.unrankable_reason, coalesce(g.as_of, m.as_of, o.as_of) AS as_of, m.mna_target_score,
 m.population_basis, o.opacity_rank, o.opacity_count, o.opacity_basis, v.roe, v.pbr, v.ev_ebit, v.debt_ratio, v.total_return_ratio,
 v.retired_return_ratio, q.market_cap, l.lowest_own_gap, g.corp_code IS NOT NULL AS has_valueup, m.corp_code IS NOT NULL AS has_mna,
 o.corp_code IS NOT NULL AS has_opacity
FROM company c LEFT JOIN gap g USING (corp_code) LEFT JOIN mna m USING (corp_code) LEFT JOIN opa o USING (corp_code) LEFT JOIN vmd v USING (corp_code)
LEFT JOIN (SELECT plan_id, body_signal, disclosure_date, CASE WHEN {AXES} > 0 THEN NULL WHEN plan_id % 12 = 0 THEN 'undisclosed'
  WHEN plan_id % 20 = 0 THEN 'unreadable' WHEN plan_id % 20 = 4 THEN 'notice' ELSE 'unstated' END AS unrankable_reason FROM valueup_plan) p ON p.plan_id = g.source_plan_id
LEFT JOIN (SELECT corp_code, market_cap FROM prices QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY date DESC) = 1) q USING (corp_code)
LEFT JOIN (SELECT g.corp_code, min(own_gap) AS lowest_own_gap FROM gap g JOIN own_gap x ON x.plan_id = g.source_plan_id WHERE own_gap IS NOT NULL GROUP BY 1) l USING (corp_code)
WHERE g.corp_code IS NOT NULL OR m.corp_code IS NOT NULL OR o.corp_code IS NOT NULL)"""
SCREEN_NEEDS = ("company", "gap", "mna", "opa", "vmd", "prices", "own_gap", "valueup_plan")
SCREEN_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("execution_score", "progress_rate", "mna_target_score", "opacity_rank"))


@query(f"SELECT * REPLACE ({SCREEN_ROUND}) FROM {SCREEN}", *SCREEN_NEEDS)
def screening_rows(t):
    return rounded(screen_rows(t), "execution_score", "progress_rate", "mna_target_score", "opacity_rank")


@query(f"SELECT corp_code, round(execution_score, 6) AS execution_score, score_basis FROM {SCREEN} WHERE starts_with(sector, '1') AND execution_score >= 10 AND total_return_ratio >= 1 ORDER BY execution_score DESC NULLS LAST, CASE WHEN coalesce(score_basis, '') = '' THEN 0 ELSE len(string_split(score_basis, '+')) END DESC, corp_code LIMIT 40", *SCREEN_NEEDS)
def screening_page(t):
    page = X.screen(screen_rows(t), X.ScreenFilter(sector="1", min_execution=10.0, min_total_return=1.0), "-execution_score", 1, 40)
    return page.items.select("corp_code", F.round("execution_score", 6).alias("execution_score"), "score_basis")


@query(f"SELECT 'opaque' AS preset, corp_code FROM {SCREEN} WHERE opacity_rank >= 0.7 UNION ALL SELECT 'modest_target', corp_code FROM {SCREEN} WHERE lowest_own_gap <= 0 UNION ALL SELECT 'bought_not_retired', corp_code FROM {SCREEN} WHERE buyback_status = 'purchased_only' AND total_return_ratio >= 40", *SCREEN_NEEDS)
def screening_presets(t):
    return X.matching_presets(screen_rows(t)).select("preset", "corp_code")


@query(f"""SELECT corp_code, CASE WHEN NOT has_valueup THEN 'not_run' WHEN execution_score IS NULL THEN 'unknown' ELSE 'ok' END AS valueup_status,
 CASE WHEN NOT has_mna THEN 'not_run' WHEN mna_target_score IS NOT NULL THEN 'ok' WHEN substr(sector, 1, 3) = '641' OR substr(sector, 1, 2) = '65' THEN 'unsupported_sector' ELSE 'unknown' END AS mna_status,
 CASE WHEN opacity_rank IS NOT NULL THEN 'ok' WHEN plan_body_signal = 'other_metric' THEN 'other_metric' WHEN unrankable_reason IN ('undisclosed', 'unreadable', 'notice') THEN unrankable_reason ELSE 'unranked' END AS opacity_status FROM {SCREEN}""", *SCREEN_NEEDS)
def cell_status(t):
    return X.cell_status(screen_rows(t)).select("corp_code", "valueup_status", "mna_status", "opacity_status")


@query("""SELECT c.corp_code, concat_ws(',', CASE WHEN v.roe >= 10 THEN 'high_roe' END, CASE WHEN v.pbr <= 1 THEN 'low_pbr' END, CASE WHEN g.buyback_status = 'retired' THEN 'retired_buyback' END, CASE WHEN m.valuation_score >= 0.7 THEN 'cheap' END, CASE WHEN m.capacity_score >= 0.7 THEN 'able' END, CASE WHEN m.ownership_score >= 0.7 THEN 'open_ownership' END) AS tags
FROM company c LEFT JOIN vmd v USING (corp_code) LEFT JOIN gap g USING (corp_code) LEFT JOIN mna m USING (corp_code)""", "company", "vmd", "gap", "mna")
def investment_tags(t):
    t, m = day_facts(t)
    x = t.company.select("corp_code").join(m.select("corp_code", "roe", "pbr"), "corp_code", "left").join(gap(t, m).select("corp_code", "buyback_status"), "corp_code", "left")
    return X.investment_tags(x.join(mna(t, m).select("corp_code", "valuation_score", "capacity_score", "ownership_score"), "corp_code", "left")).select("corp_code", "tags")


@query("SELECT CASE WHEN market_cap >= 10000000000000 THEN 'large' WHEN market_cap >= 1000000000000 THEN 'mid' WHEN market_cap IS NOT NULL THEN 'small' END AS bucket, count(*) AS n FROM (SELECT market_cap * 100000 AS market_cap FROM prices) GROUP BY 1", "prices")
def cap_buckets(t):
    return t.prices.select(cap_bucket(F.col("market_cap") * 100000).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT g.corp_code, min(own_gap) AS lowest_own_gap FROM gap g JOIN own_gap x ON x.plan_id = g.source_plan_id WHERE own_gap IS NOT NULL GROUP BY 1", "gap", "own_gap")
def lowest_own_gap(t):
    return X.lowest_own_gap(gap(t), M.plan_own_gap(t.valueup_plan, vm(t)))


@query("""SELECT coalesce(a.market, b.market) AS market, n_companies, avg_roe, avg_pbr, avg_ev_ebit, n_judged, n_washing, CASE WHEN n_judged > 0 THEN round(n_washing / cast(n_judged AS double), 6) END AS washing_ratio
FROM (SELECT market, count(*) AS n_companies, round(avg(roe), 6) AS avg_roe, round(avg(pbr), 6) AS avg_pbr, round(avg(ev_ebit), 6) AS avg_ev_ebit FROM vmd JOIN company USING (corp_code) WHERE market IN ('KOSPI', 'KOSDAQ') GROUP BY 1) a
FULL JOIN (SELECT market, count(washing_flag) AS n_judged, count(*) FILTER (WHERE washing_flag) AS n_washing FROM gap JOIN company USING (corp_code) WHERE market IN ('KOSPI', 'KOSDAQ') GROUP BY 1) b ON a.market = b.market""", "vmd", "company", "gap")
def market_comparison(t):
    return X.market_comparison(t.company, vmd(t), gap(t))


@query("""SELECT count(*) AS n_companies, count(*) FILTER (WHERE ok AND g.corp_code IS NOT NULL) AS n_plans, count(*) FILTER (WHERE ok AND execution_score IS NOT NULL) AS n_scored, count(*) FILTER (WHERE ok AND washing_flag) AS n_washing, round(avg(CASE WHEN ok THEN mna_target_score END), 6) AS avg_mna
FROM (SELECT corp_code, market IN ('KOSPI', 'KOSDAQ') AS ok FROM company) c LEFT JOIN gap g USING (corp_code) LEFT JOIN mna m USING (corp_code) HAVING count(*) FILTER (WHERE ok AND g.corp_code IS NOT NULL) > 0""", "company", "gap", "mna")
def market_summary(t):
    t, m = day_facts(t)
    return X.market_summary(t.company, gap(t, m), mna(t, m))


@query(f"SELECT s.indicator, m.date, m.value, m.frequency FROM (SELECT unnest(['base_rate', 'bond_3y', 'usd_krw', 'cpi']) AS indicator) s LEFT JOIN (SELECT * FROM macro_indicator WHERE date <= '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY indicator ORDER BY date DESC) = 1) m USING (indicator)", "macro_indicator")
def macro_snapshot(t):
    return X.macro_snapshot(t.macro_indicator, AS_OF)


BREAKDOWN = "(SELECT f.corp_code, f.year, f.dividend_total, f.buyback_amount_krw, f.buyback_retired_krw, v.payout_ratio, v.total_return_ratio, v.retired_return_ratio FROM financials f LEFT JOIN vm v ON v.corp_code = f.corp_code AND v.year = f.year AND v.quarter = f.quarter WHERE f.quarter = 4)"


@query(f"SELECT * FROM {BREAKDOWN}", "financials", "vm")
def returns_breakdown(t):
    return X.returns_breakdown(t.financials, vm(t))


@query(f"""SELECT corp_code, year, CASE WHEN d + b > 0 THEN round(d * 100.0e0 / (d + b), 2) END AS dividend_share, CASE WHEN d + b > 0 THEN round(b * 100.0e0 / (d + b), 2) END AS bought_share,
 CASE WHEN d + b > 0 AND r IS NOT NULL THEN round(least(r, b) * 100.0e0 / (d + b), 2) END AS retired_share, abs(total_return_ratio - lag(total_return_ratio) OVER (PARTITION BY corp_code ORDER BY year)) >= 10 AS jump
FROM (SELECT corp_code, year, dividend_total AS d, buyback_amount_krw AS b, buyback_retired_krw AS r, total_return_ratio FROM {BREAKDOWN} QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY year DESC) <= 5)""", "financials", "vm")
def return_composition(t):
    return X.return_composition(X.returns_breakdown(t.financials, vm(t)))


COVERED = ["roe", "roa", "pbr", "per", "ev_ebit", "debt_ratio", "payout_ratio", "total_return_ratio", "net_cash", "available_at"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count({c}) AS known FROM vm" for c in COVERED), "vm")
def metric_coverage(t):
    return X.coverage(vm(t), COVERED)


@query("""SELECT g.corp_code, CASE WHEN tr THEN 'total_return' WHEN pa THEN 'payout' END AS axis, CASE WHEN tr THEN target_total_return_ratio WHEN pa THEN target_payout_ratio END AS target, CASE WHEN tr THEN total_return_ratio WHEN pa THEN payout_ratio END AS actual,
 round(CASE WHEN tr AND target_total_return_ratio > 0 THEN total_return_ratio / target_total_return_ratio WHEN NOT tr AND pa AND target_payout_ratio > 0 THEN payout_ratio / target_payout_ratio END, 3) AS achievement
FROM gap g JOIN (SELECT *, coalesce(target_total_return_ratio <> 0, false) AS tr, coalesce(target_payout_ratio <> 0, false) AS pa FROM valueup_plan) p ON p.plan_id = g.source_plan_id LEFT JOIN vmd v ON v.corp_code = g.corp_code""", "gap", "valueup_plan", "vmd")
def payout_axis(t):
    return X.payout_axis(gap(t), t.valueup_plan, vmd(t))


SNAPSHOT = {
    "valueup_scores": ("SELECT g.corp_code, c.corp_name, c.market, round(execution_score, 6) AS execution_score, round(progress_rate, 6) AS progress_rate, round(achievement_rate, 6) AS achievement_rate, washing_flag, buyback_status, score_basis FROM gap g JOIN company c USING (corp_code)", ("gap", "company"), ("execution_score", "progress_rate", "achievement_rate")),
    "sector_valuation_map": ("SELECT corp_code, sector, market, pbr, per, ev_ebit FROM company JOIN vmd USING (corp_code)", ("company", "vmd"), ()),
    "roe_pbr_scatter": ("SELECT corp_code, market, roe, pbr FROM company JOIN vmd USING (corp_code) WHERE roe IS NOT NULL OR pbr IS NOT NULL", ("company", "vmd"), ()),
    "dividend_buyback": (f"SELECT f.corp_code, f.year, f.quarter, f.dividend_total, v.payout_ratio, v.total_return_ratio, CASE WHEN buyback_retired_amount > 0 THEN 'retired' WHEN buyback_amount > 0 THEN 'purchased_only' WHEN buyback_amount IS NOT NULL OR buyback_retired_amount IS NOT NULL THEN 'none' END AS period_status FROM (SELECT * FROM financials WHERE {KNOWN}) f LEFT JOIN vm v ON v.corp_code = f.corp_code AND v.year = f.year AND v.quarter = f.quarter", ("financials", "vm"), ()),
    "macro_layer": ("SELECT indicator, date, value, frequency FROM macro_indicator", ("macro_indicator",), ()),
}
for _name, (_sql, _needs, _round) in SNAPSHOT.items():

    def _view(t, name=_name, digits=_round):
        return rounded(X.snapshot_views(t.company, gap(t), vmd(t), vm(t), t.financials, t.macro_indicator, AS_OF)[name], *digits)

    _view.__name__ = f"snapshot_{_name}"
    query(_sql, *_needs)(_view)


@query("SELECT count(execution_score) AS n_scored, count(*) - count(execution_score) AS n_unscored FROM gap", "gap")
def unscored_kpi(t):
    return X.unscored_kpi(gap(t))


@query("SELECT max(as_of) AS as_of FROM (SELECT DISTINCT as_of FROM ownership INTERSECT SELECT DISTINCT substr(date, 1, 4) || '-12-31' FROM macro_indicator)", "ownership", "macro_indicator")
def latest_common_date(t):
    ends = t.macro_indicator.select(F.concat(F.substring("date", 1, 4), F.lit("-12-31")).alias("as_of"))
    return X.latest_common_as_of(t.ownership, ends)


G_DAYS = "(SELECT DISTINCT as_of AS day FROM ownership)"
M_DAYS = "(SELECT DISTINCT substr(date, 1, 4) || '-12-31' AS day FROM macro_indicator WHERE substr(date, 1, 4) <> '2001')"


@query(f"""SELECT * FROM (WITH g AS {G_DAYS}, m AS {M_DAYS}, r AS (SELECT DISTINCT substr(date, 1, 4) || '-12-31' AS requested FROM prices UNION ALL SELECT '2050-12-31' UNION ALL SELECT NULL),
b AS (SELECT max(day) AS common FROM (SELECT day FROM g INTERSECT SELECT day FROM m)),
x AS (SELECT requested, requested IN (SELECT day FROM g) AS in_g, requested IN (SELECT day FROM m) AS in_m, common, (SELECT max(day) FROM g) AS last_g, (SELECT max(day) FROM m) AS last_m FROM r, b)
SELECT requested, CASE WHEN requested IS NULL THEN common WHEN in_g AND in_m THEN requested END AS as_of,
 CASE WHEN requested IS NOT NULL THEN CASE WHEN NOT in_g AND NOT in_m THEN 'missing:valueup,mna' WHEN NOT in_g THEN 'missing:valueup' WHEN NOT in_m THEN 'missing:mna' END WHEN common IS NULL THEN 'no_common_day' END AS error,
 CASE WHEN requested IS NULL THEN CASE WHEN last_g > common AND last_m > common THEN 'newer:valueup,mna' WHEN last_g > common THEN 'newer:valueup' WHEN last_m > common THEN 'newer:mna' END END AS warning FROM x)""", "ownership", "macro_indicator", "prices")
def snapshot_days(t):
    """Each year's end in the prices, a day that no engine has, and no day, as requests."""
    year_end = F.concat(F.substring("date", 1, 4), F.lit("-12-31"))
    requested = t.prices.select(year_end.alias("requested")).distinct()
    more = t.company.sparkSession.createDataFrame([("2050-12-31",), (None,)], "requested string")
    mna_days = t.macro_indicator.where("substr(date, 1, 4) <> '2001'").select(year_end.alias("as_of"))
    return X.resolve_days(t.ownership, mna_days, requested.unionByName(more))


@query("SELECT greatest((SELECT max(as_of) FROM ownership), (SELECT max(date) FROM macro_indicator), (SELECT max(date) FROM prices)) AS as_of", "ownership", "macro_indicator", "prices")
def latest_any_date(t):
    return X.latest_any_as_of(t.ownership, t.macro_indicator.withColumnRenamed("date", "as_of"), t.prices.withColumnRenamed("date", "as_of"))


def fresh_dir(t: Tables, name: str) -> str:
    """A new folder for what a query writes."""
    return f"{shared_dir(t.company.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("SELECT corp_code, stock_code, corp_name, market, sector FROM company", "company")
def landed_companies(t):
    """The companies as a CSV landing, read with their schema: codes keep their leading zeros."""
    at = fresh_dir(t, "landed") + "/company.csv"
    t.company.write.option("header", True).csv(at)
    return read_table(t.company.sparkSession, "company", at)


@query("SELECT corp_code, as_of, largest_shareholder_pct, treasury_stock_pct FROM ownership", "ownership")
def landed_ownership(t):
    """The ownership rows as a JSON landing, read with their schema; what a row does not say is null."""
    at = fresh_dir(t, "landed") + "/ownership.json"
    t.ownership.write.json(at)
    return read_table(t.company.sparkSession, "ownership", at)


@query(" UNION ALL ".join(f"SELECT '{name}' AS \"view\", (SELECT count(*) FROM ({sql})) AS n" for name, (sql, _, _) in SNAPSHOT.items()), *sorted({n for _, needs, _ in SNAPSHOT.values() for n in needs}))
def published_snapshot(t):
    """The five views published as CSV and read back through the manifest: the rows of each."""
    spark, at = t.company.sparkSession, fresh_dir(t, "snapshot")
    t = kept(t, "financials")
    history = written(vm(t))
    m = written(M.reports_as_of(history, AS_OF))
    views = X.snapshot_views(t.company, gap(t, m), m, history, t.financials, t.macro_indicator, AS_OF)
    B.publish_snapshot(views, at, AS_OF, "now")
    counts = [B.read_snapshot(spark, at, name).agg(F.lit(name).alias("view"), F.count("*").alias("n")) for name in views]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT 'gap' AS engine, 1 AS scored, 0 AS deleted UNION ALL SELECT 'opacity', (SELECT count(*) FROM opa), 0", "opa")
def refreshed_company(t):
    """One company scored anew in a stored day, and all opacity ranked again: what each stage did."""
    at = fresh_dir(t, "refreshed")
    t = kept(t, "financials", "valueup_plan")
    history, chosen = written(vm(t)), written(S.choose_plans(t.valueup_plan, AS_OF))
    B.run_scoring(t, at, AS_OF, ("gap", "opacity"), metrics=history, chosen=chosen)
    corp = B.stored_scores(t.company.sparkSession, at, "gap", AS_OF).agg(F.min("corp_code")).first()[0]
    rows = [(r.engine, r.scored, r.deleted) for r in B.refresh_company(t, at, corp, metrics=history, chosen=chosen)]
    return t.company.sparkSession.createDataFrame(rows, "engine string, scored long, deleted long")
