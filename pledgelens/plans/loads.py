"""Queries over loads and statement rows, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from pledgelens.functions import values as V
from pledgelens.operators import loads as L
from pledgelens.operators import statements as T
from pledgelens.operators.scores import merge_attachments
from pledgelens.plans.oracle import with_tables
from pledgelens.sources.domain import domain_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str, *needs: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, domain_tables(spark, sf_dir))
        ORACLES[f.__name__] = with_tables(oracle, *needs) if needs else oracle
        return f

    return add


# landed texts, derived alike in both engines
TEXTS = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber WHEN 1 THEN '(' || cast(cast(l_quantity AS bigint) * 1234 AS varchar(20)) || ')' WHEN 2 THEN '-' WHEN 3 THEN '△ ' || cast(l_partkey AS varchar(20)) WHEN 4 THEN ' 1,234,' || cast(100 + cast(l_quantity AS int) AS varchar(20)) WHEN 5 THEN cast(l_suppkey AS varchar(20)) || '원' WHEN 6 THEN '' ELSE '−' || cast(l_orderkey AS varchar(20)) END AS amount,
 CASE l_linenumber WHEN 1 THEN '12.5%' WHEN 2 THEN ' 1,024.25 ' WHEN 3 THEN '-3.5' WHEN 4 THEN 'n/a' ELSE cast(cast(l_quantity AS int) AS varchar(20)) || '.5%' END AS ratio,
 CASE l_linenumber WHEN 1 THEN '20240229' WHEN 2 THEN '20230229' WHEN 3 THEN '202403' WHEN 4 THEN '2024' ELSE '20240' || cast(l_linenumber AS varchar(1)) || '15' END AS day FROM lineitem"""
AMOUNT = "(CASE WHEN regexp_full_match(t, '\\(.*\\)|[△▲−-].*') THEN -1 ELSE 1 END) * try_cast(nullif(CASE WHEN regexp_full_match(regexp_replace(regexp_replace(t, '^\\((.*)\\)$', '\\1'), '^[△▲−-]', ''), '[0-9]+') THEN regexp_replace(regexp_replace(t, '^\\((.*)\\)$', '\\1'), '^[△▲−-]', '') END, '') AS bigint)"


def texts(t):
    return t.sql(TEXTS)


@query(f"SELECT id, {AMOUNT} AS amount, CASE WHEN {AMOUNT} >= 0 THEN {AMOUNT} END AS quantity FROM (SELECT id, regexp_replace(amount, '[,\\s]', '', 'g') AS t FROM ({TEXTS}))")
def parse_amounts(spark, t):
    return texts(t).select("id", V.parse_amount("amount").alias("amount"), V.parse_quantity("amount").alias("quantity"))


@query(f"SELECT id, try_cast(regexp_replace(trim(ratio), '[,%]', '', 'g') AS double) AS ratio, CASE WHEN length(day) = 8 THEN strftime(try_strptime(day, '%Y%m%d'), '%Y-%m-%d') END AS iso, CASE length(day) WHEN 6 THEN substr(day, 1, 4) || '-' || substr(day, 5, 2) || '-01' WHEN 8 THEN substr(day, 1, 4) || '-' || substr(day, 5, 2) || '-' || substr(day, 7, 2) END AS macro_day FROM ({TEXTS})")
def parse_ratios_and_dates(spark, t):
    return texts(t).select("id", V.parse_ratio("ratio").alias("ratio"), V.to_iso("day").alias("iso"), V.macro_date("day").alias("macro_day"))


MACRO_LANDED = "SELECT CASE WHEN indicator = 'usd_krw' THEN 'other' ELSE indicator END AS indicator, replace(substr(date, 1, 7), '-', '') AS time, CASE WHEN value IS NULL THEN '-' ELSE cast(value AS varchar(20)) END AS data_value, frequency FROM macro_indicator"


@query(f"SELECT indicator, substr(time, 1, 4) || '-' || substr(time, 5, 2) || '-01' AS date, try_cast(nullif(data_value, '-') AS double) AS value, frequency FROM ({MACRO_LANDED}) WHERE indicator <> 'other'", "macro_indicator")
def normalize_macro(spark, t):
    return L.normalize_macro(t.sql(MACRO_LANDED))


@query("SELECT coalesce(a.corp_code, b.corp_code) AS corp_code, coalesce(a.date, b.date) AS date, a.close, a.volume, b.market_cap, b.trading_value FROM (SELECT * FROM prices WHERE close % 3 <> 0) a FULL JOIN (SELECT * FROM prices WHERE close % 5 <> 0) b ON a.corp_code = b.corp_code AND a.date = b.date", "prices")
def merge_prices(spark, t):
    return L.merge_prices(t.prices.where("close % 3 <> 0"), t.prices.where("close % 5 <> 0"))


INC = "(SELECT corp_code, date, CASE WHEN close % 2 = 0 THEN close + 1 END AS close, volume + 1 AS volume, trading_value, CASE WHEN close % 7 = 0 THEN market_cap END AS market_cap FROM prices WHERE close % 3 = 0 UNION ALL SELECT corp_code, '2002-01-01', 1, 1, NULL, max(market_cap) FROM prices GROUP BY corp_code)"


def incoming(t):
    new = t.prices.groupBy("corp_code").agg(F.max("market_cap").alias("market_cap")).selectExpr("corp_code", "'2002-01-01' AS date", "1L AS close", "1L AS volume", "cast(NULL AS bigint) AS trading_value", "market_cap")
    return t.prices.where("close % 3 = 0").selectExpr("corp_code", "date", "CASE WHEN close % 2 = 0 THEN close + 1 END AS close", "volume + 1 AS volume", "trading_value", "CASE WHEN close % 7 = 0 THEN market_cap END AS market_cap").unionByName(new)


@query(f"SELECT coalesce(i.corp_code, b.corp_code) AS corp_code, coalesce(i.date, b.date) AS date, coalesce(i.close, b.close) AS close, coalesce(i.volume, b.volume) AS volume, coalesce(i.trading_value, b.trading_value) AS trading_value, coalesce(i.market_cap, b.market_cap) AS market_cap FROM prices b FULL JOIN {INC} i ON i.corp_code = b.corp_code AND i.date = b.date", "prices")
def upsert_keep(spark, t):
    return L.upsert_keep(t.prices, incoming(t), ["corp_code", "date"])


@query(f"SELECT corp_code, date, close, CASE WHEN volume IS NULL THEN old ELSE volume END AS volume, trading_value, market_cap FROM (SELECT i.*, b.volume AS old FROM {INC} i LEFT JOIN prices b ON i.corp_code = b.corp_code AND i.date = b.date) UNION ALL SELECT b.* FROM prices b WHERE NOT EXISTS (SELECT 1 FROM {INC} i WHERE i.corp_code = b.corp_code AND i.date = b.date)", "prices")
def upsert_replace(spark, t):
    return L.upsert_replace(t.prices, incoming(t), ["corp_code", "date"], sticky=["volume"])


@query("SELECT * FROM ownership WHERE as_of <> '2000-12-31' OR corp_code NOT LIKE '%1' UNION ALL SELECT corp_code, as_of, largest_shareholder_pct + 1, treasury_stock_pct FROM ownership WHERE as_of = '2000-12-31' AND corp_code LIKE '%1' AND treasury_stock_pct > 5", "ownership")
def reconcile(spark, t):
    inc = t.ownership.where("as_of = '2000-12-31' AND treasury_stock_pct > 5").withColumn("largest_shareholder_pct", F.col("largest_shareholder_pct") + 1)
    return L.reconcile(t.ownership, inc, "2000-12-31", t.company.where("corp_code LIKE '%1'").select("corp_code"))


PARSED = "SELECT plan_id, cast(6 + plan_id % 16 AS double) AS target_roe, period_start FROM valueup_plan WHERE plan_id % 3 <> 1"


@query(f"SELECT v.plan_id, coalesce(v.target_roe, p.target_roe) AS target_roe, coalesce(v.period_start, p.period_start) AS period_start, p.target_roe <> v.target_roe AS conflict FROM valueup_plan v LEFT JOIN ({PARSED}) p USING (plan_id)", "valueup_plan")
def backfill_targets(spark, t):
    filled, conflicts = L.backfill_targets(t.valueup_plan, t.sql(PARSED), ["target_roe", "period_start"])
    flags = conflicts.where("field = 'target_roe'").select("plan_id", F.lit(True).alias("c"))
    known = t.valueup_plan.select("plan_id", F.col("target_roe").alias("old")).join(t.sql(PARSED).select("plan_id", F.col("target_roe").alias("new")), "plan_id", "left")
    x = filled.select("plan_id", "target_roe", "period_start").join(flags, "plan_id", "left").join(known, "plan_id")
    return x.select("plan_id", "target_roe", "period_start", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.coalesce("c", F.lit(False))).alias("conflict"))


ATTACH = """SELECT plan_id * 10 + j.k AS attachment_id, plan_id, 'f' || cast(plan_id AS varchar(20)) || '_' || cast(j.k AS varchar(2)) AS filename, cast(plan_id % 97 AS varchar(9)) AS sha256,
 CASE WHEN plan_id % 2 = 0 THEN cast(plan_id % 20 AS double) END AS target_roe, CASE WHEN plan_id % 3 = 0 THEN cast(plan_id % 50 AS double) END AS target_payout_ratio, cast(NULL AS double) AS target_total_return_ratio, cast(NULL AS double) AS target_pbr,
 CASE WHEN plan_id % 4 = 0 THEN '1999' END AS period_start, CASE WHEN plan_id % 4 = 0 THEN '2001' END AS period_end, CASE WHEN plan_id % 5 = 0 THEN true END AS buyback_planned,
 plan_id % 11 = 0 AS needs_review, CASE WHEN plan_id % 13 = 0 THEN 'no_text_layer' END AS parse_error, 'kim' AS reviewed_by, 'seen' AS review_note FROM valueup_plan CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) j WHERE plan_id % 7 < 3"""


def attachments(t):
    return t.sql(ATTACH)


FIELDS = ["target_roe", "target_payout_ratio", "period_start", "period_end", "buyback_planned"]


@query("SELECT v.plan_id, " + ", ".join(f"coalesce(v.{f}, a.{f}) AS {f}" for f in FIELDS) + ", concat_ws(',', " + ", ".join(f"CASE WHEN v.{f} IS NULL AND a.{f} IS NOT NULL THEN '{f}' END" for f in FIELDS) + ") AS filled, concat_ws(',', " + ", ".join(f"CASE WHEN v.{f} <> a.{f} THEN '{f}' END" for f in FIELDS) + f") AS conflicts FROM valueup_plan v LEFT JOIN (SELECT * FROM ({ATTACH}) WHERE parse_error IS NULL AND NOT needs_review QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY attachment_id DESC) = 1) a ON a.plan_id = v.plan_id", "valueup_plan")
def merge_attachments_into_plans(spark, t):
    x = merge_attachments(t.valueup_plan, attachments(t))
    return x.select("plan_id", *FIELDS, F.array_join("filled_fields", ",").alias("filled"), F.array_join("conflict_fields", ",").alias("conflicts"))


@query(f"SELECT coalesce(i.attachment_id, b.attachment_id) AS attachment_id, CASE WHEN i.sha256 <> b.sha256 THEN i.sha256 ELSE b.sha256 END AS sha256, CASE WHEN i.sha256 <> b.sha256 THEN NULL ELSE b.reviewed_by END AS reviewed_by FROM ({ATTACH}) b LEFT JOIN (SELECT * REPLACE (cast(plan_id % 2 AS varchar) || sha256 AS sha256) FROM ({ATTACH}) WHERE plan_id % 7 = 1 AND plan_id % 2 = 1) i ON i.plan_id = b.plan_id AND i.filename = b.filename", "valueup_plan")
def upsert_attachments(spark, t):
    base = attachments(t)
    inc = base.where("plan_id % 7 = 1 AND plan_id % 2 = 1").withColumn("sha256", F.concat(F.lit("1"), "sha256")).unionByName(base.where("plan_id % 7 = 2"))
    return L.upsert_attachments(base, inc).select("attachment_id", "sha256", "reviewed_by")


#: Decisions by the plan's number: what is decided (decision, overrides, reviewer, note), and by hand the fields that change
#: (SQL over the old row) or the errors.
DECISIONS: list[tuple[tuple[str, dict[str, str], str | None, str | None] | None, dict[str, str]]] = [
    (("approve", {}, "lee", None), {"review_note": "NULL"}),
    (("approve", {"target_roe": "9.5"}, "lee", "ok"), {"target_roe": "9.5", "review_note": "'ok | target_roe: ' || {target_roe} || ' -> 9.5'"}),
    (
        ("approve", {"buyback_planned": "YES", "target_roe": "none"}, "lee", ""),
        {"target_roe": "NULL", "buyback_planned": "true", "review_note": "'target_roe: ' || {target_roe} || ' -> none; buyback_planned: ' || {buyback_planned} || ' -> true'"},
    ),
    (
        ("approve", {"period_start": " 2024 ", "target_pbr": "1.25"}, "lee", None),
        {"period_start": "'2024'", "target_pbr": "1.25", "review_note": "'target_pbr: none -> 1.25; period_start: ' || {period_start} || ' -> 2024'"},
    ),
    (("reject", {}, "lee", "no"), {"parse_error": "'review_rejected:wrong year'", "review_note": "'no'"}),
    (("reject", {"target_roe": "1"}, "lee", None), {"errors": "overrides_without_approval"}),
    (("approve", {"target_roe": "9%", "buyback_planned": "maybe"}, "lee", None), {"errors": "bad_value:target_roe,bad_value:buyback_planned"}),
    (("approve", {"color": "red"}, "lee", None), {"errors": "unknown_field:color"}),
    (("approve", {}, " ", None), {"errors": "no_reviewer"}),
    (("perhaps", {}, "lee", None), {"errors": "unknown_decision"}),
    (None, {}),
]
REVIEWED = ["target_roe", "target_pbr", "period_start", "buyback_planned", "needs_review", "parse_error", "reviewed_by", "review_note"]


def _review_oracle() -> str:
    old = lambda text: text.format(**{f: f"coalesce(cast({f} AS varchar), 'none')" for f in ("target_roe", "buyback_planned", "period_start")})
    kinds = {"target_roe": "double", "target_pbr": "double", "buyback_planned": "boolean"}

    def column(f: str) -> str:
        cases = []
        for i, (decided, want) in enumerate(DECISIONS):
            if decided is None or "errors" in want:
                continue
            value = want.get(f, {"needs_review": "false", "reviewed_by": "'lee'"}.get(f, f))
            cases.append(f"WHEN {i} THEN cast({old(value)} AS {kinds.get(f, 'boolean' if f == 'needs_review' else 'varchar')})")
        return f"CASE plan_id % {len(DECISIONS)} {' '.join(cases)} ELSE {f} END AS {f}"

    return f"SELECT attachment_id, {', '.join(map(column, REVIEWED))} FROM ({ATTACH})"


def decisions(t):
    """The decisions over all attachments, as their kinds say."""
    kind, given = F.col("plan_id") % len(DECISIONS), [(i, d) for i, (d, _) in enumerate(DECISIONS) if d is not None]
    pick = lambda make: F.coalesce(*(F.when(kind == i, make(d)) for i, d in given))
    no_map = F.expr("cast(map() AS map<string, string>)")
    overrides = lambda d: F.create_map(*(F.lit(x) for kv in d[1].items() for x in kv)) if d[1] else no_map
    x = attachments(t).where(kind.isin([i for i, _ in given]))
    return x.select("filename", pick(lambda d: F.lit(d[0])).alias("decision"), pick(overrides).alias("overrides"), pick(lambda d: F.lit(d[2])).alias("reviewer"), pick(lambda d: F.lit(d[3])).alias("note"), F.lit("wrong year").alias("reason"), F.lit("2026-01-02").alias("day"))


@query(_review_oracle(), "valueup_plan")
def apply_reviews(spark, t):
    return L.apply_reviews(attachments(t), decisions(t))[0].select("attachment_id", *REVIEWED)


@query("SELECT filename, unnest(string_split(CASE plan_id % " + str(len(DECISIONS)) + " " + " ".join(f"WHEN {i} THEN '{w['errors']}'" for i, (_, w) in enumerate(DECISIONS) if "errors" in w) + f" END, ',')) AS error FROM ({ATTACH})", "valueup_plan")
def review_errors(spark, t):
    return L.apply_reviews(attachments(t), decisions(t))[1]


@query("SELECT 'length' AS rule, corp_code AS key FROM (SELECT CASE WHEN corp_code LIKE '%7' THEN substr(corp_code, 2) ELSE corp_code END AS corp_code FROM company) WHERE length(corp_code) <> 8 UNION ALL SELECT 'supported_market', CASE WHEN corp_code LIKE '%7' THEN substr(corp_code, 2) ELSE corp_code END FROM company WHERE market = 'KONEX' UNION ALL SELECT 'unique', k FROM (SELECT CASE WHEN corp_code LIKE '%7' THEN substr(corp_code, 2) ELSE corp_code END AS k FROM company) GROUP BY k HAVING count(*) > 1", "company")
def violations(spark, t):
    c = t.company.withColumn("corp_code", F.when(F.col("corp_code").like("%7"), F.substring("corp_code", 2, 7)).otherwise(F.col("corp_code")))
    return L.violations(c, {"length": F.length("corp_code") == 8, "supported_market": F.col("market") != "KONEX"}, ["corp_code"])


@query("SELECT DISTINCT corp_code FROM prices WHERE corp_code NOT IN (SELECT corp_code FROM company WHERE market = 'KOSPI')", "prices", "company")
def orphans(spark, t):
    return L.orphans(t.prices, t.company.where("market = 'KOSPI'"))


STATEMENTS = """SELECT lpad(cast(o_custkey AS varchar(20)), 8, '0') AS corp_code, year(o_orderdate) AS year, 4 AS quarter, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + cast(l_extendedprice * 100 AS bigint) % 1000 AS row_no,
 CASE WHEN o_custkey % 31 = 0 THEN NULL WHEN l_linenumber IN (1, 2) THEN 'BS' WHEN l_linenumber = 3 THEN 'CF' WHEN l_linenumber = 4 THEN 'IS' ELSE 'SCE' END AS sj_div,
 CASE WHEN l_linenumber = 1 AND l_partkey % 3 = 0 THEN 'ifrs-full_Liabilities' WHEN l_linenumber = 4 AND l_partkey % 2 = 0 THEN 'ifrs-full_Revenue' WHEN l_linenumber = 5 AND l_partkey % 2 = 0 THEN 'ifrs-full_CancellationOfTreasuryShares' WHEN l_linenumber = 2 AND l_partkey % 4 = 0 THEN 'ifrs-full_Borrowings' ELSE 'x' END AS account_id,
 CASE l_linenumber WHEN 1 THEN '부채 총계' WHEN 2 THEN CASE l_partkey % 5 WHEN 0 THEN '단기 차입금' WHEN 1 THEN '자본총계' ELSE '재고자산' END WHEN 3 THEN CASE l_partkey % 4 WHEN 0 THEN '자기주식의 취득' WHEN 1 THEN '자기주식의 처분' WHEN 2 THEN '이자의 지급' ELSE '기타' END WHEN 4 THEN CASE WHEN l_partkey % 3 = 0 THEN '매출액' ELSE '수익' END ELSE CASE WHEN l_partkey % 3 = 1 THEN '자기주식 소각' WHEN l_partkey % 3 = 2 THEN '자기주식 변동' ELSE '배당' END END AS account_nm,
 CASE WHEN l_partkey % 6 = 0 THEN '-' WHEN l_partkey % 6 = 1 THEN '(' || cast(l_suppkey * 7 AS varchar(20)) || ')' ELSE cast(cast(l_quantity AS bigint) * 1000 AS varchar(20)) END AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

_V = "CASE WHEN amount = '-' THEN NULL WHEN amount LIKE '(%' THEN -cast(replace(replace(amount, '(', ''), ')', '') AS bigint) ELSE cast(amount AS bigint) END"


@query(f"""SELECT corp_code, year, quarter, revenue, net_income, operating_income, depreciation, equity, total_assets, total_liabilities, cash, buyback_krw, retired_krw, CASE WHEN NOT coalesce(td > total_liabilities, false) THEN td END AS total_debt FROM (
SELECT corp_code, year, quarter, arg_min(v, [p_rev, row_no]) FILTER (WHERE p_rev IS NOT NULL AND v IS NOT NULL) AS revenue, cast(NULL AS bigint) AS net_income, cast(NULL AS bigint) AS operating_income, cast(NULL AS bigint) AS depreciation, arg_min(v, row_no) FILTER (WHERE label = '자본총계' AND v IS NOT NULL) AS equity, cast(NULL AS bigint) AS total_assets,
 arg_min(v, row_no) FILTER (WHERE account_id = 'ifrs-full_Liabilities' AND (sj_div IS NULL OR sj_div = 'BS') AND v IS NOT NULL) AS total_liabilities, cast(NULL AS bigint) AS cash,
 sum(abs(v)) FILTER (WHERE sj_div = 'CF' AND account_nm = '자기주식의 취득') AS buyback_krw,
 max(abs(v)) FILTER (WHERE sj_div = 'SCE' AND (account_id = 'ifrs-full_CancellationOfTreasuryShares' OR account_nm LIKE '%소각%') AND account_nm NOT LIKE '%변동%' AND v <> 0) AS retired_krw,
 coalesce(CASE WHEN count(sj_div) = 0 THEN sum(v) FILTER (WHERE debt) ELSE sum(v) FILTER (WHERE debt AND sj_div = 'BS') END,
  CASE WHEN bool_or(sj_div = 'BS' AND label = '부채총계') AND NOT coalesce(bool_or(sj_div = 'BS' AND account_nm LIKE '%차입%'), false) AND NOT coalesce(bool_or(account_nm = '이자의 지급' AND coalesce(v, 0) <> 0), false) THEN 0 END) AS td
FROM (SELECT *, {_V} AS v, replace(account_nm, ' ', '') AS label, account_id = 'ifrs-full_Borrowings' OR replace(account_nm, ' ', '') = '단기차입금' AS debt,
  CASE WHEN account_nm = '매출액' THEN 0 WHEN account_id = 'ifrs-full_Revenue' AND (sj_div IS NULL OR sj_div IN ('IS', 'CIS')) THEN 3 END AS p_rev FROM ({STATEMENTS})) GROUP BY 1, 2, 3)""")
def statement_facts(spark, t):
    return T.statement_facts(t.sql(STATEMENTS))


#: Filings of one company and year: rows (label, figure), and the total in won that they state, written by hand.
FILINGS: list[tuple[list[tuple[str, str]], str]] = [
    ([("현금배당금총액(백만원)", "2,000")], "2000000000"),
    ([("현금배당금총액 (백만원)", "25,026"), ("주당 현금배당금(원)", "-")], "25026000000"),
    ([("현금배당금총액(백만원)", "-"), ("(연결)주당순이익(원)", "5,000")], "0"),
    ([("현금배당금총액(백만원)", "-"), ("현금배당수익률(%)", "3.10")], "NULL"),
    ([("현금배당금총액(백만원)", "-"), ("주당 현금배당금(원)", "500")], "NULL"),
    ([("현금배당금총액(백만원)", "-"), ("주식배당수익률(%)", "1.5"), ("(연결)현금배당성향(%)", "-")], "0"),
    ([("현금배당금총액(백만원)", "30"), ("현금배당금총액(백만원)", "31")], "NULL"),
    ([("현금배당금총액(백만원)", "30"), ("현금배당금총액(백만원)", "30")], "30000000"),
    ([("현금배당금총액(백만원)", "(30)")], "NULL"),
    ([("현금배당금총액(원)", "30")], "NULL"),
    ([("(별도)현금배당성향(%)", "12.5")], "NULL"),
]
FILED = "SELECT lpad(cast(o_custkey AS varchar(20)), 8, '0') AS corp_code, year(o_orderdate) AS year, o_custkey % 11 AS kind, lpad(cast(max(o_orderkey) AS varchar(20)), 14, '0') AS rcept_no FROM orders GROUP BY 1, 2, 3"


def filings(t):
    """The rows of each company's kind of filing, and an older filing of the same year that says something else."""
    kinds = F.array(*(F.array(*(F.struct(F.lit(a).alias("se"), F.lit(b).alias("thstrm")) for a, b in rows)) for rows, _ in FILINGS))
    x = t.sql(FILED)
    new = x.select("corp_code", "year", "rcept_no", F.explode(F.element_at(kinds, (F.col("kind") + 1).cast("int"))).alias("r")).select("corp_code", "year", "rcept_no", "r.*")
    return new.unionByName(x.selectExpr("corp_code", "year", "'00000000000000' AS rcept_no", "'현금배당금총액(백만원)' AS se", "'77' AS thstrm"))


@query("SELECT corp_code, year, cast(CASE kind " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(FILINGS)) + f" END AS bigint) AS dividend_total FROM ({FILED})")
def dividend_total(spark, t):
    return T.dividend_total(filings(t))


QUANTITIES = """SELECT lpad(cast(o_custkey AS varchar(20)), 8, '0') AS corp_code, year(o_orderdate) AS year, CASE WHEN l_linenumber = 1 AND o_custkey % 3 = 0 THEN '총 계' WHEN l_linenumber = 2 AND o_custkey % 2 = 0 THEN '소계' ELSE '배당가능이익' END AS acqs_mth1, '직접' AS acqs_mth2, '장내' AS acqs_mth3,
 CASE l_partkey % 3 WHEN 0 THEN '보통주' WHEN 1 THEN '우선주' ELSE ' ' END AS stock_knd, CASE WHEN l_partkey % 5 = 0 THEN '-' ELSE cast(cast(l_quantity AS bigint) AS varchar(20)) END AS change_qy_acqs FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(f"""SELECT corp_code, year, CASE WHEN n = 1 OR (n > 1 AND kinds = n) THEN total WHEN n > 1 AND lo = hi THEN lo WHEN n > 1 THEN NULL WHEN leaves IS NOT NULL THEN leaves WHEN subs > 0 THEN NULL ELSE 0 END AS change_qy_acqs FROM (
SELECT corp_code, year, count(v) FILTER (WHERE k = 't') AS n, count(DISTINCT CASE WHEN k = 't' AND v IS NOT NULL THEN nullif(trim(stock_knd), '') END) AS kinds, sum(v) FILTER (WHERE k = 't') AS total, min(v) FILTER (WHERE k = 't') AS lo, max(v) FILTER (WHERE k = 't') AS hi, sum(v) FILTER (WHERE k = 'l') AS leaves, count(v) FILTER (WHERE k = 's') AS subs
FROM (SELECT *, CASE acqs_mth1 WHEN '총 계' THEN 't' WHEN '소계' THEN 's' ELSE 'l' END AS k, try_cast(change_qy_acqs AS bigint) AS v FROM ({QUANTITIES})) GROUP BY 1, 2)""")
def buyback_quantity(spark, t):
    return T.buyback_quantity(t.sql(QUANTITIES), "change_qy_acqs")


GATE = "SELECT corp_code, year, CASE WHEN treasury_stock_pct < 6 THEN 0.0e0 ELSE treasury_stock_pct END AS treasury_stock_pct FROM (SELECT corp_code, cast(substr(as_of, 1, 4) AS int) AS year, treasury_stock_pct FROM ownership)"


@query(f"SELECT o.corp_code, o.year, CASE WHEN treasury_stock_pct = 0 AND coalesce(coalesce(buyback_amount, 0) - coalesce(buyback_retired_amount, 0) > 0 OR (coalesce(buyback_amount, 0) = 0 AND buyback_amount_krw > 0), false) THEN NULL ELSE treasury_stock_pct END AS treasury_stock_pct FROM ({GATE}) o LEFT JOIN financials f ON f.corp_code = o.corp_code AND f.year = o.year", "ownership", "financials")
def zero_treasury_gate(spark, t):
    return T.zero_treasury_gate(t.sql(GATE), t.financials)


#: Holders (name, kind of share, rate) with the per cent that they state, and shares (row, issued, own) with theirs, by hand.
HOLDERS: list[tuple[list[tuple[str, str, str]], str]] = [
    ([("홍길동", "보통주", "30"), ("홍길순", "보통주", "5"), ("합계", "보통주", "35")], "35.0"),
    ([("홍길동", "의결권 없는 우선주", "20"), ("홍길순", "보통주", "30")], "30.0"),
    ([("홍길동", "보통주", "30.25"), (" 계 ", "보통주", "41.5%"), ("계", "보통주", "9")], "41.5"),
    ([("계", "우선주", "7"), ("계", "보통주", "-"), ("홍길동", "보통주", "3")], "7.0"),
    ([("특수관계인", "보통주", "12.1"), ("소계", "보통주", "12.1")], "12.1"),
    ([("계", "보통주", "-")], "NULL"),
]
SHARES: list[tuple[list[tuple[str, str, str]], str]] = [
    ([("합계", "1,000", "30")], "3.0"),
    ([("합계", "1000", "△")], "0.0"),
    ([("보통주", "1000", "900"), ("합계", "1000", "-")], "0.0"),
    ([("합계", "0", "30")], "NULL"),
    ([("합계", "1000", "3000"), ("합계", "1000", "10")], "NULL"),
    ([("합 계", "1000", "10")], "NULL"),
    ([("합계", "-", "10")], "NULL"),
]
OWNED = "SELECT DISTINCT lpad(cast(o_custkey AS varchar(20)), 8, '0') AS corp_code, year(o_orderdate) AS year, o_custkey % 6 AS h, o_custkey % 7 AS s FROM orders"


def listed(t, kinds: list, by: str, *names: str):
    rows = F.array(*(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows)) for rows, _ in kinds))
    return t.sql(OWNED).select("corp_code", "year", F.posexplode(F.element_at(rows, (F.col(by) + 1).cast("int"))).alias("row_no", "r")).select("corp_code", "year", "row_no", "r.*")


@query("SELECT * FROM (SELECT corp_code, year, cast(CASE h " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(HOLDERS)) + " END AS double) AS largest_shareholder_pct, cast(CASE s " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(SHARES)) + f" END AS double) AS treasury_stock_pct FROM ({OWNED})) WHERE largest_shareholder_pct IS NOT NULL OR treasury_stock_pct IS NOT NULL")
def ownership_facts(spark, t):
    return T.ownership_facts(listed(t, HOLDERS, "h", "nm", "stock_knd", "rate"), listed(t, SHARES, "s", "se", "istc_totqy", "tesstk_co"))
