"""Golden values on tiny tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pledgelens.functions import text as X
from pledgelens.functions import values as V
from pledgelens.operators import loads as L
from pledgelens.operators import metrics as M
from pledgelens.operators import ml
from pledgelens.operators import rank as R
from pledgelens.operators import scores as S
from pledgelens.operators import screening as C
from pledgelens.operators.batch import publish_snapshot, read_snapshot, refresh_company, run_scoring, stored_scores
from pledgelens.sources.domain import domain_tables
from pledgelens.sources.tables import SCHEMAS, read_table
from pledgelens.streaming.upserts import read_upserted, upsert_batch


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_ratios_of_two_years(spark):
    cols = "corp_code string, year int, quarter int, available_at string, revenue long, net_income long, operating_income long, equity long, total_assets long, total_liabilities long, cash long, total_debt long, dividend_total long, buyback_amount_krw long, buyback_retired_krw long"
    f = spark.createDataFrame([("a", 2023, 4, None, 500, 100, 120, 1000, 2000, 1000, 200, 400, 20, None, None), ("a", 2024, 4, None, 600, 150, 180, 1200, 2200, 1000, 250, 400, 30, None, None)], cols)
    p = spark.createDataFrame([("a", "2024-12-30", 3000), ("a", "2024-01-02", 1)], "corp_code string, date string, market_cap long")
    r = M.valuation_metrics(f, p).where("year = 2024").first()
    assert (r.roe, r.pbr, r.per, r.ev_ebit, r.yoy_revenue_growth, r.yoy_income_growth, r.total_return_ratio) == (12.5, 2.5, 20.0, 17.5, 20.0, 50.0, None)


@pytest.mark.parametrize("row,day,known", [(("2025-03-06", 2024, 4), "2024-06-30", False), (("2025-03-06", 2024, 4), "2025-03-31", True), ((None, 2024, 4), "2024-06-30", False), ((None, 2023, 4), "2024-02-01", True)])
def test_known_at(spark, row, day, known):
    df = spark.createDataFrame([row], "available_at string, year int, quarter int")
    assert df.select(M.known_at(day).alias("k")).first().k is known


def test_mid_rank_ties_nan_and_small_groups(spark):
    rows = [("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 3.0), ("g", float("nan")), ("g", None), ("h", 5.0), ("i", 7.0), ("i", 7.0)]
    got = R.mid_rank(spark.createDataFrame(rows, "k string, v double"), "v", "r", [F.col("k")]).collect()
    assert sorted((x.k, str(x.v), x.r) for x in got) == sorted([("g", "1.0", 0.0), ("g", "2.0", 0.5), ("g", "2.0", 0.5), ("g", "3.0", 1.0), ("g", "nan", None), ("g", "None", None), ("h", "5.0", None), ("i", "7.0", 0.5), ("i", "7.0", 0.5)])


@pytest.mark.parametrize("text,value", [("(1,234)", -1234), ("△ 12", -12), ("-", None), ("", None), ("12원", None), (" 1 000 ", 1000), ("99999999999999999999", None)])
def test_amounts(spark, text, value):
    assert one(spark, V.parse_amount(F.lit(text))) == value


@pytest.mark.parametrize("text,value", [("20240229", "2024-02-29"), ("20230229", None), ("2024", None)])
def test_days(spark, text, value):
    assert one(spark, V.to_iso(F.lit(text))) == value


def plan(**k):
    base = dict(plan_id=1, corp_code="a", disclosure_date="2024-01-01", target_roe=None, target_payout_ratio=None, target_total_return_ratio=None, target_pbr=None, period_start=None, period_end=None, buyback_planned=None, body_signal=None, body_reference_date=None)
    return tuple((base | k).values())


PLAN = "plan_id long, corp_code string, disclosure_date string, target_roe double, target_payout_ratio double, target_total_return_ratio double, target_pbr double, period_start string, period_end string, buyback_planned boolean, body_signal string, body_reference_date string"


@pytest.mark.parametrize("plans,pick,fallback", [
    ([plan(plan_id=1, target_roe=5.0)], 1, False),
    ([plan(plan_id=1, target_roe=5.0), plan(plan_id=2, disclosure_date="2024-05-01")], 1, True),
    ([plan(plan_id=1, target_roe=5.0), plan(plan_id=2, disclosure_date="2024-03-01", target_roe=6.0), plan(plan_id=3, disclosure_date="2024-05-01", body_signal="refiling", body_reference_date="2024-01-01", target_roe=1.0)], 1, True),
    ([plan(plan_id=1), plan(plan_id=2, disclosure_date="2024-05-01")], 2, False),
    ([plan(plan_id=3, disclosure_date="2024-05-01", body_signal="refiling", target_roe=1.0)], 3, False),
])
def test_plan_choice(spark, plans, pick, fallback):
    r = S.choose_plans(spark.createDataFrame(plans, PLAN), "2024-12-31").first()
    assert (r.plan_id, r.used_fallback) == (pick, fallback)


@pytest.mark.parametrize("text,field,value", [
    ("ROE 목표 10%", "target_roe", 10.0),
    ("배당성향 30% 이상 유지", "target_payout_ratio", 30.0),
    ("주주환원율 중장기 50% 목표", "target_total_return_ratio", 50.0),
    ("별도 기준 30% 이내 주주환원", "target_total_return_ratio", None),
    ("부채비율 : 100% 이하 - 배당성향", "target_payout_ratio", None),
    ("ROE 현재 5% → 목표 8%", "target_roe", 8.0),
    ("ROE 11~13% 목표", "target_roe", 11.0),
    ("ROE 13~11% 목표", "target_roe", None),
    ("ROE : 2024년 5%", "target_roe", None),
    ("ROE 2%p 개선", "target_roe", None),
    ("PBR 1.2배 달성", "target_pbr", 1.2),
    ("중장기 계획 2024~2026년", "period_end", "2026"),
    ("향후 3개년 계획", "period_end", "2028"),
    ("자사주 매입 계획 없음", "buyback_planned", False),
    ("자기주식 취득 후 소각", "buyback_planned", True),
    ("", "buyback_planned", None),
])
def test_targets(spark, text, field, value):
    df = spark.createDataFrame([(text, "2026-03-01")], "t string, d string")
    assert X.parse_targets(df, "t", "d").first()[field] == value


def test_segments(spark):
    t = "머리말은 열 글자가 넘는다\n1. 기업 개요\n내용\n2. 목표 설정\n값\n1. 현황 되풀이"
    got = one(spark, X.segments(F.lit(t)))
    assert [s.label for s in got] == ["header", "1", "2"] and "되풀이" in got[2].body
    assert [s.label for s in one(spark, X.segments(F.lit("첫째다. 둘째다.")))] == ["s1", "s2"]


def test_stylesheet_and_clean(spark):
    assert one(spark, X.clean(F.lit("p{margin:0} .x {a:b}\r\n본문  글\n\n\n끝"))) == "본문 글\n끝"
    assert one(spark, X.clean(F.lit("한글{그대로}"))) == "한글{그대로}"


def test_null_upsert_and_ranges(spark):
    base = spark.createDataFrame([("a", 1, 2), ("b", 3, None)], "k string, x int, y int")
    inc = spark.createDataFrame([("a", None, 9), ("c", 5, 6)], "k string, x int, y int")
    assert sorted(map(tuple, L.upsert_keep(base, inc, ["k"]).collect())) == [("a", 1, 9), ("b", 3, None), ("c", 5, 6)]
    assert sorted(map(tuple, L.upsert_keep(base, inc, ["k"], always=["x"]).collect())) == [("a", None, 9), ("b", 3, None), ("c", 5, 6)]
    r = spark.createDataFrame([("roe:1~2", "roe:3~4,payout:5~6"), (None, "roe:3~4"), ("roe:1~2", None)], "o string, n string")
    assert [x.m for x in r.select(L.merge_ranges("o", "n").alias("m")).collect()] == ["roe:1~2,payout:5~6", "roe:3~4", "roe:1~2"]


def test_bad_arguments():
    with pytest.raises(ValueError):
        C.sort_keys("nope", ["roe"], ["corp_code"])
    with pytest.raises(ValueError):
        C.ScreenFilter(min_roe=float("nan"))
    with pytest.raises(ValueError):
        C.ScreenFilter(sector=" ")
    with pytest.raises(ValueError):
        S.Config(w_macro=0.5)


def test_reader_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "c.csv").write_text("corp_code,stock_code,corp_name,market,sector\n00000012,000012,x,KOSPI,01100\n")
    r = read_table(spark, "company", str(tmp_path / "c.csv")).first()
    assert (r.corp_code, r.sector) == ("00000012", "01100") and "company" in SCHEMAS


def test_batch_refresh_and_snapshot(spark, sf, tmp_path):
    t, out, day = domain_tables(spark, sf), str(tmp_path / "scores"), "2001-03-31"
    done = run_scoring(t, out, day)
    assert all(r.publishable and r.scored for r in done)
    stored = lambda e: stored_scores(spark, out, e, day)
    rows = {e: stored(e).count() for e in ("gap", "mna", "opacity")}
    corp = stored("gap").first().corp_code
    assert [(r.engine, r.scored, r.deleted) for r in refresh_company(t, out, corp)] == [("gap", 1, 0), ("opacity", rows["opacity"], 0)]
    for e in rows:  # a run for one company leaves all others as they are
        r = run_scoring(t, out, day, (e,), [corp])[0]
        assert not r.failed and r.publishable == (e == "gap") and stored(e).count() == rows[e]
    assert run_scoring(t, out, day, ("nope",))[0].failed
    none = replace(t, valueup_plan=t.valueup_plan.where(f"corp_code <> '{corp}'"))
    assert [(r.scored, r.deleted) for r in run_scoring(none, out, day, ("gap",), [corp])] == [(0, 1)]
    assert stored("gap").count() == rows["gap"] - 1
    nothing = replace(t, valueup_plan=t.valueup_plan.limit(0))
    assert [(r.scored, r.deleted) for r in run_scoring(nothing, out, day, ("gap",))] == [(0, rows["gap"] - 1)]
    assert run_scoring(nothing, out, day, ("opacity",))[0].failed and stored("opacity").count() == rows["opacity"]
    with pytest.raises(ValueError):
        run_scoring(t, out, day, ("gap",), [])
    vm = M.valuation_metrics(t.financials, t.prices)
    gap = S.valueup_score(S.choose_plans(t.valueup_plan, day), M.reports_as_of(vm, day), M.reports_as_of(t.financials, day), day)
    views = C.snapshot_views(t.company, gap, M.reports_as_of(vm, day), vm, t.financials, t.macro_indicator, day)
    at = str(tmp_path / "snap")
    m = publish_snapshot(views, at, day, "now")
    files = spark.read.format("binaryFile").load(f"{at}/{m['generation']}/view=macro_layer/*.csv").select("content").collect()
    assert all(f.content.startswith("\ufeffindicator,".encode()) for f in files)
    assert m["views"]["macro_layer"] == read_snapshot(spark, at, "macro_layer").count() > 0
    with pytest.raises(ValueError):
        publish_snapshot(views | {"macro_layer": views["macro_layer"].drop("value")}, at, day, "later")
    assert read_snapshot(spark, at, "macro_layer").count() == m["views"]["macro_layer"]


def test_streaming_upserts(spark, sf, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "event_id", "event_type", "value")
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(src)
    events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    q = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(upsert_batch(out, ["user_id"], "event_id")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert read_upserted(spark, out).count() == events.select("user_id").distinct().count()


def test_folds_keep_groups_whole(spark):
    rows = [(g, "x" if i % 3 else "y") for g in "abcdefg" for i in range(ord(g) - 95)]
    folds = ml.group_folds(spark.createDataFrame(rows, "g string, y string"), "g", "y", 3).collect()
    assert len(folds) == 7 and {r.fold for r in folds} == {0, 1, 2}


def test_signal_loss(spark):
    df = spark.createDataFrame([(1, "p{재공시} 목표"), (2, "재공시 목표")], "k int, t string")
    assert [tuple(r) for r in X.signal_loss(df, "k", "t", ["재공시", "목표"]).collect()] == [(1, "재공시")]
