"""Generations of stored tables, failures between stage and commit, and what the screening queries cost."""

import os
import random
import statistics
import zlib
from dataclasses import replace

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from pledgelens.operators import loads as L
from pledgelens.operators import ml
from pledgelens.operators import rank as R
from pledgelens.operators import screening as X
from pledgelens.operators.batch import run_scoring, serve_day, stored_scores, stored_screening
from pledgelens.plans import registry
from pledgelens.sources.domain import domain_tables, state_of
from pledgelens.sources.store import Generations

DAY = "2001-03-31"


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "Broadcast" not in line and "Reused" not in line for line in plan.split("\n"))


def test_generations(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "s"), grace_seconds=0)
    assert store.read("t", "d") is None and store.days("t") == []
    first = store.stage("t", "d", spark.range(3))
    assert store.read("t", "d") is None and store.days("t") == []  # staged is not in force
    store.commit("t", "d", first)
    held = store.read("t", "d")
    second = store.stage("t", "d", spark.range(5))
    assert store.read("t", "d").count() == 3
    store.commit("t", "d", second)
    assert store.read("t", "d").count() == 5 and held.count() == 3  # a reader keeps its generation until the sweep
    store.stage("t", "d", spark.range(7))  # abandoned
    assert Generations(spark, str(tmp_path / "s")).sweep("t", "d") == 0  # within the grace time
    assert store.sweep("t", "d") == 2 and store.read("t", "d").count() == 5 and store.days("t") == ["d"]
    assert sorted(n for n in os.listdir(tmp_path / "s/t/as_of=d") if not n.startswith(".")) == ["CURRENT", second]


@pytest.mark.parametrize("broken", ["stage", "staged", "commit"])
def test_failure_keeps_the_old_rows(spark, sf, tmp_path, monkeypatch, broken):
    t, out = domain_tables(spark, sf), str(tmp_path / "scores")
    assert not run_scoring(t, out, DAY, ("gap",))[0].failed
    old = sorted(map(str, stored_scores(spark, out, "gap", DAY).collect()))

    def fail(self, *a, **k):
        raise OSError("the disk is full")

    with monkeypatch.context() as m:
        m.setattr(Generations, broken, fail) if broken != "staged" else m.setattr("pledgelens.operators.loads.reconcile", fail)
        r = run_scoring(t, out, DAY, ("gap",))[0]
    assert r.failed and not r.publishable
    assert sorted(map(str, stored_scores(spark, out, "gap", DAY).collect())) == old
    Generations(spark, out, grace_seconds=0).sweep("gap", DAY)
    assert len([n for n in os.listdir(f"{out}/gap/as_of={DAY}") if n.startswith("gen-")]) == 1
    assert not run_scoring(t, out, DAY, ("gap",))[0].failed


def test_screening_reads_the_store(spark, sf, tmp_path):
    t, out = domain_tables(spark, sf), str(tmp_path / "scores")
    with pytest.raises(ValueError, match="not served"):
        stored_screening(spark, t.company, out, DAY)
    assert all(r.scored and not r.failed for r in serve_day(t, out, DAY))
    rows = stored_screening(spark, t.company, out, DAY)
    page = X.screen(rows, X.ScreenFilter(sector="1", min_execution=10.0), "-execution_score", 1, 40).items
    assert shuffles(page) < 15 and "unrankable_reason" in rows.columns and rows.count() > 0
    corp = rows.where("has_opacity").first().corp_code
    assert "EqualTo(corp_code" in X.screen(rows, X.ScreenFilter(corp_code=corp)).items._jdf.queryExecution().toString()
    # a day on which one engine was not run
    store = Generations(spark, str(tmp_path / "part"))
    for name in ("metrics", "own_gap", "plans", "gap"):
        store.commit(name, DAY, store.stage(name, DAY, Generations(spark, out).read(name, DAY)))
    part = stored_screening(spark, t.company, str(tmp_path / "part"), DAY)
    assert part.where("has_mna OR has_opacity").count() == 0 and part.count() == store.read("gap", DAY).count()


def test_nothing_to_rank_writes_nothing(spark, sf, tmp_path):
    """Without metrics and ownership the acquisition score is an error, whatever companies there are; the old rows stay."""
    t, out = domain_tables(spark, sf), str(tmp_path / "scores")
    bare = replace(t, financials=t.financials.limit(0), ownership=t.ownership.limit(0))
    r = run_scoring(bare, out, DAY, ("mna",))[0]
    assert "nothing to rank" in r.failed[0] and not r.complete and stored_scores(spark, out, "mna", DAY) is None
    assert run_scoring(t, out, DAY, ("mna",))[0].scored > 0
    old = stored_scores(spark, out, "mna", DAY).count()
    assert run_scoring(bare, out, DAY, ("mna", "gap"))[0].failed and stored_scores(spark, out, "mna", DAY).count() == old
    owned = run_scoring(replace(t, financials=t.financials.limit(0)), out, DAY, ("mna",))[0]
    assert not owned.failed and owned.scored > 0  # ownership alone is something to rank


def test_shuffles_of_the_scores(spark, sf):
    assert shuffles(registry.queries()["mna_score"](spark, sf)) < 30
    assert shuffles(registry.queries()["screening_page"](spark, sf)) < 15


@pytest.mark.parametrize("name", ["score_batch", "market_summary", "published_snapshot", "refreshed_company", "investment_tags"])
def test_reports_are_derived_once(spark, sf, monkeypatch, name):
    """Only one of all the tables that a query writes and returns is computed from the order lines."""
    seen = []
    for kind in ("parquet", "csv"):

        def put(self, path, *a, plain=getattr(DataFrameWriter, kind), **k):
            seen.append(self._df.inputFiles())
            return plain(self, path, *a, **k)

        monkeypatch.setattr(DataFrameWriter, kind, put)
    seen.append(registry.queries()[name](spark, sf).inputFiles())
    assert sum(any("lineitem.parquet" in f for f in files) for files in seen) == 1


def test_callers_views_stay(spark, sf):
    names = ("customer", "orders", "lineitem", "ownership", "valueup_plan", "macro_indicator")
    for name in names:
        spark.range(1).withColumn("mine", F.lit(name)).createOrReplaceTempView(name)
    for q in ("parse_amounts", "zero_treasury_gate", "normalize_macro", "merge_pages", "resolve_attachments", "apply_reviews"):
        registry.queries()[q](spark, sf).limit(1).collect()
    for name in names:
        assert spark.table(name).first().mine == name
        spark.catalog.dropTempView(name)
    assert state_of(spark, sf) == state_of(spark, sf) != state_of(spark, sf.replace("0.001", "0.01"))


def test_ranks_and_medians_of_many_populations(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, float("nan"), 1.5, *range(40)])) for _ in range(3000)] + [("lone", 1.0)]
    rows = [(g, None if v is None else float(v)) for g, v in rows]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g string, v double").repartition(8)
    by = {}
    for g, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    got = {r.id: r.r for r in R.mid_rank(df, "v", "r", [F.col("g")]).collect()}
    for i, (g, v) in enumerate(rows):
        own = by.get(g, [])
        want = None if v is None or v != v or len(own) < 2 else (sum(x < v for x in own) + (own.count(v) - 1) / 2) / (len(own) - 1)
        assert got[i] == (None if want is None else pytest.approx(want))
    medians = R.exact_medians(df.where("v IS NOT NULL AND NOT isnan(v)").select("g", F.col("v").alias("_v")), ["g"]).collect()
    assert {r.g: (r.n, r.median) for r in medians} == {g: (len(v), statistics.median(v)) for g, v in by.items()}
    assert R.exact_medians(df.limit(0).select("g", F.col("v").alias("_v")), ["g"]).count() == 0


@pytest.mark.parametrize("bin_rows", [4096, 16])
def test_stratified_sample_equals_sorting_classes(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(ml, "BIN_ROWS", bin_rows)
    rows = [("big", i) for i in range(900)] + [("mid", i) for i in range(1000, 1310)] + [("few", i) for i in range(5)] + [(None, i) for i in range(2000, 2040)]
    df = spark.createDataFrame(rows, "c string, id long").repartition(5)
    got = sorted(map(str, ml.stratified_sample(df, "c", "id", 200).collect()))
    by = {}
    for c, i in rows:
        by.setdefault(c, []).append(i)
    whole, rest = 5, 900 + 310 + 40
    want = []
    for c, ids in by.items():
        quota = len(ids) if len(ids) <= 30 else (200 - whole) * len(ids) // rest
        want += [(c, i) for i in sorted(ids, key=lambda i: (zlib.crc32(str(i).encode()), i))[:quota]]
    assert got == sorted(str(r) for r in spark.createDataFrame(want, "c string, id long").collect())


def test_reviews(spark):
    fields = "filename string, target_roe double, target_payout_ratio double, target_total_return_ratio double, target_pbr double, period_start string, period_end string, buyback_planned boolean, needs_review boolean, parse_error string, reviewed_by string, reviewed_at string, review_note string"
    base = spark.createDataFrame([("a", 5.0, None, None, None, None, None, None, True, None, None, None, None), ("b", 1.0, None, None, None, None, None, None, True, None, None, None, None)], fields)
    kinds = "filename string, decision string, overrides map<string,string>, reviewer string, reason string, note string, day string"
    said = [("a", "approve", {"target_roe": " 7.5 ", "period_end": "NULL"}, "kim", None, "n" * 290, "2026-02-03"), ("b", "approve", None, "kim", None, None, None), ("b", "reject", None, "kim", "r", None, None), ("z", "approve", None, "kim", None, None, None)]
    rows, errors = L.apply_reviews(base, spark.createDataFrame(said, kinds))
    a, b = rows.orderBy("filename").collect()
    assert (a.target_roe, a.period_end, a.needs_review, a.reviewed_by, a.reviewed_at) == (7.5, None, False, "kim", "2026-02-03")
    assert a.review_note == ("n" * 290 + " | target_roe: 5.0 -> 7.5; period_end: none -> none")[:300]
    assert (b.target_roe, b.needs_review, b.review_note) == (1.0, True, None)
    assert sorted(map(tuple, errors.collect())) == [("b", "several_decisions"), ("b", "several_decisions"), ("z", "no_attachment")]


def test_label_sources(spark):
    docs = spark.createDataFrame([(i, " " if i == 6 else "t") for i in range(1, 9)], "id int, text string")
    gold = spark.createDataFrame([(1, "x"), (2, " "), (3, "x"), (3, "y"), (5, "oops"), (6, "x"), (8, "parser_miss")], "id int, y string")
    packet = spark.createDataFrame([(1, "y"), (2, "y"), (3, "x"), (8, "x")], "id int, y string")
    got = {r.id: (r.y, r.source, r.overruled, r.reason) for r in ml.gold_join(docs, [("gold", gold), ("packet", packet)], "id", "y", ["x", "y"], ("parser_miss",)).collect()}
    assert got == {
        1: ("x", "gold", "packet=y", None), 2: ("y", "packet", None, None), 3: ("y", "gold", "packet=x", "contested"), 4: (None, None, None, "unlabelled"),
        5: ("oops", "gold", None, "unknown_value:oops"), 6: ("x", "gold", None, "empty"), 7: (None, None, None, "unlabelled"), 8: ("parser_miss", "gold", "packet=x", "left_out:parser_miss"),
    }


def test_cells_and_reasons(spark):
    plans = spark.createDataFrame([(1, None, "s", "d", True, "첨부 파일을 참조"), (2, None, "s", "d", None, "첨부 파일을 참조"), (3, None, "s", "d", False, "기업가치 제고 계획 예고 (안내공시) / (2025)"), (4, None, "s", "d", None, None), (5, 8.0, "s", "d", True, "")], "plan_id long, target_roe double, body_signal string, disclosure_date string, attachment_absent boolean, raw_text string")
    none = {c: F.lit(None).cast("double") for c in ("target_payout_ratio", "target_total_return_ratio", "period_start", "buyback_planned")}
    assert {r.source_plan_id: r.unrankable_reason for r in X.plan_reasons(plans.withColumns(none)).collect()} == {1: "undisclosed", 2: "unreadable", 3: "notice", 4: "unstated", 5: None}
    rows = spark.createDataFrame([(1, False, None, False, None, "65000", False, None, None, None), (2, True, None, True, None, "64100", True, None, "other_metric", "undisclosed"), (3, True, 1.0, True, 2.0, "64100", True, 0.5, None, None), (4, True, 1.0, True, None, "64992", False, None, None, "notice"), (5, True, 1.0, True, None, None, False, None, None, "unstated")], "id int, has_valueup boolean, execution_score double, has_mna boolean, mna_target_score double, sector string, has_opacity boolean, opacity_rank double, plan_body_signal string, unrankable_reason string")
    assert {r.id: (r.valueup_status, r.mna_status, r.opacity_status) for r in X.cell_status(rows).collect()} == {1: ("not_run", "not_run", "unranked"), 2: ("unknown", "unsupported_sector", "other_metric"), 3: ("ok", "ok", "ok"), 4: ("ok", "unknown", "notice"), 5: ("ok", "unknown", "unranked")}


def test_snapshot_days(spark):
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "as_of string")
    ask = lambda *d: spark.createDataFrame([(x,) for x in d], "requested string")
    got = sorted(map(tuple, X.resolve_days(days("1", "2", "4"), days("1", "2", "2", "3"), ask(None, "1", "3", "4", "9")).collect()), key=str)
    assert got == sorted([(None, "2", None, "newer:valueup,mna"), ("1", "1", None, None), ("3", None, "missing:valueup", None), ("4", None, "missing:mna", None), ("9", None, "missing:valueup,mna", None)], key=str)
    assert list(map(tuple, X.resolve_days(days("1"), days("2"), ask(None)).collect())) == [(None, None, "no_common_day", None)]
    assert list(map(tuple, X.resolve_days(days(), days(), ask("1")).collect())) == [("1", None, "missing:valueup,mna", None)]
