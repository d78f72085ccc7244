"""Queries over disclosure texts and pages; texts are rendered from known plans, so the plans are the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from pledgelens.functions import text as X
from pledgelens.operators.scores import choose_plans, disclosed_axes
from pledgelens.plans.loads import ATTACH, attachments
from pledgelens.plans.oracle import AS_OF, AXES, with_tables
from pledgelens.sources.domain import domain_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None, *needs: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_tables(oracle, *needs) if needs else oracle
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered(spark, sf_dir):
    """Each plan as a text of the lines that its known fields give, with lines that name other figures."""
    plans = domain_tables(spark, sf_dir).valueup_plan
    line = lambda c, *parts: F.when(F.col(c).isNotNull(), F.concat(*parts))
    later = lambda c: (F.col(c).cast("int") + 25).cast("string")  # noqa: E731  years of this century, as texts have them
    text = F.concat_ws(
        "\n",
        line("target_roe", F.lit("ROE 목표 "), "target_roe", F.lit("%")),
        line("target_payout_ratio", F.lit("배당성향 "), "target_payout_ratio", F.lit("% 이상 유지")),
        line("target_total_return_ratio", F.lit("주주환원율 "), "target_total_return_ratio", F.lit("% 목표")),
        line("period_start", F.lit("중장기 계획 "), later("period_start"), F.lit("~"), later("period_end"), F.lit("년")),
        F.when(F.col("buyback_planned"), "자사주 매입 및 소각 계획").when(~F.col("buyback_planned"), "자사주 매입 계획 없음"),
        F.lit("부채비율 100% 이하"),
        F.lit("ROE 2%p 개선"),
    )
    return plans.withColumn("raw_text", text)


FIELDS = ["target_roe", "target_payout_ratio", "target_total_return_ratio", "period_start", "period_end", "buyback_planned"]


@query("SELECT plan_id, target_roe, target_payout_ratio, target_total_return_ratio, cast(cast(period_start AS int) + 25 AS varchar) AS period_start, cast(cast(period_end AS int) + 25 AS varchar) AS period_end, buyback_planned FROM valueup_plan", "valueup_plan")
def parse_targets(spark, sf_dir):
    return X.parse_targets(rendered(spark, sf_dir).select("plan_id", "raw_text", "disclosure_date"), "raw_text", "disclosure_date").select("plan_id", *FIELDS)


#: Texts of every tier of the target rules, and what each says, written by hand ({n}: a number of the plan, filed in 2026).
TIERS: list[tuple[str, dict[str, str]]] = [
    ("ROE 목표 {n}%", {"roe": "n"}),
    ("자기자본이익률(연결) : {n}% 달성", {"roe": "n"}),
    ("ROE(2024년 5%) 배당성향 {n}%", {"payout": "n"}),
    ("ROE 현재 5% → 목표 {n}%", {"roe": "n"}),
    ("ROE {n}~{n}.5% 목표", {"roe": "n", "ranges": "'roe:' || n || '~' || n || '.5'"}),
    ("ROE {n}~3% 목표", {}),
    ("ROE : '26년까지 {n}%", {"roe": "n"}),
    ("ROE 2022년 5% 기록. ROE 2030년까지 {n}% 달성", {"roe": "n"}),
    ("ROE 2024년 {n}%", {}),
    ("ROE : '26~'28년 {n}%", {"roe": "n", "start": "'2026'", "end": "'2028'"}),
    ("③ ROE\n- 중장기 목표 {n}%", {"roe": "n"}),
    ("ROE 개선\n- K-ICS 비율 목표 {n}%", {}),
    ("배당성향 {n}% 이상 유지", {"payout": "n"}),
    ("배당성향 {n}% 이내", {}),
    ("배당성향 2020년 10%, 배당성향 3년 평균 {n}%", {"payout": "n"}),
    ("당기순이익의 {n}%이상의 배당성향", {"payout": "n"}),
    ("부채비율 : {n}% 이상 - 배당성향", {}),
    ("부채비율 100% 배당성향 확대, 연결 당기순이익 가운데 주주 몫으로 {n}%의 배당성향", {"payout": "n"}),
    ("주주환원율 {n}% 목표", {"total": "n"}),
    ("주주환원율 {n}%", {}),
    ("주주환원율 {n}% ROE 목표 7%", {"roe": "7"}),
    ("주주환원율 3년 평균 {n}% 수준", {"total": "n"}),
    ("총주주환원율 {n}~{n}.5%\n수준을 유지", {"total": "n", "ranges": "'total_return_ratio:' || n || '~' || n || '.5'"}),
    ("주주환원율 상향: 당기순이익(연결)의 {n}%", {"total": "n"}),
    ("주주환원율 상향 이전 실적인 {n}%", {}),
    ("PBR {n}배 달성, 2024회계연도부터 2026회계연도까지", {"pbr": "n", "start": "'2024'", "end": "'2026'"}),
    ("비교 2019~2021년, 계획\n2024~2026년 ROE {n}%p", {"start": "'2024'", "end": "'2026'"}),
    ("비교 2019~2021년 및 2022~2023년 매출 {n}%", {}),
    ("향후 3개년 매출 {n}%", {"start": "'2026'", "end": "'2028'"}),
    ("주주환원 지속 - 2030년까지 배당성향 {n}%", {"payout": "n", "start": "'2026'", "end": "'2030'"}),
    ("자사주 취득 자사주 소각 계획 없음 {n}%", {"buyback": "false"}),
    ("자기주식 매입 및 소각 {n}%", {"buyback": "true"}),
]
TIER_FIELDS = {"roe": "target_roe", "payout": "target_payout_ratio", "total": "target_total_return_ratio", "pbr": "target_pbr", "start": "period_start", "end": "period_end", "buyback": "buyback_planned", "ranges": "target_ranges"}


def _tier_oracle() -> str:
    text = {"start", "end", "ranges"}
    kinds = {k: "varchar" if k in text else "boolean" if k == "buyback" else "double" for k in TIER_FIELDS}
    said = lambda k: " ".join(f"WHEN {i} THEN cast({want[k]} AS {kinds[k]})" for i, (_, want) in enumerate(TIERS) if k in want)
    columns = ", ".join(f"CASE plan_id % {len(TIERS)} {said(k)} END AS {name}" for k, name in TIER_FIELDS.items())
    return f"SELECT plan_id, {columns} FROM (SELECT plan_id, cast(5 + plan_id % 37 AS varchar) AS n FROM valueup_plan)"


@query(_tier_oracle(), "valueup_plan")
def target_tiers(spark, sf_dir):
    """One text of TIERS for each plan."""
    text = F.element_at(F.array(*(F.lit(t) for t, _ in TIERS)), (F.col("plan_id") % len(TIERS) + 1).cast("int"))
    plans = domain_tables(spark, sf_dir).valueup_plan.select("plan_id", F.replace(text, F.lit("{n}"), (F.lit(5) + F.col("plan_id") % 37).cast("string")).alias("t"), F.lit("2026-03-20").alias("d"))
    return X.parse_targets(plans, "t", "d").select("plan_id", *TIER_FIELDS.values())


NOTE = "CASE plan_id % 6 WHEN 0 THEN CASE WHEN plan_id % 4 = 0 THEN ' 기 공시(2024.2.30) 및 旣공시 (2024. 3. 5)' ELSE ' 旣공시 (2024. 3. 5), 기 공시(2024.2.28)' END WHEN 1 THEN '재공시 하는 경우' WHEN 2 THEN '영업이익률 12.5% 달성 목표' WHEN 3 THEN '첨부 없이 제출' WHEN 4 THEN '기업가치 제고 계획 예고 (안내공시) / (2025)' ELSE '첨부 파일을 참조' END"


@query(f"""SELECT plan_id, CASE WHEN plan_id % 6 = 0 AND plan_id % 4 <> 0 THEN '2024-03-05' END AS ref, plan_id % 6 = 2 AS numeric_target, plan_id % 6 = 3 AS no_attachment, plan_id % 6 = 4 AS notice, plan_id % 6 = 5 AS external,
 CASE WHEN axes > 0 THEN 'axis_targets' ELSE CASE plan_id % 6 WHEN 0 THEN 'refiling' WHEN 1 THEN 'refiling' WHEN 2 THEN 'other_metric' ELSE 'no_targets' END END AS body, CASE WHEN axes = 0 THEN CASE WHEN plan_id % 6 = 3 THEN 'undisclosed' WHEN plan_id % 5 = 0 THEN 'unreadable' WHEN plan_id % 6 = 4 THEN 'notice' ELSE 'unstated' END END AS reason FROM (SELECT plan_id, {AXES} AS axes FROM valueup_plan)""", "valueup_plan")
def body_rules(spark, sf_dir):
    x = domain_tables(spark, sf_dir).valueup_plan.select("plan_id", disclosed_axes().alias("axes"), F.expr(NOTE).alias("t"), F.expr("plan_id % 5 = 0").alias("unreadable"))
    return x.select("plan_id", X.referenced_date("t").alias("ref"), X.has_numeric_target("t").alias("numeric_target"), X.declares_no_attachment("t").alias("no_attachment"), X.is_notice("t").alias("notice"), X.references_external("t").alias("external"), X.classify_body("t", "axes").alias("body"), X.unrankable_reason("t", "axes", "unreadable").alias("reason"))


@query("SELECT body_signal AS stored, CASE WHEN axes > 0 THEN 'axis_targets' ELSE CASE plan_id % 6 WHEN 0 THEN 'refiling' WHEN 1 THEN 'refiling' WHEN 2 THEN 'other_metric' ELSE 'no_targets' END END AS got, count(*) AS n FROM (SELECT *, " + AXES + " AS axes FROM valueup_plan) GROUP BY 1, 2", "valueup_plan")
def replay_labels(spark, sf_dir):
    x = domain_tables(spark, sf_dir).valueup_plan.withColumn("axes", disclosed_axes()).withColumn("t", F.expr(NOTE))
    return X.replay_labels(x.withColumn("got", X.classify_body("t", "axes")), "body_signal", "got")


@query("SELECT CASE WHEN axes > 0 THEN 'axis_targets' ELSE CASE plan_id % 6 WHEN 0 THEN 'refiling' WHEN 1 THEN 'refiling' WHEN 2 THEN 'other_metric' ELSE 'no_targets' END END AS body_signal, count(*) AS n FROM (SELECT plan_id, " + AXES + " AS axes FROM valueup_plan) GROUP BY 1", "valueup_plan")
def backfilled_signals(spark, sf_dir):
    x = domain_tables(spark, sf_dir).valueup_plan.withColumn("axes", disclosed_axes()).withColumn("t", F.expr(NOTE))
    return X.backfill_signals(x, "t", "axes")[1]


@query("SELECT CASE WHEN plan_id % 6 = 3 THEN true ELSE false END AS attachment_absent, count(*) AS n FROM valueup_plan GROUP BY 1", "valueup_plan")
def backfilled_attachment_marks(spark, sf_dir):
    x = domain_tables(spark, sf_dir).valueup_plan.withColumn("axes", disclosed_axes()).withColumn("t", F.expr(NOTE))
    return X.backfill_signals(x, "t", "axes")[2]


@query(None)
def document_last_segments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.last_segment("text")).alias("n_chars"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '[ \\t\\r\\f]+', ' ', 'g'), '\\n ', chr(10), 'g'), '\\n{2,}', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS body FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags("html").alias("body"))


@query("SELECT n, (SELECT len FROM (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) AS r FROM documents) WHERE r = least(n - 1, cast(floor(n * 0.1) AS bigint)) + 1) AS p10, (SELECT len FROM (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) AS r FROM documents) WHERE r = least(n - 1, cast(floor(n * 0.5) AS bigint)) + 1) AS p50, (SELECT len FROM (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) AS r FROM documents) WHERE r = least(n - 1, cast(floor(n * 0.9) AS bigint)) + 1) AS p90, longest FROM (SELECT count(*) AS n, max(length(text)) AS longest FROM documents)")
def text_stats(spark, sf_dir):
    return X.text_stats(table(spark, sf_dir, "documents"), "text")


@query(None)
def document_segments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.segments("text")).alias("pos", "s")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s.body")).alias("longest"))


def chosen_kind(rows: list[tuple[str, str]], side: int, by: str = "page_id") -> str:
    """SQL of both engines: the text of a row's kind, by id."""
    said = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    cases = " ".join(f"WHEN {i} THEN {said(row[side])}" for i, row in enumerate(rows))
    return f"CASE {by} % {len(rows)} {cases} END"


#: Links of a page http://h{n}.example/ir/2024/page.html?x=1#top, and what each means, by hand ({r}: the page's root, {f}: a file).
LINKS: list[tuple[str, str]] = [
    ("{f}.pdf", "{r}/ir/2024/{f}.pdf"),
    ("./{f}.pdf", "{r}/ir/2024/{f}.pdf"),
    ("../x/{f}.pdf", "{r}/ir/x/{f}.pdf"),
    ("../../{f}.pdf", "{r}/{f}.pdf"),
    ("../../../{f}.pdf", "{r}/{f}.pdf"),
    ("/{f}.pdf", "{r}/{f}.pdf"),
    ("/a/../b/./{f}.pdf", "{r}/b/{f}.pdf"),
    ("//c.example/{f}.PDF", "http://c.example/{f}.PDF"),
    ("https://c.example/a/../{f}.pdf", "https://c.example/a/../{f}.pdf"),
    ("http://c.example/{f}.pdf", "http://c.example/{f}.pdf"),
    ("?file={f}.pdf", "{r}/ir/2024/page.html?file={f}.pdf"),
    ("#{f}.pdf", "{r}/ir/2024/page.html?x=1#{f}.pdf"),
    ("{f}.pdf?v=2#p3", "{r}/ir/2024/{f}.pdf?v=2#p3"),
    ("a//{f}.pdf", "{r}/ir/2024/a/{f}.pdf"),
    ("/a//{f}.pdf", "{r}/a//{f}.pdf"),
    (" {f}.pdf ", "{r}/ir/2024/{f}.pdf"),
    ("mailto:{f}.pdf@c.example", "mailto:{f}.pdf@c.example"),
    ("http:{f}.pdf", "{r}/ir/2024/{f}.pdf"),
    ("{f}.pdf/..", "{r}/ir/2024/"),
    ("a/..../{f}.pdf", "{r}/ir/2024/a/..../{f}.pdf"),
    ("view.jsp?u=../{f}.pdf", "{r}/ir/2024/view.jsp?u=../{f}.pdf"),
    ("get?a=1&amp;f={f}.pdf", "{r}/ir/2024/get?a=1&f={f}.pdf"),
]
LINK_BASE = "'http://h' || cast(page_id AS varchar(20)) || '.example/ir/2024/page.html?x=1#top'"
LINK_FILE = "CASE WHEN page_id % 5 < 3 THEN 'plan' ELSE 'report' END"
LABELS = [("기업가치 <b>제고</b> 계획", "기업가치  제고  계획"), ("실적 발표", "실적 발표"), ("IR 자료", "IR 자료"), ("첨부<br/><i>문서</i>", "첨부 문서")]
LINK_WORDS, LINK_EXCLUDED = ["plan", "제고"], ["실적", "audit"]


def linked_pages(spark, sf_dir):
    """Each page with a link of LINKS before its own text, and the same link once more."""
    form = F.replace(F.expr(chosen_kind(LINKS, 0)), F.lit("{f}"), F.expr(LINK_FILE))
    label = F.expr(chosen_kind(LABELS, 0, "(page_id div 3)"))
    again = F.concat(F.lit("<A target=_top HREF='"), form, F.lit("'>again</A>"))
    html = F.concat(F.lit('<p><a class="x" href="'), form, F.lit('">'), label, F.lit("</a> "), again, F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", F.expr(LINK_BASE).alias("url"), html.alias("html"))


LINK_ORACLE = f"""SELECT page_id, replace(replace({chosen_kind(LINKS, 1)}, '{{r}}', 'http://h' || cast(page_id AS varchar) || '.example'), '{{f}}', f) AS href,
 {chosen_kind(LABELS, 1, '(page_id // 3)')} AS label, CASE WHEN f = 'plan' THEN 2 ELSE 0 END + CASE WHEN (page_id // 3) % {len(LABELS)} = 0 THEN 1 ELSE 0 END AS score
 FROM (SELECT page_id, {LINK_FILE} AS f FROM pages) WHERE page_id % {len(LINKS)} <> 18 AND (page_id // 3) % {len(LABELS)} <> 1"""


@query(LINK_ORACLE)
def plan_page_links(spark, sf_dir):
    return X.plan_links(linked_pages(spark, sf_dir), LINK_WORDS, LINK_EXCLUDED).select("page_id", "href", "label", "score")


@query(f"SELECT p.page_id, CASE WHEN score > 0 THEN href END AS href, CASE WHEN href IS NULL THEN 'no_pdf_links' WHEN score = 0 THEN 'ambiguous:1_pdfs' END AS error FROM pages p LEFT JOIN ({LINK_ORACLE}) l USING (page_id)")
def page_links(spark, sf_dir):
    pages = linked_pages(spark, sf_dir)
    return X.best_links(pages, X.plan_links(pages, LINK_WORDS, LINK_EXCLUDED))


#: Texts of numbered sections, or of sentences, and by hand the segments of each as label=body.
SECTIONS: list[tuple[str, list[str]]] = [
    ("머리말은 열 글자가 넘는다\n1. 기업 개요\n내용\n2. 목표 설정\n값", ["header=머리말은 열 글자가 넘는다", "1=1. 기업 개요\n내용", "2=2. 목표 설정\n값"]),
    ("짧다\n1) 현황\n가\n3) 계획\n나\n2) 평가\n다\n3) 이행\n라", ["1=1) 현황\n가", "3=3) 계획\n나\n2) 평가\n다\n3) 이행\n라"]),
    ("2. 목표 하나\n1. 개요 둘\n12. 기타 셋", ["2=2. 목표 하나\n1. 개요 둘", "12=12. 기타 셋"]),
    ("첫째다. 둘째다! 셋째\n넷째", ["s1=첫째다.", "s2=둘째다!", "s3=셋째", "s4=넷째"]),
    ("1. 매출 2. 이익", ["s1=1.", "s2=매출 2.", "s3=이익"]),
    ("", []),
]


def _section_oracle() -> str:
    flat = [("", "|".join(x)) for _, x in SECTIONS]
    return f"SELECT page_id, {chosen_kind(flat, 1)} AS segments FROM pages"


@query(_section_oracle())
def section_kinds(spark, sf_dir):
    """One text of SECTIONS for each page, its segments joined."""
    made = F.transform(X.segments(F.expr(chosen_kind(SECTIONS, 0))), lambda s: F.concat_ws("=", s["label"], s["body"]))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(made, "|").alias("segments"))


#: Texts with and without leading style rules, and what is left of each, by hand.
STYLES: list[tuple[str, str]] = [
    ("p{margin:0} .x > a:hover{b:c}\n본문 ", "\n본문 "),
    ("한글{그대로} ", "한글{그대로} "),
    ("p{a{b}} ", "p{a{b}} "),
    ("1 본문 p{a} ", "1 본문 p{a} "),
    ("@media print{p{margin:0}} ", "@media print{p{margin:0}} "),
    ("p{한글도} ", " "),
    ("p{a:b}}", "}"),
    ('#id.cl[x="y"]{}\t*{}', ""),
    ("p{a:b", "p{a:b"),
    ("p{a:b} 글 q{c:d} ", " 글 q{c:d} "),
    ("p{margin:0}" * 300, ""),
    ("", ""),
]


@query(f"SELECT page_id, {chosen_kind(STYLES, 1)} || url AS body FROM pages")
def stylesheets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_stylesheet(F.concat(F.expr(chosen_kind(STYLES, 0)), "url")).alias("body"))


@query("SELECT page_id, '재공시' AS phrase FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, '예고' FROM pages WHERE page_id % 6 = 0")
def lost_signals(spark, sf_dir):
    """Phrases inside a leading style rule are lost by cleaning, the same phrases in the text are not."""
    head = "CASE WHEN page_id % 6 = 0 THEN 'p{예고} .x {재공시} ' WHEN page_id % 3 = 0 THEN 'p{재공시}' || chr(13) || '예고 ' ELSE '재공시 예고 ' END"
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.expr(head), F.lit(" 목표 "), "url").alias("t"))
    return X.signal_loss(pages, "page_id", "t", ["재공시", "목표", "예고"])


#: Texts that name web pages, and by hand the one that is the plan's source.
RELATED: list[tuple[str, str]] = [
    ("관련 웹페이지 http://ir.a.example/plan 참조", "http://ir.a.example/plan"),
    ("http://b.example 다음 관련웹페이지: https://c.example/ir/view.do?id=3.", "https://c.example/ir/view.do?id=3"),
    ("관련 웹페이지 http://own.example/x 와 http://d.example/y);", "http://d.example/y"),
    ("공시 http://own.example/1, 자료 <http://e.example/z>", "http://e.example/z"),
    ("http://own.example/only", ""),
    ("관련 웹페이지 없음", ""),
]


@query(f"SELECT page_id, nullif({chosen_kind(RELATED, 1)}, '') AS related FROM pages")
def related_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.related_url(F.expr(chosen_kind(RELATED, 0)), ["own.example"]).alias("related"))


@query(None)
def page_related_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.related_url(F.concat_ws(" ", F.lit("관련 웹페이지"), "url", "html"), ["example.org"]).alias("related"))


PAGES = "SELECT plan_id, j.page, j.page % 3 = 0 AS is_ocr, CASE WHEN (plan_id + j.page) % 4 = 0 THEN target_roe END AS target_roe, CASE WHEN (plan_id * j.page) % 5 = 1 THEN target_payout_ratio END AS target_payout_ratio, CASE WHEN plan_id % 9 = 0 THEN ' a b ' ELSE repeat('x y ', cast(20 + plan_id % 20 AS int)) END AS text, 0 AS axes FROM valueup_plan CROSS JOIN (SELECT 1 AS page UNION ALL SELECT 2 UNION ALL SELECT 3) j"


def _first(f: str) -> str:
    return f"arg_min({f}, [cast(is_ocr AS int), page]) FILTER (WHERE {f} IS NOT NULL) AS {f}, arg_min(page, [cast(is_ocr AS int), page]) FILTER (WHERE {f} IS NOT NULL) AS {f}_page"


@query(f"SELECT *, coalesce(target_roe_page = 3, false) OR coalesce(target_payout_ratio_page = 3, false) AS needs_review FROM (SELECT plan_id, {_first('target_roe')}, {_first('target_payout_ratio')} FROM ({PAGES}) GROUP BY 1)", "valueup_plan")
def merge_pages(spark, sf_dir):
    return X.merge_pages(domain_tables(spark, sf_dir).sql(PAGES), ["target_roe", "target_payout_ratio"])


@query(f"SELECT plan_id, count(*) FILTER (WHERE length(replace(text, ' ', '')) < 50) AS sparse_pages, CASE WHEN sum(length(replace(text, ' ', ''))) < greatest(20, 5 * count(*)) THEN 'no_text_layer' END AS parse_error FROM ({PAGES}) WHERE NOT is_ocr GROUP BY 1", "valueup_plan")
def readability(spark, sf_dir):
    return X.readability(domain_tables(spark, sf_dir).sql(PAGES).where("NOT is_ocr"))


FILES = "SELECT CASE plan_id % 4 WHEN 0 THEN rcept_no || '.pdf' WHEN 1 THEN corp_code || '_' || disclosure_date || '.pdf' WHEN 2 THEN 'scan' || cast(plan_id AS varchar(20)) || '.pdf' ELSE '99999999_' || disclosure_date || '_' || cast(plan_id AS varchar(20)) END AS filename, plan_id FROM valueup_plan"


@query(f"SELECT filename, CASE WHEN plan_id % 4 < 2 THEN plan_id END AS plan_id, CASE plan_id % 4 WHEN 2 THEN 'unreadable_name' WHEN 3 THEN 'no_plan' END AS reason FROM ({FILES})", "valueup_plan")
def resolve_attachments(spark, sf_dir):
    t = domain_tables(spark, sf_dir)
    return X.resolve_attachments(t.sql(FILES).select("filename"), t.valueup_plan)


@query(f"SELECT plan_id, corp_code, CASE WHEN axes = 0 THEN 1 ELSE 2 END AS priority, rcept_no || '.pdf' AS save_as FROM chosen WHERE NOT coalesce(attachment_absent, false) AND axes < 4 AND plan_id NOT IN (SELECT plan_id FROM ({ATTACH}) WHERE parse_error IS NULL)", "chosen", "valueup_plan")
def attachment_worklist(spark, sf_dir):
    t = domain_tables(spark, sf_dir)
    return X.attachment_worklist(choose_plans(t.valueup_plan, AS_OF), attachments(t), disclosed_axes(), include_partial=True)


REPORT = "CASE l_linenumber WHEN 1 THEN '기업가치 제고 계획' WHEN 2 THEN '기업가치제고계획(이행 현황)' WHEN 3 THEN '기업가치 제고 계획 철회' ELSE '사업보고서' END"


@query(f"SELECT l_linenumber AS kind, bool_and(l_linenumber = 1) AS is_plan, count(*) AS n FROM lineitem GROUP BY 1")
def plan_reports(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("kind"), X.is_plan_report(F.expr(REPORT)).alias("p"))
    return x.groupBy("kind").agg(F.bool_and("p").alias("is_plan"), F.count("*").alias("n"))
