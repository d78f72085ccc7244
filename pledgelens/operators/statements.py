"""Raw statement rows to one row of facts for each report.

Rows: corp_code, year, quarter, row_no, sj_div, account_id, account_nm, amount (text). Every rule is a conditional
aggregate over the report's rows, so a report of any length is reduced map-side; the rule tables are constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgelens.functions.values import parse_amount, parse_quantity, parse_ratio

KEY = ["corp_code", "year", "quarter"]

# Account labels first, then tags, in the order in which they count.
ACCOUNTS = {
    "revenue": ["매출액", "수익(매출액)", "영업수익", "ifrs-full_Revenue"],
    "net_income": ["당기순이익", "당기순이익(손실)", "분기순이익", "ifrs-full_ProfitLoss"],
    "operating_income": ["영업이익", "영업이익(손실)", "dart_OperatingIncomeLoss"],
    "depreciation": ["감가상각비", "유형자산감가상각비"],
    "equity": ["자본총계", "ifrs-full_Equity"],
    "total_assets": ["자산총계", "ifrs-full_Assets"],
    "total_liabilities": ["부채총계", "ifrs-full_Liabilities"],
    "cash": ["현금및현금성자산", "ifrs-full_CashAndCashEquivalents", "dart_CashAndCashEquivalentsAtEndOfPeriodCf"],
}
# The statements in which a tag counts; the cash tag in CF needs the word for the end of the period.
TAG_STATEMENTS = {
    "ifrs-full_Revenue": ["IS", "CIS"],
    "ifrs-full_Equity": ["BS"],
    "ifrs-full_Assets": ["BS"],
    "ifrs-full_Liabilities": ["BS"],
    "ifrs-full_ProfitLoss": ["IS", "CIS"],
    "dart_OperatingIncomeLoss": ["IS", "CIS"],
    "ifrs-full_CashAndCashEquivalents": ["BS", "CF"],
    "dart_CashAndCashEquivalentsAtEndOfPeriodCf": ["CF"],
}
CASH_TAG, PERIOD_END = "ifrs-full_CashAndCashEquivalents", "기말"
# Labels (without blanks) and tags of interest-bearing debt.
DEBT_LABELS = ["차입금", "단기차입금", "장기차입금", "유동성장기부채", "사채", "리스부채", "차입금및사채", "유동차입금및사채", "비유동차입금및비유동사채", "유동차입금", "비유동차입금", "차입부채", "유동차입부채", "비유동차입부채", "유동성리스부채", "비유동리스부채", "장기리스부채", "단기리스부채"]
DEBT_TAGS = ["ifrs-full_Borrowings", "ifrs-full_ShorttermBorrowings", "ifrs-full_LongtermBorrowings", "ifrs-full_CurrentBorrowingsAndCurrentPortionOfNoncurrentBorrowings", "ifrs-full_CurrentLeaseLiabilities", "ifrs-full_NoncurrentLeaseLiabilities", "ifrs-full_BondsIssued", "ifrs-full_NoncurrentPortionOfNoncurrentBondsIssued", "ifrs-full_NoncurrentPortionOfNoncurrentLoansReceived", "ifrs-full_CurrentPortionOfLongtermBorrowings", "dart_LongTermBorrowingsGross", "dart_CurentPortionOfFinanceLeaseLiabilities", "dart_NonCurrentFinanceLeaseLiabilities"]
DEBT_WORDS = ["차입", "사채", "리스부채", "금융부채"]
INTEREST_EXCLUDE = ["미지급", "이자수익", "이자수입", "이자수취"]
BUYBACK_WORDS, BUYBACK_EXCLUDE = ["자기주식", "자사주"], ["처분", "소각", "종속기업", "자회사", "관계기업"]
RETIRED_TAG, RETIRED_WORD = "ifrs-full_CancellationOfTreasuryShares", "소각"
RETIRED_EXCLUDE = ["순증감", "변동", "취득", "처분", "비용", "종속회사", "종속기업", "자회사", "관계기업"]


def any_word(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def statement_facts(rows: DataFrame) -> DataFrame:
    """Account picks, debt, buyback and retirement amounts of each report."""
    v, nm = parse_amount("amount"), F.coalesce("account_nm", F.lit(""))
    label, tag, sj = F.regexp_replace(nm, "\\s", ""), F.col("account_id"), F.col("sj_div")
    x = rows.withColumns({"v": v, "nm": nm, "label": label})
    picks = []
    for name, wanted in ACCOUNTS.items():
        place = F.lit(None).cast("int")
        for k, w in reversed(list(enumerate(wanted))):
            if w in TAG_STATEMENTS:
                gate = sj.isNull() | sj.isin(TAG_STATEMENTS[w])
                if w == CASH_TAG:
                    gate = gate & (sj.isNull() | (sj != "CF") | F.contains("label", F.lit(PERIOD_END)))
                hit = (tag == w) & gate
            elif w.startswith(("ifrs-full_", "dart_")):
                hit = tag == w
            else:
                hit = F.col("nm") == w  # letter for letter; the tags take in what is written otherwise
            place = F.when(hit, k).otherwise(place)
        picks.append(F.min_by(F.when(place.isNotNull(), F.col("v")), F.when(place.isNotNull() & F.col("v").isNotNull(), F.struct(place, F.col("row_no")))).alias(name))
    bs = F.max(sj.isNotNull().cast("int")) == 0
    debt = tag.isin(DEBT_TAGS) | F.col("label").isin(DEBT_LABELS)
    in_bs = F.coalesce(sj == "BS", F.lit(False))
    total_in = F.sum(F.when(debt & in_bs, F.col("v")))
    total_any = F.sum(F.when(debt, F.col("v")))
    complete = F.max((in_bs & ((tag == "ifrs-full_Liabilities") | (F.col("label") == "부채총계"))).cast("int")) == 1
    named = F.max((in_bs & any_word(F.col("nm"), DEBT_WORDS)).cast("int")) == 1
    interest = ((F.contains("nm", F.lit("이자")) & F.contains("nm", F.lit("지급"))) | (F.col("label") == "이자비용")) & ~any_word(F.col("nm"), INTEREST_EXCLUDE)
    paid = F.max((interest & (F.coalesce("v", F.lit(0)) != 0)).cast("int")) == 1
    bought = (sj == "CF") & any_word(F.col("nm"), BUYBACK_WORDS) & F.contains("nm", F.lit("취득")) & ~any_word(F.col("nm"), BUYBACK_EXCLUDE)
    retired = (sj == "SCE") & ((tag == RETIRED_TAG) | F.contains("nm", F.lit(RETIRED_WORD))) & ~any_word(F.col("nm"), RETIRED_EXCLUDE)
    out = x.groupBy(*KEY).agg(
        *picks,
        F.when(bs, total_any).otherwise(total_in).alias("summed"),
        (F.coalesce(complete, F.lit(False)) & ~F.coalesce(named, F.lit(False)) & ~F.coalesce(paid, F.lit(False))).alias("no_debt"),
        F.sum(F.when(bought, F.abs("v"))).alias("buyback_krw"),
        F.max(F.when(retired & (F.col("v") != 0), F.abs("v"))).alias("retired_krw"),
    )
    total = F.coalesce("summed", F.when(F.col("no_debt"), F.lit(0)))
    # a debt above all liabilities contradicts itself
    out = out.withColumn("total_debt", F.when(~F.coalesce(total > F.col("total_liabilities"), F.lit(False)), total))
    return out.drop("summed", "no_debt")


# The total's label and unit, and the labels (without blanks) whose positive figure says that a dividend was paid.
DIVIDEND_TOTAL, DIVIDEND_UNIT = "현금배당금총액(백만원)", 1_000_000
DIVIDEND_EVIDENCE = ["주당현금배당금(원)", "현금배당수익률(%)", "(연결)현금배당성향(%)", "(별도)현금배당성향(%)"]


def dividend_total(rows: DataFrame) -> DataFrame:
    """Rows: corp_code, year, rcept_no, se, thstrm. The latest filing's total in won; a blank total without other evidence is 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("corp_code", "year")
    filing = F.coalesce("rcept_no", F.lit(""))
    last = rows.withColumn("_l", F.max(filing).over(w)).where(filing == F.col("_l"))
    last = last.withColumns({"v": parse_amount("thstrm"), "label": F.regexp_replace("se", "\\s", ""), "figure": F.regexp_replace("thstrm", "[,\\s]", "")})
    total = F.coalesce(F.col("label") == DIVIDEND_TOTAL, F.lit(False))
    paid = F.col("label").isin(DIVIDEND_EVIDENCE) & F.col("figure").rlike("^[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)$") & (F.col("figure").try_cast("double") > 0)
    g = last.groupBy("corp_code", "year").agg(F.count_if(total).alias("n"), F.min(F.when(total, F.col("v"))).alias("lo"), F.max(F.when(total, F.col("v"))).alias("hi"), F.count_if(paid).alias("proof"))
    known, blank = (F.col("lo") == F.col("hi")) & (F.col("lo") >= 0), F.col("lo").isNull() & (F.col("proof") == 0)
    value = F.when((F.col("n") > 0) & known, F.col("lo") * DIVIDEND_UNIT).when((F.col("n") > 0) & blank, F.lit(0))
    return g.select("corp_code", "year", value.alias("dividend_total"))


def buyback_quantity(rows: DataFrame, field: str) -> DataFrame:
    """Rows: corp_code, year, acqs_mth1..3, stock_knd and a quantity. Totals count first, then the sum of the leaves; subtotals alone give null."""
    labels = F.array(*(F.coalesce(F.regexp_replace(c, "\\s", ""), F.lit("")) for c in ("acqs_mth1", "acqs_mth2", "acqs_mth3")))
    x = rows.withColumn("v", parse_quantity(field)).withColumn("kind", F.when(F.arrays_overlap(labels, F.array(F.lit("총계"), F.lit("합계"))), "total").when(F.array_contains(labels, "소계"), "sub").otherwise("leaf"))
    of = lambda k, c: F.when((F.col("kind") == k) & F.col("v").isNotNull(), F.col(c))
    knd = F.nullif(F.trim("stock_knd"), F.lit(""))
    g = x.withColumn("knd", knd).groupBy("corp_code", "year").agg(
        F.count(of("total", "v")).alias("n"), F.count_distinct(of("total", "knd")).alias("kinds"), F.sum(of("total", "v")).alias("total"), F.min(of("total", "v")).alias("lo"), F.max(of("total", "v")).alias("hi"), F.sum(of("leaf", "v")).alias("leaves"), F.count(of("sub", "v")).alias("subs"), F.count(field).alias("cells")
    )
    value = F.when(F.col("n") == 1, F.col("total")).when((F.col("n") > 1) & (F.col("kinds") == F.col("n")), F.col("total")).when((F.col("n") > 1) & (F.col("lo") == F.col("hi")), F.col("lo")).when(F.col("n") > 1, F.lit(None)).when(F.col("leaves").isNotNull(), F.col("leaves")).when(F.col("subs") > 0, F.lit(None)).when(F.col("cells") > 0, F.lit(0))
    return g.select("corp_code", "year", value.alias(field))


# The holders' summary rows (letter for letter), the mark of common shares, and the shares' summary row.
HOLDER_TOTAL, HOLDER_SUMMARIES, COMMON, SHARE_TOTAL = "계", ["계", "소계", "합계"], "보통", "합계"


def ownership_facts(holders: DataFrame, shares: DataFrame) -> DataFrame:
    """Largest shareholder's and treasury shares' per cent of each company and year; a row only if one is known.

    Holders: corp_code, year, row_no, nm, stock_knd, rate. Shares: corp_code, year, row_no, se, istc_totqy, tesstk_co. The
    first summary row of the shares counts; a treasury cell without a number beside a known issue is 0.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^\\s+|\\s+$", "")
    name, v = bare("nm"), parse_ratio("rate")
    common = F.contains(F.coalesce("stock_knd", F.lit("")), F.lit(COMMON))
    first = lambda hit: F.min_by(v, F.when(hit & v.isNotNull(), F.col("row_no")))
    parts = F.round(F.sum(F.when(~name.isin(HOLDER_SUMMARIES) & common, v)), 2)
    h = holders.groupBy("corp_code", "year").agg(F.coalesce(first((name == HOLDER_TOTAL) & common), first(name == HOLDER_TOTAL), parts).alias("largest_shareholder_pct"))
    summary = shares.where(bare("se") == SHARE_TOTAL).groupBy("corp_code", "year").agg(F.min_by(F.struct(parse_amount("istc_totqy").alias("issued"), parse_amount("tesstk_co").alias("own")), "row_no").alias("s"))
    issued, own = F.col("s.issued"), F.col("s.own")
    pct = F.when(issued != 0, F.when(own.isNull(), F.lit(0.0)).otherwise(F.round(own * 100.0 / issued, 2)))
    s = summary.select("corp_code", "year", F.when(pct.between(0, 100), pct).alias("treasury_stock_pct"))
    return h.join(s, ["corp_code", "year"], "full").where("largest_shareholder_pct IS NOT NULL OR treasury_stock_pct IS NOT NULL")


def zero_treasury_gate(own: DataFrame, financials: DataFrame) -> DataFrame:
    """A treasury share of 0 that the same year's report (its latest quarter) contradicts becomes null."""
    f = financials.groupBy("corp_code", "year").agg(F.max_by(F.struct("buyback_amount", "buyback_retired_amount", "buyback_amount_krw"), "quarter").alias("f"))
    j = own.join(f, ["corp_code", "year"], "left")
    net = F.coalesce("f.buyback_amount", F.lit(0)) - F.coalesce("f.buyback_retired_amount", F.lit(0))
    against = (net > 0) | (F.coalesce("f.buyback_amount", F.lit(0)) == 0) & (F.col("f.buyback_amount_krw") > 0)
    gated = F.when((F.col("treasury_stock_pct") == 0) & F.coalesce(against, F.lit(False)), F.lit(None)).otherwise(F.col("treasury_stock_pct"))
    return j.withColumn("treasury_stock_pct", gated).select(*own.columns)
