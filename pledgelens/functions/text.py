"""Rules over disclosure texts, as column expressions. A rule that does not match gives null, never a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgelens.functions.values import col, held, starts


def strip_tags(c: str | Column) -> Column:
    """Markup to lines: a tag becomes a line break, blanks run together, empty lines go."""
    t = F.regexp_replace(col(c), "<[^>]*>", "\n")
    t = F.regexp_replace(t, "[ \\t\\r\\f]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, "\\n ", "\n"), "\\n{2,}", "\n")
    return F.regexp_replace(t, "^[ \\n]+|[ \\n]+$", "")


# The characters of a style rule's selector, and those it starts with.
SELECTOR, SELECTOR_START = ".#*a-zA-Z0-9_\\-\\s:,>+~\\[\\]=\"'()", ".#*a-zA-Z"


def strip_stylesheet(c: str | Column) -> Column:
    """Drop the leading rules `selector{declarations}`, up to the first piece before a closing brace that is none.

    The text is cut at closing braces, so no expression repeats a group, and the time is linear in the text.
    """
    rule = f"^\\s*[{SELECTOR_START}][{SELECTOR}]*\\{{[^{{}}]*$"

    def rest(pieces: Column) -> Column:
        # what stands behind the last brace is no rule
        rules = F.transform(pieces, lambda p, i: p.rlike(rule) & (i < F.size(pieces) - 1))
        first = F.array_position(rules, False).cast("int")
        return F.array_join(F.slice(pieces, first, F.size(pieces)), "}")

    return F.when(F.contains(col(c), F.lit("}")), held(F.split(col(c), "\\}", -1), rest)).otherwise(col(c))


def clean(c: str | Column) -> Column:
    t = F.regexp_replace(strip_stylesheet(c), "\\r\\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t\\u00a0]+", " "), "\\n\\s*\\n+", "\n")
    return F.regexp_replace(t, "^\\s+|\\s+$", "")


# Heading words that open a section, and the words of the rules below.
HEADS = "개요|현황|현상|진단|목표|계획|이행|소통|평가|기업|회사|주주|기타"
FIRST_HEADING = f"(?:^|\\n)\\s*([0-9]{{1,2}})[.)]\\s*((?:{HEADS})[^\\n]*)"


def segments(c: str | Column) -> Column:
    """array<struct<label, body>>: numbered sections whose numbers rise, with the text before them as header; else sentences s1, s2, ...

    A part whose number does not rise belongs to the section before it. Numbers have two digits at most, so a section starts
    at the first part of a number if all parts before have smaller ones; the time is linear in the text.
    """
    t = col(c)
    cut = F.split(t, f"(?:^|\\n)\\s*(?=[0-9]{{1,2}}[.)]\\s*(?:{HEADS}))")
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, "^([0-9]{1,2})[.)]", 1), F.lit("")).cast("int"), F.lit(0))
    pair = lambda p: F.struct(number(p).alias("n"), p.alias("t"))
    kept = F.filter(F.transform(cut, pair), lambda x: ~((x["n"] == 0) & (F.length(F.trim(x["t"])) < 10)))

    def sections(parts: Column) -> Column:
        def begins(numbers: Column) -> Column:
            place = lambda n: F.array_position(numbers, n).cast("int")
            first = lambda n: (place(n) > 0) & (F.coalesce(F.array_max(F.slice(numbers, F.lit(1), place(n) - 1)), F.lit(0)) < n)
            rising = F.transform(F.filter(F.sequence(F.lit(1), F.lit(99)), first), place)
            return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1)), rising)))

        def between(at: Column) -> Column:
            def one(p: Column, k: Column) -> Column:
                end = F.coalesce(F.try_element_at(at, k + 2), F.size(parts) + 1)
                rest = F.transform(F.slice(parts, p + 1, end - p - 1), lambda x: x["t"])
                head = F.element_at(parts, p)
                body = F.array_join(F.concat(F.array(F.trim(head["t"])), rest), "\n")
                return F.struct(F.when(head["n"] > 0, head["n"].cast("string")).otherwise("header").alias("label"), body.alias("body"))

            return F.transform(at, one)

        return F.when(F.size(parts) > 0, held(held(F.transform(parts, lambda x: x["n"]), begins), between)).otherwise(F.expr("cast(array() AS array<struct<label:string,body:string>>)"))

    sentence = F.filter(F.transform(F.split(t, "(?<=[.!?])\\s+|\\n"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.transform(sentence, lambda x, i: F.struct(F.concat(F.lit("s"), i + 1).alias("label"), x.alias("body")))
    return F.when(F.size(cut) > 1, held(kept, sections)).otherwise(plain)


def text_stats(df: DataFrame, text_col: str) -> DataFrame:
    """n and the 10, 50, 90 % and largest text length by index min(n-1, floor(n*q)), over counts of each length."""
    from pyspark.sql import Window

    each = df.select(F.length(text_col).alias("len")).where("len IS NOT NULL").groupBy("len").agg(F.count("*").alias("c"))
    run = each.withColumn("upto", F.sum("c").over(Window.orderBy("len"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("len")))
    return run.agg(F.max("n").alias("n"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("len").alias("longest"))


# Numbers, labels, competing metrics and words of the target rules. A ceiling ("at most") and percentage points are no target.
NUMBER = "([0-9]+(?:\\.[0-9]+)?)"
NO_POINT = "(?![pP포])"
NO_CEILING = "(?!\\s*(?:이내|이하|미만))"
PERCENT = NUMBER + "\\s*%" + NO_POINT + NO_CEILING
RANGE = NUMBER + "\\s*[~∼\\-–]\\s*" + NUMBER + "\\s*%" + NO_POINT + NO_CEILING
LABELS = {"target_roe": "(?i:ROE|자기자본이익률)", "target_payout_ratio": "배당성향", "target_total_return_ratio": "(?:총\\s*주주환원율|주주환원율|총주주환원)"}
LABEL_WORDS = {"target_roe": ["ROE", "자기자본이익률"], "target_payout_ratio": ["배당성향"], "target_total_return_ratio": ["주주환원"]}
OTHERS = {"target_roe": "(?i:배당성향|주주환원|PBR|영업이익|부채비율)", "target_payout_ratio": "ROE|자기자본이익률|주주환원|PBR|영업이익|부채비율", "target_total_return_ratio": "ROE|자기자본이익률|배당성향|PBR|영업이익|부채비율"}
PAYOUT_RIVALS = ["ROE", "자기자본이익률", "주주환원", "PBR", "영업이익", "부채비율"]
GOAL = "(?:목표|지향|이상|확대|원칙|수준|계획)"
EARLY_GOAL = "(?:목표|지향|상향|계획)"
PAST_WORD = "(?:실적|기록|달성|현황|이행)"
BULLET = "(?:[-–—·•*ㆍ]|[①-⑳]|[㉠-㉭]|\\(?[0-9]{1,2}[).]|[□■○●▶>])"
METRIC_WORD = "(?:[A-Za-z][A-Za-z0-9\\-]+|[가-힣]{2,})\\s*(?:비율|이익률|수익률|증가율|성장률|배수|지수|비중|률|율)"
QUALIFIER = "(?:[0-9]{1,2}\\s*개?년\\s*(?:평균|연평균)|CAGR|[`'‘’]?[0-9]{2,4}\\s*년\\s*까지|[`'‘’]?[0-9]{2}\\s*[~\\-–∼]\\s*[`'‘’]?[0-9]{2}\\s*년|[`'‘’]?[0-9]{2,4}\\s*년(?:도)?에?)"
AHEAD = "평균|연평균|CAGR|까지"
ARROWS = "[→⇒➔]"
PBR = "(?i:PBR)[^0-9\\n]{0,15}?([0-9]+(?:\\.[0-9]+)?)\\s*배"
BUYBACK, NEGATION = "(?:자기주식|자사주)[^\\n]{0,15}?(?:취득|매입|소각)", "없음|없이|아니|않|미실시|미계획|계획\\s*없|완료|기실시"
# Gaps between a label and its value ({x}: competing metrics), and what has to stand behind the value.
GAPS = {
    "plain": "(?:(?!{x})[^0-9%\\n(]){0,15}(?:\\((?:(?!%|{x})[^)\\n]){0,25}\\)\\s*[:：]?\\s*)?(?:(?!{x})[^0-9%\\n]){0,10}?",
    "arrow_left": "(?:(?!{x})[^%\\n]){0,30}?",
    "arrow_right": "(?:(?!{x})[^\\n%]){0,25}?",
    "qualified_left": "(?:(?!{x})[^0-9%\\n(]){0,12}",
    "qualified_right": "(?:(?!{x})[^0-9%\\n]){0,8}?",
    "next_line": "(?:(?!{x})[^0-9%\\n]){0,8}\\n[ \\t]*{bullet}[ \\t]*(?:(?!{x})(?!{metric})[^0-9%\\n]){0,12}?{goal}(?:(?!{x})(?!{metric})[^0-9%\\n]){0,8}?",
    "goal_first": "(?:(?!{x})(?!{past})[^0-9%\\n]){0,12}?{early}(?:(?!{x})(?!{past})[^0-9%\\n(]){0,12}(?:\\((?:(?!%|{x})[^)\\n]){0,25}\\))?(?:(?!{x})(?!{past})[^0-9%\\n]){0,8}?",
    "backwards": "(?:(?!{x})[^0-9%\\n]){0,25}?(?:의\\s*)?",
    "goal_after": "(?=(?:(?!{x})[^\\n]){0,12}?{goal})",
    "goal_after_wide": "(?=(?:(?!{x})(?!{metric})[^%\\n]){0,6}\\n?(?:(?!{x})(?!{metric})[^%\\n]){0,20}?{goal})",
}
# Year ranges, end years, and the words and distances that anchor them.
PERIODS = [
    "(20[0-9]{2})\\s*년?\\s*[~\\-–∼]\\s*(20[0-9]{2})",
    "[`'‘’]\\s*([0-9]{2})\\s*[~\\-–∼]\\s*[`'‘’]?\\s*([0-9]{2})\\s*년",
    "[`'‘’]?([0-9]{2}|20[0-9]{2})\\s*(?:회계연도|년|년도)?\\s*부터\\s*[`'‘’]?([0-9]{2}|20[0-9]{2})\\s*(?:회계연도|년|년도)?\\s*까지",
]
UNTIL, FORWARD = "[`'‘’]?([0-9]{2}|20[0-9]{2})\\s*년\\s*까지", "향후\\s*([0-9]{1,2})\\s*개?년"
PLAN_WORD, UNTIL_WORD = "계획|목표|향후|중장기", "계획|목표|향후|중장기|환원|달성|유지|개선|제고"
NEAR, UNTIL_NEAR, LONGEST_SPAN, LARGEST_PBR = 20, 60, 20, 100


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match as a double, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("double")


def hits(c: Column, pattern: str) -> Column:
    """array<struct<at, a, b>>: every match of a pattern with two groups, at its code point from 0; empty without one.

    Places are sums over the matches and the pieces between them, so the time is linear in their number.
    """
    pair = lambda g: F.regexp_extract_all(c, F.lit(pattern), F.lit(g))
    cut = F.filter(F.arrays_zip(pair(0).alias("m"), pair(1).alias("a"), pair(2).alias("b"), F.split(c, pattern, -1).alias("before")), lambda z: z["m"].isNotNull())

    def placed(found_: Column) -> Column:
        begin = starts(F.transform(found_, lambda z: F.length(z["before"]) + F.length(z["m"])))
        at = lambda z, s: (s + F.length(z["before"])).cast("int")
        return F.zip_with(found_, begin, lambda z, s: F.struct(at(z, s).alias("at"), z["a"].alias("a"), z["b"].alias("b")))

    return F.when(c.rlike(pattern), held(cut, placed)).otherwise(F.expr("cast(array() AS array<struct<at:int,a:string,b:string>>)"))


def before(c: Column, at: Column, n: int) -> Column:
    """Up to n code points before a place."""
    begin = F.greatest(at - n, F.lit(0))
    return F.substr(c, begin + 1, at - begin)


def full_year(y: Column, year: Column) -> Column:
    """A year of two digits in the century of `year`."""
    return F.when(F.length(y) == 2, F.floor(F.coalesce(year, F.lit(2000)) / 100).cast("int") * 100 + y.cast("int")).otherwise(y.cast("int"))


def metric_target(c: Column, name: str, year: Column) -> Column:
    """struct<value, low, high> of one metric, null if none; low and high are the texts of a range.

    The tiers stand in one coalesce, so each regular expression runs once, on texts for which all before it found nothing:
    arrow or plain, range, qualified by years, then by metric: next line (ROE), backwards (payout), wide range and goal
    first (total return). Texts without a percent sign or the label are passed over.
    """
    label, x, key = LABELS[name], OTHERS[name], name.removeprefix("target_")
    gap = {k: v.replace("{x}", x).replace("{bullet}", BULLET).replace("{metric}", METRIC_WORD).replace("{goal}", GOAL).replace("{early}", EARLY_GOAL).replace("{past}", PAST_WORD) for k, v in GAPS.items()}
    mark = gap["goal_after"] if key == "total_return_ratio" else ""
    plain = label + gap["plain"] + PERCENT + mark
    arrow = label + gap["arrow_left"] + NUMBER + "\\s*%" + gap["arrow_right"] + ARROWS + "\\s*" + gap["arrow_right"] + NUMBER + "\\s*%" + NO_POINT + mark
    one = lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high")))
    at = lambda p: F.nullif(F.regexp_instr(c, F.lit(p)), F.lit(0))

    def ranged(mark_: str) -> Column:
        """The first range, if it rises; its ends are read again from the match alone."""
        pattern, ends = label + gap["plain"] + RANGE, NUMBER + "\\s*[~∼\\-–]\\s*" + NUMBER + "\\s*%$"
        low, high = (lambda m: F.regexp_extract(m, ends, 1)), (lambda m: F.regexp_extract(m, ends, 2))
        return held(F.regexp_extract(c, pattern + mark_, 0), lambda m: F.when((m != "") & (low(m).try_cast("double") <= high(m).try_cast("double")), F.struct(low(m).try_cast("double").alias("value"), low(m).alias("low"), high(m).alias("high"))))

    def qualified() -> Column:
        """The first value whose qualifier looks ahead of the disclosure's year."""
        p = label + gap["qualified_left"] + f"({QUALIFIER})" + gap["qualified_right"] + PERCENT + mark
        every = F.arrays_zip(F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias("q"), F.regexp_extract_all(c, F.lit(p), F.lit(2)).alias("v"))
        last = lambda z: F.try_element_at(F.regexp_extract_all(z["q"], F.lit("[0-9]{2,4}"), F.lit(0)), F.lit(-1))
        return F.try_element_at(F.filter(every, lambda z: z["q"].rlike(AHEAD) | F.coalesce(full_year(last(z), year) > year, F.lit(False))), F.lit(1))["v"].try_cast("double")

    first = F.when(c.rlike(ARROWS), F.when(at(arrow).isNotNull() & (at(plain).isNull() | (at(arrow) <= at(plain))), found(c, arrow, 2)).otherwise(found(c, plain))).otherwise(found(c, plain))
    tiers = [held(first, one), ranged(mark), held(qualified(), one)]
    if key == "roe":
        tiers.append(held(found(c, label + gap["next_line"] + PERCENT), one))
    if key == "payout_ratio":
        # no competing label within the 20 characters before a number
        alone = "".join(f"(?<!{w}[\\s\\S]{{0,{NEAR - len(w)}}})" for w in PAYOUT_RIVALS)
        tiers.append(held(found(c, "(?<![0-9])(?<![0-9]\\.)" + alone + PERCENT + gap["backwards"] + label), one))
    if key == "total_return_ratio":
        tiers += [ranged(gap["goal_after_wide"]), held(found(c, label + gap["goal_first"] + PERCENT), one)]
    said = F.lit(False)
    for w in LABEL_WORDS[name]:
        said = said | F.contains(F.upper(c) if w == "ROE" else c, F.lit(w))
    return F.when(F.contains(c, F.lit("%")) & said, F.coalesce(*tiers))


def period(c: Column, year: Column) -> Column:
    """struct<s, e>, texts: the first range behind a plan word, else the only range; without ranges `향후 N년`, else the one end year."""
    pair = lambda s, e: F.struct(s.cast("string").alias("s"), e.cast("string").alias("e"))
    shapes = [
        (PERIODS[0], lambda z: (z["a"].cast("int"), z["b"].cast("int")), 10**4),
        (PERIODS[1], lambda z: (2000 + z["a"].cast("int"), 2000 + z["b"].cast("int")), 10**4),
        (PERIODS[2], lambda z: (full_year(z["a"], year), full_year(z["b"], year)), LONGEST_SPAN),
    ]
    every = []
    for p, years, span in shapes:
        made = F.transform(hits(c, p), lambda z: F.struct(z["at"].alias("at"), years(z)[0].alias("s"), years(z)[1].alias("e")))
        every.append(F.filter(made, lambda r: (r["s"] <= r["e"]) & (r["e"] - r["s"] <= span)))

    def pick(ranges: Column) -> Column:
        near = F.filter(ranges, lambda r: before(c, r["at"], NEAR).rlike(PLAN_WORD))
        kinds = F.array_distinct(F.transform(ranges, lambda r: pair(r["s"], r["e"])))
        return F.when(F.size(near) > 0, pair(near[0]["s"], near[0]["e"])).when(F.size(kinds) == 1, kinds[0])

    n = F.nullif(F.regexp_extract(c, FORWARD, 1), F.lit("")).try_cast("int")
    ends = F.filter(hits(c, UNTIL + "()"), lambda z: before(c, z["at"], UNTIL_NEAR).rlike(UNTIL_WORD))
    until = F.array_distinct(F.filter(F.transform(ends, lambda z: full_year(z["a"], year)), lambda y: y.between(year, year + LONGEST_SPAN)))
    later = F.when(n.between(1, LONGEST_SPAN), pair(year, year + n - 1)).otherwise(F.transform(F.array(until), lambda u: F.when(F.size(u) == 1, pair(year, u[0])))[0])
    found_ = F.array(F.array_sort(F.concat(*every)))
    return F.when(c.rlike("[0-9]{2}\\s*(?:년|회계연도|부터|[~\\-–∼])|향후"), F.transform(found_, lambda r: F.when(F.size(r) > 0, pick(r)).when(year.isNotNull(), later))[0])


def parse_targets(df: DataFrame, text: str, date: str) -> DataFrame:
    """Add the seven target fields and target_ranges of a text."""
    c, head = F.coalesce(F.col(text), F.lit("")), F.substring(F.col(date), 1, 4)
    year = F.when(head.rlike("^[0-9]{4}$"), head.cast("int"))
    out = df.withColumns({f"_{name}": metric_target(c, name, year) for name in LABELS} | {"_p": period(c, year), "_pbr": F.when(F.contains(c, F.lit("배")), found(c, PBR)), "_window": F.when(c.rlike("자기주식|자사주"), F.regexp_extract(c, f"[\\s\\S]{{0,10}}?{BUYBACK}[\\s\\S]{{0,15}}", 0))})
    ranges = [F.when(F.col(f"_{name}.low").isNotNull(), F.concat(F.lit(name.removeprefix("target_") + ":"), F.col(f"_{name}.low"), F.lit("~"), F.col(f"_{name}.high"))) for name in LABELS]
    made = {name: F.col(f"_{name}.value") for name in LABELS} | {
        "target_pbr": F.when((F.col("_pbr") > 0) & (F.col("_pbr") <= LARGEST_PBR), F.col("_pbr")),
        "period_start": F.col("_p.s"),
        "period_end": F.col("_p.e"),
        "buyback_planned": F.when(F.col("_window") != "", ~F.col("_window").rlike(NEGATION)),
        "target_ranges": F.nullif(F.concat_ws(",", *ranges), F.lit("")),
    }
    return out.withColumns(made).drop(*(f"_{name}" for name in LABELS), "_p", "_pbr", "_window")


def squeeze(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "\\s+", "")


def is_plan_report(c: str | Column) -> Column:
    t = squeeze(c)
    return F.contains(t, F.lit("기업가치제고계획")) & ~t.rlike("이행현황|철회")


# Goal words (two letters each) within 25 characters of a figure, and how a text names an earlier filing.
FIGURE_GOAL, FIGURE, FIGURE_NEAR = "(?:목표|지향|이상|달성|확대|중반)", "(?<![0-9])[0-9]+(?:\\.[0-9]+)?\\s*(?:%|배)", 25 - 2
EARLIER_FILING = "(?:旣|기)\\s*공시\\s*[(（]?\\s*(20[0-9]{2})\\s*[.\\-/]\\s*([0-9]{1,2})\\s*[.\\-/]\\s*([0-9]{1,2})"


def has_numeric_target(c: str | Column) -> Column:
    """A figure in per cent or times with a goal word within 25 characters on its line."""
    gap = f".{{0,{FIGURE_NEAR}}}?"
    return F.exists(F.split(col(c), "\\n"), lambda line: line.rlike(f"{FIGURE_GOAL}{gap}{FIGURE}|{FIGURE}{gap}{FIGURE_GOAL}"))


def referenced_date(c: str | Column) -> Column:
    """The day that a text names first as an earlier filing's; null if that is no day of the calendar, whatever follows."""
    y, m, d = (F.regexp_extract(col(c), EARLIER_FILING, g) for g in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd").cast("string")


def classify_body(text: str, axes: str) -> Column:
    c = F.col(text)
    return F.when(F.col(axes) > 0, "axis_targets").when(referenced_date(c).isNotNull(), "refiling").when(c.rlike("재공시|기공시한 경우|旣공시") & ~has_numeric_target(c), "refiling").when(has_numeric_target(c), "other_metric").otherwise("no_targets")


def declares_no_attachment(c: str | Column) -> Column:
    return squeeze(c).rlike("첨부없이|첨부를생략|첨부서류를생략|첨부생략")


def references_external(c: str | Column) -> Column:
    return squeeze(c).rlike("첨부된|첨부파일|첨부한|첨부를참조|첨부참조|첨부문서")


def is_notice(c: str | Column) -> Column:
    return F.contains(squeeze(c), F.lit("예고(안내공시)/("))


def unrankable_reason(text: str, axes: str, unreadable: str) -> Column:
    """Why a plan has no rank: not said, not readable, only announced, or nothing stated; null if it has one."""
    c = F.col(text)
    return F.when(F.col(axes) > 0, F.lit(None)).when(declares_no_attachment(c), "undisclosed").when(F.col(unreadable), "unreadable").when(is_notice(c), "notice").otherwise("unstated")


def related_url(c: str | Column, own_hosts: list[str]) -> Column:
    """The first foreign URL behind the related page label, else the first at all; closing marks go."""
    p = "https?://[^\\s<>\"']+"
    own = "|".join(h.replace(".", "\\.") for h in own_hosts) or "(?!)"
    urls = lambda x: F.filter(F.regexp_extract_all(x, F.lit(p), F.lit(0)), lambda u: ~u.rlike(own))
    near = urls(F.regexp_extract(col(c), "관련\\s*웹페이지([\\s\\S]{0,200})", 1))
    return F.regexp_replace(F.coalesce(F.try_element_at(near, F.lit(1)), F.try_element_at(urls(col(c)), F.lit(1))), "[.,;)]+$", "")


def without_dots(segments: Column) -> Column:
    """Path segments with `.` left out and `..` taking the segment before it along; a last one leaves an empty segment."""
    none = F.expr("cast(array() AS array<string>)")
    shorter = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    kept = F.aggregate(segments, none, lambda s, x: F.when(x == "..", shorter(s)).when(x == ".", s).otherwise(F.array_append(s, x)))
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)


def absolute_url(base: str | Column, link: str | Column) -> Column:
    """A link as its page means it: relative to the page's folder, its root, its host or its scheme; `.` and `..` are folded.

    Links with a scheme of their own, or with the page's scheme and a host, stay as they are. An empty link is the page; only
    a query or a fragment goes to the page's path. Paths without dot segments are not folded. No page, no change.
    """
    url, h = F.trim(col(base)), F.trim(col(link))
    part = lambda c, p, g: F.regexp_extract(c, p, g)
    whole = "^([a-zA-Z][a-zA-Z0-9+.\\-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?"
    scheme, host, path, query = (part(url, whole, g) for g in (1, 2, 3, 4))
    own = part(h, "^([a-zA-Z][a-zA-Z0-9+.\\-]*):", 1)
    same = F.lower(own) == F.lower(scheme)
    # a link with the page's scheme and no host is relative
    rel = F.when((own != "") & same, F.substr(h, F.length(own) + 2)).otherwise(h)
    own_path, own_query, fragment = part(rel, "^[^?#]*", 0), part(rel, "^[^?#]*(\\?[^#]+)", 1), part(rel, "#.+$", 0)

    def joined(split: Column, rooted: Column) -> Column:
        """Path segments of folder and link; empty ones between the first and the last go where the folder takes part."""
        n = F.size(split)
        inner = F.filter(split, lambda x, i: (i == 0) | (i == n - 1) | (x != ""))
        return F.when(rooted, split).otherwise(inner)

    rooted = F.startswith(own_path, F.lit("/"))
    folder = F.regexp_replace(path, "[^/]*$", "")
    segments = held(F.split(F.when(rooted, own_path).otherwise(F.concat(folder, own_path)), "/", -1), lambda s: joined(s, rooted))
    folded = F.when(F.concat(F.lit("/"), own_path, F.lit("/")).rlike("/\\.\\.?/") | path.rlike("/\\.\\.?(/|$)"), held(segments, without_dots)).otherwise(segments)
    full = F.regexp_replace(F.array_join(folded, "/"), "^(?!/)", "/")
    root = F.concat(scheme, F.lit("://"), host)
    moved = F.when(own_path == "", F.concat(root, path, F.when(own_query != "", own_query).otherwise(query), fragment)).otherwise(F.concat(root, full, own_query, fragment))
    hosted = F.startswith(rel, F.lit("//"))
    return F.when(F.coalesce(scheme, F.lit("")) == "", h).when((own != "") & ~same, h).when(hosted & (own != ""), F.concat(F.lower(own), F.lit(":"), rel)).when(hosted, F.concat(scheme, F.lit(":"), rel)).when(h == "", url).otherwise(moved)


def unescaped(c: Column) -> Column:
    """The character references of mark-up's own characters, and those that stand for a blank and quotes."""
    for name, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def anchors(html: str | Column) -> Column:
    """array<struct<href, label>>: the closed links of a page in their order; an inner link takes an outer one's place.

    Scripts, styles and comments hold no links; one that is not closed goes to the end. The page is cut where links begin.
    """
    page = F.regexp_replace(col(html), "(?is)<(?:script|style)\\b.*?(?:</(?:script|style)\\s*>|\\z)", "")
    page = F.regexp_replace(page, "(?s)<!--.*?(?:-->|\\z)", "")
    pieces = held(F.split(page, "(?i)<a(?=\\s)", -1), lambda s: F.slice(s, F.lit(2), F.size(s)))

    def link(p: Column) -> Column:
        tag = F.substring_index(p, ">", 1)
        rest = F.substr(p, F.length(tag) + 2)
        end = F.locate("</a", F.lower(rest))
        quoted = "(?is)\\shref\\s*=\\s*"
        href = F.coalesce(*(F.nullif(F.regexp_extract(tag, quoted + v, 1), F.lit("")) for v in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")))
        text = F.regexp_replace(F.regexp_replace(F.substr(rest, F.lit(1), end - 1), "<[^>]*>", "\u0001"), "\u0001+", " ")
        return F.when(end > 0, F.struct(unescaped(href).alias("href"), F.trim(unescaped(text)).alias("label")))

    return F.filter(F.transform(pieces, link), lambda a: a["href"].isNotNull())


LABEL_CHARS = 80


def plan_links(pages: DataFrame, words: list[str], exclude: list[str], suffix: str = ".pdf") -> DataFrame:
    """(page_id, href, label, pos, score): a page's links that hold the suffix, once each by their absolute URL.

    Links with an excluded word in URL or text go. A word in the URL scores 2, one in the text 1, however many there are.
    """
    x = pages.select("page_id", "url", F.posexplode(anchors("html")).alias("pos", "a"))
    x = x.select("page_id", "pos", absolute_url("url", "a.href").alias("href"), F.col("a.label").alias("label")).where(F.contains(F.lower("href"), F.lit(suffix)))
    x = x.groupBy("page_id", "href").agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"))

    def holds(c: str, said: list[str]) -> Column:
        hit = F.lit(False)
        for w in said:
            hit = hit | F.contains(F.lower(c), F.lit(w))
        return hit

    x = x.where(~holds("href", exclude) & ~holds("label", exclude))
    score = 2 * holds("href", words).cast("int") + holds("label", words).cast("int")
    return x.select("page_id", "href", F.substring("label", 1, LABEL_CHARS).alias("label"), "pos", score.alias("score"))


def best_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, href, error) for each page: its best link if that scores, the first of equal ones, else why there is none."""
    best = F.max_by("href", F.struct("score", -F.col("pos")))
    g = links.groupBy("page_id").agg(best.alias("best"), F.max("score").alias("score"), F.count("*").alias("n"))
    j = pages.select("page_id").join(g, "page_id", "left")
    error = F.when(F.col("n").isNull(), "no_pdf_links").when(F.col("score") == 0, F.concat(F.lit("ambiguous:"), "n", F.lit("_pdfs")))
    return j.select("page_id", F.when(F.col("score") > 0, F.col("best")).alias("href"), error.alias("error"))


def merge_pages(pages: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of pages (plan_id, page, is_ocr and fields) to a row per plan: each field from its first native page, OCR pages only after; with the pages and needs_review."""
    order = F.struct("is_ocr", "page")
    aggs = []
    for f in fields:
        at = F.when(F.col(f).isNotNull(), order)
        aggs += [F.min_by(f, at).alias(f), F.min(at).alias(f"_{f}")]
    g = pages.groupBy("plan_id").agg(*aggs)
    review = F.lit(False)
    for f in fields:
        review = review | F.coalesce(F.col(f"_{f}.is_ocr"), F.lit(False))
    return g.select("plan_id", *fields, *(F.col(f"_{f}.page").alias(f"{f}_page") for f in fields), review.alias("needs_review"))


def readability(pages: DataFrame) -> DataFrame:
    """(plan_id, sparse_pages, parse_error): no text layer if no axis, no OCR page and fewer than max(20, 5 * pages) characters."""
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s", ""))
    g = pages.groupBy("plan_id").agg(F.count_if(chars < 50).alias("sparse_pages"), F.sum(chars).alias("c"), F.count("*").alias("n"), F.max("axes").alias("a"), F.max(F.col("is_ocr").cast("int")).alias("o"))
    return g.select("plan_id", "sparse_pages", F.when((F.col("a") == 0) & (F.col("o") == 0) & (F.col("c") < F.greatest(F.lit(20), 5 * F.col("n"))), "no_text_layer").alias("parse_error"))


def resolve_attachments(files: DataFrame, plans: DataFrame) -> DataFrame:
    """(filename, plan_id, reason): by receipt number, else by company and date; what is not found says why."""
    receipt, corp, day = F.regexp_extract("filename", "^([0-9]{14})", 1), F.regexp_extract("filename", "^([0-9]{8})_", 1), F.regexp_extract("filename", "^[0-9]{8}_([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    x = files.select("filename", F.nullif(receipt, F.lit("")).alias("rcept_no"), F.nullif(corp, F.lit("")).alias("corp_code"), F.nullif(day, F.lit("")).alias("disclosure_date"))
    a = plans.groupBy("rcept_no").agg(F.max("plan_id").alias("p1"))
    b = plans.groupBy("corp_code", "disclosure_date").agg(F.max("plan_id").alias("p2"))
    j = x.join(a, "rcept_no", "left").join(b, ["corp_code", "disclosure_date"], "left")
    plan = F.coalesce("p1", "p2")
    return j.select("filename", plan.alias("plan_id"), F.when(plan.isNull(), F.when(F.col("rcept_no").isNull() & F.col("corp_code").isNull(), "unreadable_name").otherwise("no_plan")).alias("reason"))


def replay_labels(stored: DataFrame, stored_col: str, got_col: str) -> DataFrame:
    return stored.groupBy(F.col(stored_col).alias("stored"), F.col(got_col).alias("got")).agg(F.count("*").alias("n"))


def attachment_worklist(chosen: DataFrame, attachments: DataFrame, axes: Column, include_partial: bool = False) -> DataFrame:
    """Plans whose attachment should be fetched: none done, none declared absent; those without any axis come first."""
    done = attachments.where("parse_error IS NULL").select("plan_id").distinct()
    x = chosen.withColumn("axes", axes).where("NOT coalesce(attachment_absent, false)").join(done, "plan_id", "left_anti")
    x = x.withColumn("priority", F.when(F.col("axes") == 0, 1).when(F.col("axes") < 4, 2)).where(F.col("priority") <= (2 if include_partial else 1))
    return x.select("plan_id", "corp_code", "priority", F.concat("rcept_no", F.lit(".pdf")).alias("save_as"))


def last_segment(c: str | Column) -> Column:
    """The body of a text's last segment."""
    return F.try_element_at(segments(c), F.lit(-1))["body"]


def signal_loss(df: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """(key, phrase): phrases that a text holds before cleaning and not after."""
    both = df.select(key, F.regexp_replace(F.col(text), "\\s+", " ").alias("raw"), F.regexp_replace(clean(text), "\\s+", " ").alias("done"))
    lost = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains("raw", p) & ~F.contains("done", p))
    return both.select(key, F.explode(lost).alias("phrase"))


def backfill_signals(plans: DataFrame, text: str, axes: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals computed anew from the stored texts (replacing the old), and two distributions: of the signals, and of the attachment marks."""
    out = plans.withColumns({"body_signal": classify_body(text, axes), "body_reference_date": referenced_date(text), "attachment_absent": declares_no_attachment(text)})
    return out, out.groupBy("body_signal").agg(F.count("*").alias("n")), out.groupBy("attachment_absent").agg(F.count("*").alias("n"))
