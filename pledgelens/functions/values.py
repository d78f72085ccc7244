"""Null-safe value expressions. Unknown stays null; it never becomes zero or false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value if it is a finite number, else null."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def guarded(numerator: str | Column, denominator: str | Column, factor: float = 1.0, digits: int = 2) -> Column:
    """factor * numerator / denominator, rounded; null unless the denominator is above zero."""
    n, d = col(numerator).cast("double"), col(denominator).cast("double")
    return F.round(F.when(d > 0, n * factor / d), digits)


def clamp01(c: Column) -> Column:
    """The value limited to [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def sector_bucket(c: str | Column) -> Column:
    """The first two digits of a sector code, null if they are not digits."""
    head = F.substring(F.trim(col(c)), 1, 2)
    return F.when(head.rlike("^[0-9]{2}$"), head)


def parse_amount(c: str | Column) -> Column:
    """Amount text: commas and blanks go, (n) and a leading triangle or minus are negative, anything else is null."""
    t = F.regexp_replace(col(c), "[,\\s]", "")
    negative = t.rlike("^\\(.*\\)$") | t.rlike("^[△▲−-]")
    digits = F.regexp_replace(F.regexp_replace(t, "^\\((.*)\\)$", "$1"), "^[△▲−-]", "")
    number = F.when(digits.rlike("^[0-9]+$"), F.expr("1") * digits.try_cast("bigint"))
    return F.when(negative, -number).otherwise(number)


def parse_quantity(c: str | Column) -> Column:
    """parse_amount without negatives."""
    v = parse_amount(c)
    return F.when(v >= 0, v)


def parse_ratio(c: str | Column) -> Column:
    """Ratio text without commas and percent signs, if it is a finite number."""
    return finite(F.regexp_replace(F.trim(col(c)), "[,%]", "").try_cast("double"))


def to_iso(c: str | Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD, null unless it is a day of the calendar."""
    return F.when(col(c).rlike("^[0-9]{8}$"), F.date_format(F.try_to_date(col(c), "yyyyMMdd"), "yyyy-MM-dd"))


def macro_date(c: str | Column) -> Column:
    """YYYYMM as the first of the month, YYYYMMDD as the day, null for other lengths."""
    t = col(c)
    return F.when(t.rlike("^[0-9]{6}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.lit("01"))).when(t.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))


def period_buyback_status(bought: str | Column, retired: str | Column) -> Column:
    """Status of one reported period: a null beside a positive amount does not hide it."""
    b, r = col(bought), col(retired)
    return F.when(r > 0, "retired").when(b > 0, "purchased_only").when(b.isNotNull() | r.isNotNull(), "none")


def cap_bucket(c: str | Column) -> Column:
    """large from 10 trillion, mid from 1 trillion, small below; null for an unknown value."""
    v = col(c)
    return F.when(v >= 10**13, "large").when(v >= 10**12, "mid").when(v.isNotNull(), "small")


STARTS_BLOCK = 256


def held(value: Column, build) -> Column:
    """`build` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), build)[0]


def starts(lengths: Column) -> Column:
    """array<bigint>: the sum of the entries before each entry, in time linear in their number.

    Sums of blocks first, then the entries behind each block's sum, as an array that grows entry by entry is copied each time.
    """
    none, step = F.expr("cast(array() AS array<bigint>)"), STARTS_BLOCK
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
    sums = lambda xs, at: F.aggregate(xs, F.struct(at.alias("at"), none.alias("out")), add, lambda s: s["out"])
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def level(xs: Column, inner) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / step)), lambda b: F.slice(xs, (b * step + 1).cast("int"), F.lit(step)))

        def joined(parts: Column) -> Column:
            before = inner(F.transform(parts, total))
            return F.flatten(F.zip_with(parts, before, lambda part, at: sums(part, at)))

        return held(blocks, joined)

    flat = lambda xs: sums(xs, F.lit(0).cast("bigint"))
    made = held(lengths.cast("array<bigint>"), lambda xs: F.when(F.size(xs) == 0, none).otherwise(level(xs, lambda ys: held(ys, lambda zs: level(zs, flat)))))
    return made
