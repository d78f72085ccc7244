"""Idempotent loads: three update policies, backfills, reviews, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pledgelens.functions.values import finite, macro_date, parse_ratio

MACRO_INDICATORS = ["base_rate", "bond_3y", "usd_krw", "cpi"]


def upsert_keep(base: DataFrame, inc: DataFrame, keys: list[str], always: list[str] | None = None) -> DataFrame:
    """Raw facts: new keys come in, and of known keys the values that are not null; `always` columns are taken as they come."""
    b, i = base.alias("b"), inc.withColumn("_new", F.lit(True)).alias("i")
    j = b.join(i, keys, "full")
    values = [c for c in base.columns if c not in keys]
    take = lambda c: F.when(F.col("i._new"), F.col(f"i.{c}")).otherwise(F.col(f"b.{c}")) if c in (always or []) else F.coalesce(F.col(f"i.{c}"), F.col(f"b.{c}"))
    return j.select(*keys, *(take(c).alias(c) for c in values)).select(*base.columns)


def upsert_replace(base: DataFrame, inc: DataFrame, keys: list[str], sticky: list[str] | None = None) -> DataFrame:
    """Computed rows: an incoming row replaces the whole old one, nulls too; `sticky` columns are never replaced by null."""
    if sticky:
        old = base.select(*keys, *(F.col(c).alias(f"_{c}") for c in sticky))
        inc = inc.join(old, keys, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in sticky})
    return base.join(inc.select(*keys), keys, "left_anti").unionByName(inc.select(*base.columns))


def reconcile(base: DataFrame, inc: DataFrame, as_of: str, corp_codes: DataFrame | None = None) -> DataFrame:
    """Rows of a day whose basis is gone are deleted; other days, and companies outside a given subset, stay."""
    hit = F.col("as_of") == as_of
    if corp_codes is None:
        return base.where(~hit).unionByName(inc.select(*base.columns))
    touched = base.where(hit).join(corp_codes, "corp_code", "left_semi").select("corp_code", "as_of")
    return base.join(touched, ["corp_code", "as_of"], "left_anti").unionByName(inc.join(corp_codes, "corp_code", "left_semi").select(*base.columns))


def range_map(c: str | Column) -> Column:
    """`roe:11~13,payout:30~40` as a map."""
    return F.str_to_map(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(","), F.lit(":"))


def merge_ranges(old: str, new: str) -> Column:
    """Range texts by axis: axes of the old stay as they are and come first, missing ones are added."""
    parts = F.filter(F.split(F.coalesce(F.nullif(new, F.lit("")), F.lit("")), ","), lambda p: (p != "") & ~F.coalesce(F.map_contains_key(range_map(old), F.split(p, ":")[0]), F.lit(False)))
    return F.nullif(F.concat_ws(",", F.nullif(F.col(old), F.lit("")), F.nullif(F.array_join(parts, ","), F.lit(""))), F.lit(""))


def backfill_targets(plans: DataFrame, parsed: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Recomputed values fill nulls only; (plans, conflicts), the conflicts being (plan_id, field, old, new)."""
    j = plans.join(parsed.select("plan_id", *(F.col(f).alias(f"_{f}") for f in fields)), "plan_id", "left")
    filled = j.withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).select(*plans.columns)
    named = ", ".join(f"'{f}', cast({f} AS string), cast(_{f} AS string)" for f in fields)
    conflicts = j.select("plan_id", F.expr(f"stack({len(fields)}, {named}) AS (field, old, new)")).where("old <> new")
    return filled, conflicts


REVIEW = ["needs_review", "reviewed_by", "review_note"]


def upsert_attachments(base: DataFrame, inc: DataFrame) -> DataFrame:
    """By plan and file: an unchanged hash skips the row, changed content resets its review."""
    keys = ["plan_id", "filename"]
    old = base.select(*keys, F.col("sha256").alias("_sha"))
    changed = inc.join(old, keys, "left").where("_sha IS NULL OR sha256 <> _sha").drop("_sha")
    fresh = changed.withColumns({c: F.lit(None).cast(base.schema[c].dataType) for c in REVIEW if c != "needs_review"})
    return base.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*base.columns))


#: Fields that a review may override, by the type that its text must have.
OVERRIDABLE = {
    "target_roe": "double",
    "target_payout_ratio": "double",
    "target_total_return_ratio": "double",
    "target_pbr": "double",
    "period_start": "string",
    "period_end": "string",
    "buyback_planned": "boolean",
}
NOTE_CHARS, ERROR_CHARS = 300, 200


def typed(raw: Column, kind: str) -> tuple[Column, Column]:
    """The value of an override's text, and whether the text is one: none, null and blank clear the field."""
    t = F.lower(F.trim(raw))
    clear = t.isin("none", "null", "")
    if kind == "boolean":
        value = F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)
    elif kind == "double":
        value = finite(t.try_cast("double"))
    else:
        value = F.trim(raw)
    return F.when(~clear, value), clear | value.isNotNull()


def checked_reviews(attachments: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decisions with `errors`: array<string>; a decision with an error must not be applied at all.

    decisions: filename, decision (approve or reject), reviewer, overrides (map of field to text), reason, note, day.
    """
    keys = F.coalesce(F.map_keys("overrides"), F.expr("cast(array() AS array<string>)"))
    known = attachments.select(F.col("filename").alias("_file")).distinct()
    d = decisions.withColumn("_times", F.count("*").over(Window.partitionBy("filename"))).join(known, F.col("filename") == F.col("_file"), "left")
    approves = F.coalesce(F.col("decision") == "approve", F.lit(False))
    bad = []
    for f, kind in OVERRIDABLE.items():
        raw = F.try_element_at("overrides", F.lit(f))
        bad.append(F.when(F.array_contains(keys, f) & ~F.coalesce(typed(raw, kind)[1], F.lit(False)), F.lit(f"bad_value:{f}")))
    errors = F.array(
        F.when(~F.coalesce(F.col("decision").isin("approve", "reject"), F.lit(False)), "unknown_decision"),
        F.when(F.coalesce(F.trim("reviewer"), F.lit("")) == "", "no_reviewer"),
        F.when(~approves & (F.size(keys) > 0), "overrides_without_approval"),
        F.when(F.col("_times") > 1, "several_decisions"),
        F.when(F.col("_file").isNull(), "no_attachment"),
        *bad,
    )
    unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, OVERRIDABLE))), lambda f: F.concat(F.lit("unknown_field:"), f))
    return d.withColumn("errors", F.concat(F.array_compact(errors), unknown)).drop("_times", "_file")


def apply_reviews(attachments: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attachments after the reviews, errors as (filename, error)); decisions as in `checked_reviews`.

    Approved rows take the typed overrides and lose their flag; rejected rows get an error and lose their flag. The note says
    what was set, old -> new, behind the reviewer's own words. A decision with an error changes nothing.
    """
    d = checked_reviews(attachments, decisions)
    errors = d.select("filename", F.explode("errors").alias("error"))
    good = d.where(F.size("errors") == 0).select("filename", *(F.col(c).alias(f"_{c}") for c in ("decision", "reviewer", "overrides", "reason", "note", "day")))
    j = attachments.join(good, "filename", "left")
    approved, rejected = F.col("_decision") == "approve", F.col("_decision") == "reject"
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    new, said = {}, []
    for f, kind in OVERRIDABLE.items():
        given = F.coalesce(approved & F.map_contains_key(F.coalesce("_overrides", F.expr("cast(map() AS map<string, string>)")), F.lit(f)), F.lit(False))
        value = typed(F.try_element_at("_overrides", F.lit(f)), kind)[0]
        new[f] = F.when(given, value).otherwise(F.col(f))
        said.append(F.when(given, F.concat(F.lit(f"{f}: "), shown(F.col(f)), F.lit(" -> "), shown(value))))
    own = F.nullif(F.array_join(F.array_compact(F.array(*said)), "; "), F.lit(""))
    note = F.nullif(F.substring(F.concat_ws(" | ", F.nullif(F.col("_note"), F.lit("")), own), 1, NOTE_CHARS), F.lit(""))
    made = new | {
        "needs_review": F.when(approved | rejected, False).otherwise(F.col("needs_review")),
        "parse_error": F.when(rejected, F.substring(F.concat(F.lit("review_rejected:"), F.coalesce("_reason", F.lit(""))), 1, ERROR_CHARS)).otherwise(F.col("parse_error")),
        "reviewed_by": F.when(approved | rejected, F.col("_reviewer")).otherwise(F.col("reviewed_by")),
        "review_note": F.when(approved | rejected, note).otherwise(F.col("review_note")),
    }
    if "reviewed_at" in attachments.columns:
        made["reviewed_at"] = F.when(approved | rejected, F.col("_day")).otherwise(F.col("reviewed_at"))
    return j.select(*(made[c].alias(c) if c in made else F.col(c) for c in attachments.columns)), errors


def merge_prices(ohlcv: DataFrame, cap: DataFrame) -> DataFrame:
    """Closing prices and market caps of two sources by day; a side that lacks the day gives nulls."""
    for df, need in ((ohlcv, {"close", "volume"}), (cap, {"market_cap", "trading_value"})):
        if missing := need - set(df.columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
    keys = ["corp_code", "date"]
    return ohlcv.select(*keys, "close", "volume").join(cap.select(*keys, "market_cap", "trading_value"), keys, "full")


def normalize_macro(rows: DataFrame) -> DataFrame:
    """Landed (indicator, time, data_value, frequency): known indicators and readable times, blank marks as null."""
    value = F.when(~F.trim("data_value").isin("", "-", ".", "N/A"), parse_ratio("data_value"))
    return rows.where(F.col("indicator").isin(MACRO_INDICATORS)).select("indicator", macro_date("time").alias("date"), value.alias("value"), "frequency").where("date IS NOT NULL")


def violations(df: DataFrame, rules: dict[str, Column], key: list[str], unique: bool = True) -> DataFrame:
    """(rule, key) for each row that breaks a rule (a rule that is null holds), and for each key that is there twice."""
    name = F.concat_ws("|", *(F.col(k).cast("string") for k in key))
    broken = F.array_compact(F.array(*(F.when(~c, F.lit(r)) for r, c in rules.items())))
    out = df.select(F.explode(broken).alias("rule"), name.alias("key"))
    if unique:
        out = out.unionByName(df.groupBy(*key).count().where("count > 1").select(F.lit("unique").alias("rule"), name.alias("key")))
    return out


def orphans(df: DataFrame, company: DataFrame) -> DataFrame:
    """Keys without a company."""
    return df.select("corp_code").distinct().join(company, "corp_code", "left_anti")
