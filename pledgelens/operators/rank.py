"""Mid-rank percentiles of many populations in one pass, and the choice of the population to rank in.

All values to rank go through one long table (population, value). It is reduced to a row for each different value,
partitioned by ranges of (population, value) and written once. Each population's rows in each range are counted; running
sums of these counts, a table of a row for each population and range at most, are the offsets, and the sums
inside a range run in a window of that range. No task sorts a population whole, and nothing is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pledgelens.functions.values import finite
from pledgelens.sources.store import written

#: The population of all rows of an indicator.
MARKET = "market"


def running_counts(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _v, _eq, _upto, _n for each different value: its rows, the rows up to it, and the population's rows.

    `values` has the population's keys (null is one) and a value _v without nulls.
    """
    each = values.groupBy(*keys, "_v").agg(F.count("*").alias("_eq"))
    ranged = written(each.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.sum("_eq").alias("_t"))
    whole = Window.partitionBy(*keys)
    offsets = counts.withColumn("_n", F.sum("_t").over(whole)).withColumn("_before", F.sum("_t").over(whole.orderBy("_range")) - F.col("_t"))
    offsets = offsets.select(*(F.col(k).alias(f"_o{k}") for k in keys), F.col("_range").alias("_o_range"), "_before", "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys] + [F.col("_range") == F.col("_o_range")]
    upto = F.sum("_eq").over(Window.partitionBy("_range", *keys).orderBy("_v"))
    x = ranged.withColumn("_within", upto).join(offsets, on=same)
    return x.select(*keys, "_v", "_eq", (F.col("_before") + F.col("_within")).alias("_upto"), "_n")


def rank_values(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _v, _rank, _n for each different value: (below + (equal - 1) / 2) / (n - 1), null in populations under two."""
    below = F.col("_upto") - F.col("_eq")
    rank = F.when(F.col("_n") > 1, (below + (F.col("_eq") - 1) / 2.0) / (F.col("_n") - 1))
    return running_counts(values, keys).select(*keys, "_v", rank.alias("_rank"), "_n")


def exact_medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and median (double) of each population of values _v: the mean of the two in the middle.

    The middle places are read off the running counts, so no task or buffer holds a population's values.
    """
    middle = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    low, high = middle(F.floor((F.col("_n") - 1) / 2)), middle(F.floor(F.col("_n") / 2))
    g = running_counts(values, keys).groupBy(*keys).agg(F.max("_n").alias("n"), low.alias("_low"), high.alias("_high"))
    return g.select(*keys, "n", ((F.col("_low") + F.col("_high")) / 2.0).alias("median"))


def mid_rank(df: DataFrame, value: str, out: str, group: list[Column] | None = None, low_is_good: bool = False) -> DataFrame:
    """Add the mid-rank of a value in its group; null for values that are no finite numbers and groups under two."""
    keys = {f"_g{i}": g for i, g in enumerate(group or [F.lit(0)])}
    rows = df.withColumns(keys | {"_v": finite(value)})
    each = rank_values(rows.where("_v IS NOT NULL").select(*keys, "_v"), list(keys))
    each = each.withColumn(out, 1.0 - F.col("_rank") if low_is_good else F.col("_rank")).select(*keys, "_v", out)
    same = [rows[k].eqNullSafe(each[k]) for k in keys] + [rows["_v"] == each["_v"]]
    joined = rows.join(each, on=[c for c in same], how="left")
    return joined.select(*(rows[c] for c in df.columns), each[out])


def population_basis(df: DataFrame, indicators: list[str], bucket: str, least: int = 5) -> DataFrame:
    """Add ready and basis: a bucket is ready if each indicator has at least `least` finite values in it."""
    counts = df.where(F.col(bucket).isNotNull()).groupBy(bucket).agg(*(F.count(finite(c)).alias(f"_n_{c}") for c in indicators))
    ready = counts.select(bucket, F.least(*(F.col(f"_n_{c}") for c in indicators), F.lit(1 << 30)).alias("_least")).select(bucket, (F.col("_least") >= least).alias("_ready"))
    out = df.join(ready, bucket, "left").withColumn("ready", F.coalesce("_ready", F.lit(False))).drop("_ready")
    return out.withColumn("basis", basis(F.col(bucket), F.col("ready")))


def basis(bucket: Column, ready: Column) -> Column:
    """Which population a row is ranked in: its bucket where that is ready, else all rows."""
    return F.when(bucket.isNull(), MARKET).when(ready, F.concat(F.lit("sector:"), bucket)).otherwise("market_fallback")


def rank_few(df: DataFrame, value: str, out: str, bucket: str, least: int = 5) -> DataFrame:
    """Add basis and the mid-rank in it, for a value of few kinds: from one table of counts by bucket and value.

    A bucket is ready from `least` rows with a finite value on. The windows run over the kinds of values and buckets.
    """
    rows = df.withColumn("_v", finite(value))
    counts = rows.where("_v IS NOT NULL").groupBy(F.col(bucket).alias("_b"), F.col("_v").alias("_w")).agg(F.count("*").alias("_own"))
    own, upto = Window.partitionBy("_b"), Window.partitionBy("_b").orderBy("_w")
    total = Window.partitionBy("_w")
    x = counts.withColumns({"_n": F.sum("_own").over(own), "_upto": F.sum("_own").over(upto), "_all": F.sum("_own").over(total)})
    # all rows: each value once, whatever its bucket
    kinds = x.groupBy("_w").agg(F.max("_all").alias("_eq"))
    every = Window.partitionBy(F.lit(0))
    kinds = kinds.withColumn("_below", F.sum("_eq").over(every.orderBy("_w")) - F.col("_eq")).withColumn("_size", F.sum("_eq").over(every))
    rank = lambda below, eq, n: F.when(n > 1, (below + (eq - 1) / 2.0) / (n - 1))
    market = kinds.select(F.col("_w").alias("_k"), rank(F.col("_below"), F.col("_eq"), F.col("_size")).alias("_whole"))
    ready = F.col("_b").isNotNull() & (F.col("_n") >= least)
    x = x.join(market, F.col("_w") == F.col("_k"))
    x = x.select("_b", "_w", ready.alias("_ready"), F.when(ready, rank(F.col("_upto") - F.col("_own"), F.col("_own"), F.col("_n"))).otherwise(F.col("_whole")).alias("_rank"))
    j = rows.join(x, rows[bucket].eqNullSafe(x["_b"]) & (rows["_v"] == x["_w"]), "left")
    return j.select(*(rows[c] for c in df.columns), basis(rows[bucket], F.coalesce("_ready", F.lit(False))).alias("basis"), F.col("_rank").alias(out))


def rank_indicators(long: DataFrame, keys: list[str], indicators: dict[str, bool], promoted: list[str], least: int = 5) -> DataFrame:
    """keys, basis and p_<indicator> for each indicator (True: low is good), all populations in one pass.

    `long` has keys, bucket, indicator, value and is read twice: give a written table. The `promoted` indicators are
    ranked in the row's bucket if that is ready, which is if each of them has at least `least` finite values there, else
    among all rows; the other indicators always among all rows. basis is null for rows without a promoted indicator's row.
    """
    finite_rows = long.withColumn("_v", finite("value"))
    split = F.when(F.col("indicator").isin(promoted) & F.col("bucket").isNotNull(), F.array(F.lit(None).cast("string"), F.col("bucket"))).otherwise(F.array(F.lit(None).cast("string")))
    values = finite_rows.where("_v IS NOT NULL").select(F.explode(split).alias("_pop"), F.col("indicator").alias("_ind"), "_v")
    each = written(rank_values(values, ["_pop", "_ind"]))
    sizes = each.where("_pop IS NOT NULL").groupBy("_pop", "_ind").agg(F.max("_n").alias("_n"))
    ready = sizes.groupBy(F.col("_pop").alias("bucket")).agg(((F.count("*") == len(promoted)) & (F.min("_n") >= least)).alias("_ready"))
    rows = finite_rows.join(ready, "bucket", "left").withColumn("_ready", F.coalesce("_ready", F.lit(False)))
    home = F.when(F.col("indicator").isin(promoted) & F.col("_ready"), F.col("bucket"))
    rows = rows.select(*keys, "bucket", "_ready", "indicator", home.alias("_home"), F.col("_v").alias("_value"))
    j = rows.join(each.drop("_n"), F.col("_home").eqNullSafe(F.col("_pop")) & (F.col("indicator") == F.col("_ind")) & (F.col("_value") == F.col("_v")), "left")
    pick = [F.max(F.when(F.col("indicator") == c, 1.0 - F.col("_rank") if low else F.col("_rank"))).alias(f"p_{c}") for c, low in indicators.items()]
    own = F.max(F.when(F.col("indicator").isin(promoted), basis(F.col("bucket"), F.col("_ready"))))
    return j.groupBy(*keys).agg(own.alias("basis"), *pick)
