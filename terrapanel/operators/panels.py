"""Aggregations of records into panels, window functions over panels, and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = 500.0


def lattice_cell(df: DataFrame, x: str = "x", y: str = "y", size: float = CELL) -> DataFrame:
    """Add row and col of the half-open cell [x0, x1) x [y0, y1), and the distance to its nearest edge."""
    col, row = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    dx, dy = F.col(x) - col * size, F.col(y) - row * size
    edge = F.least(dx, size - dx, dy, size - dy)
    return df.withColumn("row", row.cast("int")).withColumn("col", col.cast("int")).withColumn("edge", edge)


def poi_counts(df: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """Row count, flag sums and a count of each category for every key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("poi_count"),
        F.sum("is_commercial").alias("n_commercial"),
        F.sum("is_chain").alias("n_chain"),
        F.sum("is_community_commerce").alias("n_community"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in categories],
    )


def entropy(counts: list[Column]) -> Column:
    """-sum(p ln p) over the positive counts; 0 where there is none."""
    positive = F.filter(F.array(*[c.cast("double") for c in counts]), lambda x: x > 0)
    total = F.aggregate(positive, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, -F.aggregate(positive, F.lit(0.0), lambda a, x: a + x / total * F.log(x / total))).otherwise(0.0)


def poi_finalize(parts: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """Sum partial counts and add entropy and shares; a share is null where there is no row."""
    sums = [c for c in parts.columns if c not in keys and c.startswith(("n_", "poi_count"))]
    out = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    out = out.withColumn("entropy", entropy([F.col(f"n_{c}") for c in categories]))
    for name in ("commercial", "chain", "community"):
        out = out.withColumn(f"{name}_share", F.try_divide(F.col(f"n_{name}"), F.col("poi_count")))
    return out


def canonical_samples(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key; ``conflict`` is true where its values differ (a null is a value of its own)."""
    n = F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))
    return df.groupBy(*keys).agg(F.min(value).alias(value), (n > 1).alias("conflict"), F.count("*").alias("n_rows"))


def change_metrics(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Previous value, new and exit proxies, and growth against a positive previous value."""
    lag = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    diff = F.col(value) - F.col("lag")
    return (
        df.withColumn("lag", lag)
        .withColumn("net_new", F.coalesce(F.greatest(diff, F.lit(0)), F.lit(0)))
        .withColumn("net_exit", F.coalesce(F.greatest(-diff, F.lit(0)), F.lit(0)))
        .withColumn("growth", F.when(F.col("lag") > 0, diff / F.col("lag")))
    )


def source_balanced(df: DataFrame, keys: list[str], source: str, price: str) -> DataFrame:
    """Median log price over source medians beside the raw median; dispersion is 0 for one source."""
    log = F.log(price)
    within = df.groupBy(*keys, source).agg(F.median(log).alias("m"), F.count("*").alias("n"), F.sum(price).alias("s"))
    balanced = within.groupBy(*keys).agg(
        F.median("m").alias("log_balanced"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("dispersion"),
        F.count("*").alias("n_sources"), F.sum("n").alias("n_observations"),
    )
    return balanced.join(df.groupBy(*keys).agg(F.median(log).alias("log_raw")), keys)


def source_signature(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Sorted set of sources and the most frequent one (the first in order among ties)."""
    counts = df.groupBy(*keys, source).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set(source)), ";").alias("signature"),
        F.element_at(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(source).alias("s")))), 1)["s"].alias("dominant"),
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    ok = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def trailing_mean(df: DataFrame, keys: list[str], t: str, value: str, width: int) -> DataFrame:
    """Mean of the last ``width`` event times after 0, only where min(width, t) of them are there; t <= 0 is untouched."""
    after = df.withColumn("_after", (F.col(t) > 0).cast("int"))
    w = Window.partitionBy(*keys, "_after").orderBy(t).rangeBetween(-(width - 1), 0)
    full = F.count(value).over(w) == F.least(F.lit(width), F.col(t))
    smooth = F.when(F.col(t) <= 0, F.col(value)).when(full, F.avg(value).over(w))
    return after.withColumn(f"{value}_window", smooth).drop("_after")


def latest_leads(df: DataFrame, keys: list[str], t: str, n: int) -> DataFrame:
    """Rows of the latest n different pre-event times of each key."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(t).desc()))
    return df.where(F.col(t) < 0).withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def percentile_rank(value: str, keys: list[str]) -> tuple[Column, Column]:
    """(average-rank percentile, rows) of a value within keys; nulls get no rank."""
    part = [*keys, F.col(value).isNull()]
    ordered = Window.partitionBy(*part).orderBy(value)
    ties = Window.partitionBy(*part, value)
    n = F.count(value).over(Window.partitionBy(*part))
    rank = F.rank().over(ordered) + (F.count(value).over(ties) - 1) / 2.0
    return F.when(F.col(value).isNotNull(), rank / n), n


def percentile_with_fallback(df: DataFrame, value: str, levels: list[list[str]], least: int = 30) -> DataFrame:
    """Percentile in the narrowest of the levels with at least ``least`` rows; 0.5 where no level has them."""
    choice = F.lit(None).cast("double")
    for keys in reversed(levels):
        p, n = percentile_rank(value, keys)
        choice = F.when(n >= least, p).otherwise(choice)
    return df.withColumn("percentile", F.when(F.col(value).isNotNull(), F.coalesce(choice, F.lit(0.5))))


def mark_duplicates(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """is_repeat: not the first of its key in the given total order; in_group: the key occurs more than once."""
    by_key = Window.partitionBy(*keys)
    return df.withColumn("is_repeat", F.row_number().over(by_key.orderBy(*order)) > 1).withColumn("in_group", F.count("*").over(by_key) > 1)


def winsorize(df: DataFrame, value: str, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to the group's quantiles, then divide by the group's mean; quantiles come from an aggregate and a join."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q"))
    clipped = df.join(q, keys).withColumn("clipped", F.least(F.greatest(F.col(value), F.col("q")[0]), F.col("q")[1]))
    mean = clipped.groupBy(*keys).agg(F.avg("clipped").alias("mean"))
    return clipped.join(mean, keys).withColumn("weight", F.try_divide("clipped", "mean")).drop("q", "mean")


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def chained_index(df: DataFrame, keys: list[str], t: str, multiplier: str, base: int) -> DataFrame:
    """Index of 100 in the base period: multiplied forwards (missing multipliers count as 1), divided backwards to the first gap."""
    ordered = Window.partitionBy(*keys).orderBy(t)
    ahead = F.sum(F.when(F.col(t) > base, F.coalesce(F.log(multiplier), F.lit(0.0)))).over(ordered)
    back = Window.partitionBy(*keys).orderBy(F.col(t).desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum(F.when(F.col(t) <= base, F.log(multiplier))).over(back)
    gap = F.coalesce(F.max(F.when((F.col(t) <= base) & F.col(multiplier).isNull(), 1)).over(back), F.lit(0))
    up = F.when(F.col(t) >= base, 100 * F.exp(F.coalesce(ahead, F.lit(0.0))))
    down = F.when((F.col(t) < base) & (gap == 0), 100 * F.exp(-F.coalesce(before, F.lit(0.0))))
    return df.withColumn("index", F.coalesce(up, down))
