"""Deterministic samples, splits and quotas; every order is total and replayable through sha2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_key(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(key.cast("string"), F.lit(f"::seed={seed}")), 256)


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows whose seeded hash is smallest."""
    return df.withColumn("_h", hash_key(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def hash_split(groups: DataFrame, key: str, seed: int, shares: tuple[float, float]) -> DataFrame:
    """train / validation / test of a small table of groups by hash rank."""
    w = Window.orderBy(hash_key(F.col(key), seed), key)
    share = F.row_number().over(w) / F.count("*").over(Window.partitionBy())
    return groups.withColumn("split", F.when(share <= shares[0], "train").when(share <= shares[0] + shares[1], "validation").otherwise("test"))


def balanced_folds(sizes: DataFrame, key: str, n: str, folds: int) -> list[tuple]:
    """(group, fold): the largest groups first, each to the fold that is smallest so far; for small group tables."""
    totals = [0] * folds
    out = []
    for g, k in sorted(((r[key], r[n]) for r in sizes.collect()), key=lambda x: (-x[1], x[0])):
        fold = min(range(folds), key=lambda f: (totals[f], f))
        totals[fold] += k
        out.append((g, fold))
    return out


def quotas(strata: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Largest-remainder quotas of a small table of strata, at least 1 each."""
    everything = Window.partitionBy()
    exact = F.col(n) * float(total) / F.sum(n).over(everything)
    base = strata.withColumn("_e", exact).withColumn("_f", F.greatest(F.floor("_e"), F.lit(1)))
    left = F.greatest(F.lit(total) - F.sum("_f").over(everything), F.lit(0))
    rank = F.row_number().over(Window.orderBy((F.col("_e") - F.floor("_e")).desc(), key))
    return base.withColumn("quota", (F.col("_f") + (rank <= left).cast("int")).cast("long")).drop("_e", "_f")


def stratified(df: DataFrame, stratum: str, key: str, quota: DataFrame, seed: int, best: list[Column] | None = None) -> DataFrame:
    """Quota rows of each stratum: best support first, seeded ties."""
    w = Window.partitionBy(stratum).orderBy(*(best or []), hash_key(F.col(key), seed), key)
    return df.join(quota.select(stratum, "quota"), stratum).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def spread(df: DataFrame, block: str, order: str, n: int) -> DataFrame:
    """n evenly spaced rows of each block (half-even rounding of positions)."""
    w = Window.partitionBy(block)
    size = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(order)) - 1
    places = F.transform(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_n")).cast("int") - 1), lambda i: F.bround(i * (F.col("_n") - 1) / F.greatest(F.least(F.lit(n), F.col("_n")) - 1, F.lit(1)), 0).cast("long"))
    return df.withColumn("_n", size).withColumn("_i", at.cast("long")).where(F.array_contains(places, F.col("_i"))).drop("_n", "_i")
