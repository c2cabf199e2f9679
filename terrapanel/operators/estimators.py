"""Design, matching and effect estimators. Spark reduces the data to sums and Gram matrices; numpy solves the small systems."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matching import TIE, top_k, top_k_ties  # noqa: F401
from .studies import event_studies


def event_time(day: Column, opening: Column) -> Column:
    """Whole months from the opening month."""
    return (F.year(day) - F.year(opening)) * 12 + F.month(day) - F.month(opening)


def event_calendar(units: DataFrame, lag: int = 36, last: int = 24, anticipation: int = 0) -> DataFrame:
    """Rows (unit, period, event_time, role): pre months end at the reference -(anticipation + 1)."""
    t = F.explode(F.sequence(F.lit(-anticipation - lag), F.lit(last))).alias("event_time")
    role = F.when(F.col("event_time") == -anticipation - 1, "reference").when(F.col("event_time") < -anticipation - 1, "pre")
    role = role.when(F.col("event_time") < 0, "anticipation").when(F.col("event_time") == 0, "opening").otherwise("post")
    return units.select("unit", "opening", t).select("unit", F.expr("add_months(opening, event_time)").alias("period"), "event_time", role.alias("role"))


def did_monthly(paths: DataFrame, horizons: list[int], window: int, anticipation: int, least: int = 1) -> DataFrame:
    """Change of treated minus change of control against the mean of the 12 months before anticipation, for each horizon.

    paths: (treated, t, y, y0) with treated and control outcome. A label is available where both have enough baseline
    months and every month of the window min(window, horizon).
    """
    base = F.col("t").between(-anticipation - 12, -anticipation - 1)
    aggs = [F.avg(F.when(base, F.col(c))).alias(f"{c}_base") for c in ("y", "y0")]
    aggs += [F.count(F.when(base, F.col(c))).alias(f"{c}_nbase") for c in ("y", "y0")]
    for h in horizons:
        inside = F.col("t").between(max(1, h - window + 1), h)
        for c in ("y", "y0"):
            aggs += [F.avg(F.when(inside, F.col(c))).alias(f"{c}_{h}"), F.count(F.when(inside, F.col(c))).alias(f"{c}_n{h}")]
    wide = paths.groupBy("treated").agg(*aggs)
    each = [
        F.struct(
            F.lit(h).alias("event_time"),
            F.col(f"y_{h}").alias("treated_post"),
            F.col(f"y0_{h}").alias("control_post"),
            ((F.col(f"y_n{h}") >= min(window, h)) & (F.col(f"y0_n{h}") >= min(window, h))).alias("supported"),
        )
        for h in horizons
    ]
    long = wide.select("*", F.explode(F.array(*each)).alias("e")).select("*", "e.*")
    enough = F.col("supported") & (F.col("y_nbase") >= least) & (F.col("y0_nbase") >= least)
    label = F.col("treated_post") - F.col("y_base") - (F.col("control_post") - F.col("y0_base"))
    return long.select("treated", "event_time", enough.alias("label_available"), F.when(enough, label).alias("effect"))


def type8(values: Column, p: float) -> Column:
    """Median-unbiased quantile of an array of numbers (nulls are dropped)."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    pos = F.least(F.greatest((n + 1 / 3) * p + 1 / 3, F.lit(1.0)), n.cast("double"))
    low = F.floor(pos).cast("int")
    at = lambda k: F.get(v, k - 1)
    return F.when(n > 0, at(low) + (pos - low) * (F.coalesce(at(F.least(low + 1, n)), at(low)) - at(low)))


def robust_scale(df: DataFrame, keys: list[str], value: str, donor: Column) -> DataFrame:
    """(x - donor median) / (1.4826 MAD) for each key; falls back to the donors' sd, then to 1."""
    med = df.where(donor).groupBy(*keys).agg(F.median(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    j = df.join(med, keys)
    mad = j.where(donor).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("_d"))
    scale = F.when(F.col("_d") > 0, F.col("_d")).when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return j.join(mad, keys).withColumn("scaled", (F.col(value) - F.col("_m")) / scale).drop("_m", "_s", "_d")


def moments(df: DataFrame, columns: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, sums and sums of products of complete rows: one aggregate, p x p numbers to the driver."""
    p = len(columns)
    pairs = [(a, b) for a in range(p) for b in range(a + 1)]
    c = [F.col(x) for x in columns]
    row = df.dropna(subset=columns).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(c)], *[F.sum(c[a] * c[b]).alias(f"q{a}_{b}") for a, b in pairs]).first()
    q = np.zeros((p, p))
    for a, b in pairs:
        q[a, b] = q[b, a] = row[f"q{a}_{b}"] or 0.0
    return float(row["n"]), np.array([row[f"s{k}"] or 0.0 for k in range(p)]), q


def whitening(df: DataFrame, columns: list[str], cutoff: float = 1e-10) -> np.ndarray:
    """Matrix W with W'W the pseudo-inverse of the sample covariance (relative cutoff on eigenvalues)."""
    n, s, q = moments(df, columns)
    cov = (q - np.outer(s, s) / n) / max(n - 1, 1)
    w, v = np.linalg.eigh(cov)
    keep = w > cutoff * max(w.max(), 0)
    return (v[:, keep] / np.sqrt(w[keep])).T


def whitened(df: DataFrame, columns: list[str], matrix: np.ndarray, name: str = "w") -> DataFrame:
    """Add the array of whitened features."""
    parts = []
    for r in matrix:
        term = F.lit(0.0)
        for c, k in zip(columns, r):
            term = term + F.col(c) * float(k)
        parts.append(term)
    return df.withColumn(name, F.array(*parts))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def abadie_imbens(df: DataFrame, y: str, treated: str, x: list[str]) -> dict:
    """Matching ATT with one neighbour, ties, regression bias adjustment and analytic variance.

    df needs a unique long ``id``. Returns estimate, se, unadjusted and the number of matches. Units of one arm with equal covariates are
    one class with sums, so that ties between copies aren't expanded. df is read once; rows with a null are left out.
    """
    df = df.select("id", F.col(y).alias("y"), F.col(treated).alias("t"), *x).dropna().checkpoint()
    n, s, q = moments(df, x)
    # No result changes when all outcomes move, and sums of squares around the mean don't cancel.
    center = df.agg(F.avg("y")).first()[0]
    sd = np.sqrt(np.diag(q - np.outer(s, s) / n) / (n - 1))
    base = df.select("id", (F.col("y") - center).alias("y"), "t", *[((F.col(c) - float(m)) / float(k)).alias(c) for c, m, k in zip(x, s / n, sd)])
    _, _, second = moments(base, x)
    w, v = np.linalg.eigh(second / (n - 1))
    sums = [F.min("id").alias("class"), F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    classes = whitened(base.groupBy("t", *x).agg(*sums), x, (v / np.sqrt(w)).T).withColumn("block", F.lit(0)).checkpoint()

    def nearest(targets: DataFrame) -> DataFrame:
        """Links to the nearest classes of controls."""
        pool = classes.where("not t").select(F.col("class").alias("donor"), "block", F.col("w").alias("v"))
        return top_k_ties(targets.select(F.col("class").alias("target"), "block", "w"), pool, "block", 1).select("target", "donor", "d2")

    donors = classes.select(F.col("class").alias("donor"), F.col("n").alias("dn"), F.col("sy").alias("dsy"), *[F.col(c).alias(f"d_{c}") for c in x])
    own = classes.select(F.col("class").alias("target"), "n", "sy", "syy", *x)
    links = nearest(classes.where("t")).join(own, "target").join(donors, "donor")
    links = links.withColumn("weight", 1.0 / F.sum("dn").over(Window.partitionBy("target"))).checkpoint()
    used = links.groupBy("donor").agg(F.sum(F.col("n") * F.col("weight")).alias("k"), F.sum(F.col("n") * F.col("weight") * F.col("weight")).alias("k2"))
    # A class of controls counts with its size in the regression, by its mean outcome.
    design = donors.join(used, "donor").withColumn("root", F.sqrt(F.col("k") * F.col("dn")))
    design = design.select(F.col("root").alias("c0"), *[(F.col(f"d_{c}") * F.col("root")).alias(f"c_{c}") for c in x], (F.col("dsy") / F.col("dn") * F.col("root")).alias("cy"))
    _, _, gram = moments(design, ["c0", *[f"c_{c}" for c in x], "cy"])
    beta = np.linalg.pinv(gram[:-1, :-1]) @ gram[:-1, -1]
    fit = lambda p: sum((F.col(f"{p}{c}") * float(b) for c, b in zip(x, beta[1:])), F.lit(float(beta[0])))
    # What is taken from the outcome is the same for all units of a class.
    each = links.groupBy("target", "n", "sy", "syy").agg(F.sum(F.col("weight") * F.col("dsy")).alias("raw"), F.sum(F.col("weight") * (F.col("dsy") + F.col("dn") * (fit("") - fit("d_")))).alias("adj"))
    squared = F.col("syy") - 2 * F.col("adj") * F.col("sy") + F.col("n") * F.col("adj") * F.col("adj")
    total = lambda c: F.sum(F.col("sy") - F.col("n") * F.col(c))
    r = each.agg(F.sum("n").alias("n"), total("raw").alias("raw"), total("adj").alias("s"), F.sum(squared).alias("q")).first()
    n1 = r["n"]
    tau = r["s"] / n1
    # The nearest of the own arm, for controls that are used: others of the class, and other classes as near as these or else nearest.
    lone = F.col("n") == 1
    near = nearest(classes.join(used.select(F.col("donor").alias("class")), "class")).join(own.select("target", "n"), "target").where(lone | (F.col("d2") <= TIE))
    near = near.join(donors.select("donor", "dn", "dsy"), "donor").groupBy("target").agg(F.sum("dn").alias("jn"), F.sum("dsy").alias("jsy"))
    sig = own.join(used.withColumnRenamed("donor", "target"), "target").join(near, "target", "left").fillna(0, ["jn", "jsy"])
    # With m others of the class and j units of near classes, y - mean = (y (m + 1 + j) - sum of class and near) / (m + j).
    m, whole = F.when(lone, F.lit(0)).otherwise(F.col("n") - 1), F.when(lone, F.lit(0.0)).otherwise(F.col("sy")) + F.col("jsy")
    j = m + F.col("jn")
    scale = F.when(lone, j).otherwise(j + 1)
    away = scale * scale * F.col("syy") - 2 * scale * whole * F.col("sy") + F.col("n") * whole * whole
    s2 = F.when(j > 0, away / (j * (j + 1)))
    extra = sig.agg(F.sum(s2 * (F.col("k") * F.col("k") - F.col("k2")))).first()[0] or 0.0
    variance = (r["q"] - 2 * tau * r["s"] + n1 * tau * tau + extra) / n1**2
    return {"estimate": tau, "se": math.sqrt(variance), "unadjusted": r["raw"] / n1, "n_treated": n1}


def ols(df: DataFrame, y: str, x: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, inverse Gram, residual sum of squares) of a regression without intercept."""
    _, _, q = moments(df, [*x, y])
    inverse = np.linalg.pinv(q[:-1, :-1])
    beta = inverse @ q[:-1, -1]
    return beta, inverse, float(q[-1, -1] - beta @ q[:-1, -1])


def cluster_covariance(df: DataFrame, y: str, x: list[str], beta: np.ndarray, inverse: np.ndarray, cluster: str) -> tuple[np.ndarray, int]:
    """CRV1 sandwich from score sums of each cluster; the outer products are summed by Spark."""
    residual = F.col(y) - sum((F.col(c) * float(b) for c, b in zip(x, beta)), F.lit(0.0))
    scores = df.groupBy(cluster).agg(*[F.sum(F.col(c) * residual).alias(c) for c in x], F.count("*").alias("_n"))
    g, _, meat = moments(scores, x)
    n = scores.agg(F.sum("_n")).first()[0]
    factor = g / (g - 1) * (n - 1) / (n - len(x))
    return factor * inverse @ meat @ inverse, int(g)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_p_value(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_p_value(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def wald(beta: np.ndarray, covariance: np.ndarray, df2: int) -> tuple[float, int, float]:
    """(F, numerator df, p) of the joint test that all coefficients are zero, by a pseudo-inverse of full rank part."""
    rank = int(np.linalg.matrix_rank(covariance))
    f = float(beta @ np.linalg.pinv(covariance) @ beta) / max(rank, 1)
    return f, rank, f_p_value(f, rank, df2)


def event_study(df: DataFrame, y: str, unit: str, time: str, t: str, cluster: str, reference: int = -1) -> list[tuple]:
    """Two-way fixed-effect event study: (event_time, estimate, se, p) of treated rows against the reference time.

    t is null for control rows. Dummies and outcome are absorbed together; X'X, X'y and cluster scores are aggregates.
    """
    rows = event_studies(df, y, unit, time, t, cluster, reference)
    return [(v, b, se, float(t_p_value(b / se, g - 1)) if se else None) for _, v, b, se, g in rows]
