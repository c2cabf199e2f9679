"""Two-way fixed-effect regressions by their normal equations, for any number of strata at once.

Unit effects leave the normal equations by one aggregate of each unit's periods; what remains is a system of periods x periods for
each stratum, solved once on the driver. Residuals then take one exchange by unit. Gram matrices and cluster scores of all strata are
one pass each, so nothing loops over strata or iterates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BY = "_stratum"


def _summed(df: DataFrame, run, size: int) -> dict[str, np.ndarray]:
    """Sums of the vectors (stratum, v) that run gives for each task, by stratum: strata x size numbers to the driver."""
    got = df.mapInPandas(run, f"{_BY} string, v array<double>").select(_BY, F.posexplode("v").alias("pos", "v"))
    out: dict[str, np.ndarray] = {}
    for r in got.groupBy(_BY, "pos").agg(F.sum("v").alias("v")).toArrow().to_pandas().groupby(_BY):
        v = np.zeros(size)
        v[r[1]["pos"]] = r[1]["v"]
        out[r[0]] = v
    return out


def _with_stratum(df: DataFrame, by: str | None) -> DataFrame:
    return df.withColumn(_BY, F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("")))


def period_effects(df: DataFrame, columns: list[str], unit: str, time: str) -> tuple[list, dict[str, np.ndarray]]:
    """(periods, stratum -> periods x columns): least-squares period effects of each column beside unit effects."""
    periods = [r[0] for r in df.select(time).where(F.col(time).isNotNull()).distinct().orderBy(time).collect()]
    t, c = len(periods), len(columns)
    place = F.broadcast(df.sparkSession.createDataFrame(list(zip(periods, range(t))), f"{time} {df.schema[time].dataType.simpleString()}, _k int")) if t else None
    if place is None:
        return periods, {}
    cells = df.join(place, time).groupBy(_BY, unit, "_k").agg(F.count("*").alias("_n"), *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(columns)])
    cells = cells.select(_BY, unit, F.struct("_k", "_n", F.array(*[F.col(f"_s{i}").cast("double") for i in range(c)]).alias("_s")).alias("_cell"))
    units = cells.groupBy(_BY, unit).agg(F.collect_list("_cell").alias("_l")).select(_BY, F.col("_l._k").alias("k"), F.col("_l._n").alias("n"), F.flatten("_l._s").alias("s"))

    def run(batches):
        total: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(_BY):
                o, y = np.zeros((len(part), t)), np.zeros((len(part), t, c))
                for i, (k, n, v) in enumerate(zip(part["k"], part["n"], part["s"])):
                    o[i, k] = n
                    y[i, k] = np.reshape(v, (-1, c))
                size = o.sum(1)
                left = np.diag(o.sum(0)) - (o / size[:, None]).T @ o
                right = y.sum(0) - (o / size[:, None]).T @ y.sum(1)
                total[key] = total.get(key, 0.0) + np.concatenate([left.ravel(), right.ravel()])
        for key, v in total.items():
            yield pd.DataFrame({_BY: [key], "v": [v]})

    sums = _summed(units, run, t * (t + c))
    return periods, {key: np.linalg.pinv(v[: t * t].reshape(t, t), rcond=1e-12, hermitian=True) @ v[t * t :].reshape(t, c) for key, v in sums.items()}


def absorb(df: DataFrame, columns: list[str], unit: str, time: str, by: str | None = None) -> DataFrame:
    """Residuals of the columns on unit and period effects, within each value of ``by``.

    Rows with a null period or a null in a column are left out; a unit with one row has residual zero. Strata with null count as ''.
    """
    df = _with_stratum(df.dropna(subset=[time, *columns]), by)
    periods, effects = period_effects(df, columns, unit, time)
    kind = df.schema[time].dataType.simpleString()
    rows = [(key, p, *(float(x) for x in b)) for key, m in effects.items() for p, b in zip(periods, m)]
    table = df.sparkSession.createDataFrame(rows, f"{_BY} string, {time} {kind}, " + ", ".join(f"_b{i} double" for i in range(len(columns))))
    others = [c for c in df.columns if c not in columns and c != _BY]
    z = df.join(F.broadcast(table), [_BY, time]).select(*others, _BY, *[(F.col(c) - F.col(f"_b{i}")).alias(c) for i, c in enumerate(columns)])
    own = Window.partitionBy(_BY, unit)
    return z.select(*others, _BY, *[(F.col(c) - F.avg(c).over(own)).alias(c) for c in columns]).drop(*([] if by else [_BY]))


def _units(df: DataFrame, values: list[Column], unit: str, time: str, cluster: str, by: str | None) -> tuple[DataFrame, int]:
    """(rows (stratum, k, cluster, v) of each unit: period places, clusters and values one after another; periods).

    The values stay in one array, as many derived columns would keep the optimizer busy; a unit's rows, the periods of a panel, meet
    in one task.
    """
    df = _with_stratum(df, by).select(_BY, F.col(unit).alias("_unit"), F.col(time).alias("_time"), F.col(cluster).cast("string").alias("_cluster"), F.array(*values).alias("_v"))
    df = df.where(F.col("_time").isNotNull() & ~F.exists("_v", lambda v: v.isNull()))
    periods = [r[0] for r in df.select("_time").distinct().orderBy("_time").collect()]
    place = df.sparkSession.createDataFrame(list(zip(periods, range(len(periods)))), f"_time {df.schema['_time'].dataType.simpleString()}, _k int")
    rows = df.join(F.broadcast(place), "_time").groupBy(_BY, "_unit").agg(F.collect_list(F.struct("_k", "_cluster", "_v")).alias("l"))
    return rows.select(_BY, F.col("l._k").alias("k"), F.col("l._cluster").alias("cluster"), F.flatten("l._v").alias("v")).checkpoint(), len(periods)


def _residuals(part: pd.DataFrame, c: int, effects: np.ndarray):
    """(clusters, residual rows) of each unit."""
    for k, cluster, v in zip(part["k"], part["cluster"], part["v"]):
        z = np.reshape(np.asarray(v, float), (-1, c)) - effects[k]
        yield cluster, z - z.mean(0)


def study(df: DataFrame, y: Column, x: list[Column], unit: str, time: str, cluster: str, by: str | None = None) -> dict[str, tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """stratum ('' without ``by``) -> (coefficients, CRV1 covariance, clusters, which x vary beside the effects) of y on x beside
    unit and period effects. Rows with a null period, y or x are left out."""
    c, p = len(x) + 1, len(x)
    units, t = _units(df, [*x, y], unit, time, cluster, by)
    upper = np.triu_indices(c)

    def system(batches):
        for pdf in batches:
            for key, part in pdf.groupby(_BY):
                left, right = np.zeros((t, t)), np.zeros((t, c))
                for k, v in zip(part["k"], part["v"]):
                    v, o = np.reshape(np.asarray(v, float), (-1, c)), np.bincount(k, minlength=t)
                    left += np.diag(o) - np.outer(o, o) / len(k)
                    np.add.at(right, k, v - v.mean(0))
                yield pd.DataFrame({_BY: [key], "v": [np.concatenate([left.ravel(), right.ravel()])]})

    effects = {key: np.linalg.pinv(v[: t * t].reshape(t, t), rcond=1e-12, hermitian=True) @ v[t * t :].reshape(t, c) for key, v in _summed(units, system, t * (t + c)).items()}

    def grams(batches):
        for pdf in batches:
            for key, part in pdf.groupby(_BY):
                q, n = np.zeros((c, c)), 0
                for _, z in _residuals(part, c, effects[key]):
                    q += z.T @ z
                    n += len(z)
                yield pd.DataFrame({_BY: [key], "v": [np.concatenate([[n], q[upper]])]})

    fits = {}
    for key, v in _summed(units, grams, 1 + len(upper[0])).items():
        q = np.zeros((c, c))
        q[upper] = v[1:]
        q += np.triu(q, 1).T
        inverse = np.linalg.pinv(q[:-1, :-1], hermitian=True)
        fits[key] = (inverse @ q[:-1, -1], inverse, v[0], q.diagonal()[:-1] > 1e-9)

    def scores(batches):
        for pdf in batches:
            total: dict = {}
            for key, part in pdf.groupby(_BY):
                for clusters, z in _residuals(part, c, effects[key]):
                    own = z[:, :p] * (z[:, p] - z[:, :p] @ fits[key][0])[:, None]
                    for name in set(clusters):
                        total[key, name] = total.get((key, name), 0.0) + own[[x == name for x in clusters]].sum(0)
            if total:
                yield pd.DataFrame({_BY: [k for k, _ in total], "cluster": [n for _, n in total], "v": list(total.values())})

    def meats(batches):
        for pdf in batches:
            for key, part in pdf.groupby(_BY):
                v = np.array([[e["v"] for e in sorted(x, key=lambda e: e["pos"])] for x in part["l"]], float)
                yield pd.DataFrame({_BY: [key], "v": [np.concatenate([[len(v)], (v.T @ v).ravel()])]})

    each = units.mapInPandas(scores, f"{_BY} string, cluster string, v array<double>").select(_BY, "cluster", F.posexplode("v").alias("pos", "v"))
    each = each.groupBy(_BY, "cluster", "pos").agg(F.sum("v").alias("v")).groupBy(_BY, "cluster").agg(F.collect_list(F.struct("pos", "v")).alias("l"))
    out = {}
    for key, v in _summed(each, meats, 1 + p * p).items():
        (beta, inverse, n, varies), g, meat = fits[key], v[0], v[1:].reshape(p, p)
        out[key] = (beta, g / max(g - 1, 1) * (n - 1) / max(n - p, 1) * inverse @ meat @ inverse, int(g), varies)
    return out


def _hit(condition: Column) -> Column:
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def event_studies(df: DataFrame, y: str, unit: str, time: str, t: str, cluster: str, reference: int = -1, by: str | None = None) -> list[tuple]:
    """Rows (stratum, event_time, estimate, se, clusters) of two-way event studies against the reference; t is null for controls."""
    # Written once, so that the dummies are made of plain columns instead of the whole derivation of t.
    df = df.select(*{unit, time, cluster, y, t, *([by] if by else [])}).checkpoint()
    times = sorted(r[0] for r in df.select(t).distinct().collect() if r[0] is not None and r[0] != reference)
    hits = [_hit(F.col(t) == v) for v in times]
    rows = []
    for key, (beta, cov, g, varies) in sorted(study(df, F.col(y).cast("double"), hits, unit, time, cluster, by).items()):
        rows += [(key, int(v), float(beta[k]), math.sqrt(max(cov[k, k], 0.0)), g) for k, v in enumerate(times) if varies[k]]
    return rows


def cohort_studies(df: DataFrame, y: str, unit: str, time: str, t: str, cohort: str, cluster: str, reference: int = -1) -> list[tuple]:
    """Rows (event_time, estimate, se, cohorts): interaction-weighted event study.

    One dummy for each cohort and event time but the reference; the estimates of an event time are averaged by the cohorts' shares of
    treated units there. The variance adds that of the shares (delta method). Control rows have a null t; a cohort never seen at the
    reference is left out with its units, as its path has nothing to be measured against.
    """
    df = df.select(*{unit, time, cluster, y, t, cohort}).checkpoint()
    treated = df.where(F.col(t).isNotNull())
    seen = treated.groupBy(cohort, t).agg(F.countDistinct(unit).alias("n")).collect()  # cohorts x event times
    based = {r[cohort] for r in seen if r[t] == reference}
    pairs = sorted((r[cohort], r[t], r["n"]) for r in seen if r[t] != reference and r[cohort] in based)
    keep = F.col(t).isNull() | F.col(cohort).isin(sorted(based))
    hits = [_hit((F.col(cohort) == F.lit(c)) & (F.col(t) == v)) for c, v, _ in pairs]
    beta, cov, *_ = study(df.where(keep), F.col(y).cast("double"), hits, unit, time, cluster)[""]
    rows = []
    for v in sorted({p[1] for p in pairs}):
        at = np.array([k for k, p in enumerate(pairs) if p[1] == v])
        n = np.array([pairs[k][2] for k in at], float)
        w, b = n / n.sum(), beta[at]
        variance = w @ cov[np.ix_(at, at)] @ w + b @ (np.diag(w) - np.outer(w, w)) @ b / n.sum()
        rows.append((int(v), float(w @ b), math.sqrt(max(variance, 0.0)), len(at)))
    return rows
