"""Counterfactual paths from low-rank fits of donors: few t x t matrices from the driver, all units and all fits in one pass."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import block_pairs
from .lowrank import Fit, complete, distinct, fitted, loading, matrix, panel

PATHS = "name int, unit long, start int, observed array<double>, path array<double>, pre_rmspe double"


def paths(units: DataFrame, fits: dict[int, Fit], hold: int | dict[int, int] = 0, by_start: bool = False) -> DataFrame:
    """Rows (name, unit, start, observed, path, pre_rmspe) of every unit (unit, y array, start) under every fit.

    Level and loadings come from the seen periods before ``start`` (without the last ``hold`` of them, for all fits or by name) and are
    carried over all periods of the fit. pre_rmspe is taken over the periods held out, or over the fitted ones where none is. Units with
    too few seen periods for the fit's directions give no row. Where ``by_start``, a unit meets the fit named by its start only.
    """
    width = max((len(fit.effect) for fit in fits.values()), default=0)

    def lists(values: np.ndarray) -> pa.ListArray:
        flat, (n, t) = values.reshape(-1), values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * t + 1, t, dtype=np.int32)), pa.array(flat, mask=np.isnan(flat)))

    def run(batches):
        for batch in batches:
            wide, unit, starts = np.full((batch.num_rows, width), np.nan), batch.column("unit"), batch.column("start").to_numpy(zero_copy_only=False)
            for i, y in enumerate(batch.column("y").to_pandas()):
                wide[i, : len(y)] = np.asarray(y, float)[:width]
            for name, fit in fits.items():
                t = len(fit.effect)
                own = np.flatnonzero(starts == name) if by_start else np.arange(len(wide))
                ys, start = wide[own, :t], np.clip(starts[own], 0, t)
                before = np.isfinite(ys) & (np.arange(t) < start[:, None])
                out = hold.get(name, 0) if isinstance(hold, dict) else hold
                last = before[:, ::-1].cumsum(1)[:, ::-1] <= out
                free, test = before & ~last, before & last if out else before
                ok = (free.sum(1) > fit.basis.shape[1] * (fit.weights >= 1).all()) & test.any(1)
                if not ok.any():
                    continue
                ys, free, test = ys[ok], free[ok], test[ok]
                path = fitted(np.where(free, ys, np.nan), fit)
                error = np.where(test, ys - path, 0.0)
                rmspe = np.sqrt((error**2).sum(1) / test.sum(1))
                columns = [pa.array(np.full(len(ys), name, np.int32)), unit.take(pa.array(own[ok])), pa.array(start[ok].astype(np.int32)), lists(ys), lists(path), pa.array(rmspe)]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "unit", "start", "observed", "path", "pre_rmspe"])

    return units.select("unit", "y", "start").mapInArrow(run, PATHS)


def gaps(found: DataFrame) -> DataFrame:
    """Rows (name, unit, start, k, event_time, gap, pre_rmspe) of the seen periods from the start on."""
    each = F.posexplode(F.zip_with("observed", "path", lambda y, p: y - p)).alias("k", "gap")
    late = found.select("name", "unit", "start", "pre_rmspe", each).where("k >= start and gap is not null")
    return late.withColumn("event_time", F.col("k") - F.col("start"))


def _uniform(*of: Column | str) -> Column:
    return (F.pmod(F.xxhash64(*of), F.lit(1_000_003)).cast("double") + 0.5) / 1_000_003


def rolling_folds(donors: DataFrame, folds: int = 5, share: float = 0.1, least: int = 5, hold: int = 3, buffer: int = 1, seed: int = 20260723) -> DataFrame:
    """Rows (key, unit, y, w, truth, scored): every donor in every fold, with what the fold may see of it.

    A share of the donors with enough seen periods (and the first one by the draw, so that no fold is empty) gets an anchor of its
    own among its seen periods; ``hold`` periods from there are scored, and all periods from ``buffer`` seen ones before it are
    removed. The other donors stay whole. Draws are hashes of seed, fold and unit.
    """
    n = F.size("times")
    rows = donors.select("unit", F.col("y").alias("truth"), F.filter(F.transform("y", lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull()).alias("times"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("key"))
    draw = lambda what: _uniform(F.lit(seed), F.lit(what), "key", "unit")
    fit = n >= least + hold
    first = rows.where(fit).groupBy("key").agg(F.min_by("unit", draw("unit")).alias("first"))
    rows = rows.join(F.broadcast(first), "key", "left")
    drawn = F.coalesce(fit & ((draw("unit") < share) | (F.col("unit") == F.col("first"))), F.lit(False))
    anchor = F.lit(least) + F.floor(draw("anchor") * (n - hold - least + 1)).cast("int")
    rows = rows.withColumn("anchor", F.when(drawn, anchor))
    cut = F.get("times", F.greatest(F.col("anchor") - buffer, F.lit(0)))
    y = F.when(F.col("anchor").isNull(), F.col("truth")).otherwise(F.transform("truth", lambda v, i: F.when(i < cut, v)))
    return rows.select("key", "unit", y.alias("y"), F.array(F.lit(1.0)).alias("w"), "truth", F.when(F.col("anchor").isNotNull(), F.slice("times", F.col("anchor") + 1, hold)).alias("scored"))


def held_out_scores(folded: DataFrame, t: int, plan: dict[int, tuple[int, float | None]], rounds: int = 5000, tol: float = 1e-3) -> DataFrame:
    """Rows (name, key, sse, n): squared errors of every candidate (rank, threshold) of ``plan`` at the scored cells of every fold.

    folded: as ``rolling_folds`` gives it. Candidates of one fold share its statistics.
    """
    folded = folded.checkpoint()
    data = panel(folded, t)
    keys = sorted(data.known)
    got = data.fit({n * len(keys) + i: ((key, 0), *p) for n, p in plan.items() for i, key in enumerate(keys)}, rounds, tol, fast=False)
    fits = {n: {key: got[n * len(keys) + i] for i, key in enumerate(keys)} for n in plan}

    def errors(batches):
        for pdf in batches:
            out = []
            for key, part in pdf.groupby("key"):
                given, truth = matrix(part["y"], t), matrix(part["truth"], t)
                at = np.array([(i, k) for i, cells in enumerate(part["scored"]) for k in cells]).reshape(-1, 2)
                for name, of in fits.items():
                    err = (truth - complete(given, of[key]))[at[:, 0], at[:, 1]]
                    out.append((name, key, float((err**2).sum()), len(err)))
            yield pd.DataFrame(out, columns=["name", "key", "sse", "n"])

    got = folded.where("scored is not null").select("key", "y", "truth", "scored").mapInPandas(errors, "name int, key int, sse double, n long")
    return got.groupBy("name", "key").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))


def one_se_choice(scores: list[tuple[int, list[tuple[float, float]]]]) -> int:
    """The first (simplest) candidate whose pooled error is within one standard error (over folds) of the least.

    scores: (candidate, [(sum of squared errors, cells) of each fold]).
    """
    pooled = {k: sum(s for s, _ in x) / max(sum(n for _, n in x), 1e-300) for k, x in scores}
    best = min(pooled, key=lambda k: pooled[k])
    each = [s / n for s, n in dict(scores)[best] if n]
    limit = pooled[best] + (np.std(each, ddof=1) / np.sqrt(len(each)) if len(each) > 1 else 0.0)
    return next(k for k, _ in scores if pooled[k] <= limit)


def bootstrap_weights(replicates: int) -> Column:
    """Array of how often a unit is drawn in each replicate: Poisson(1) by a hash of unit and replicate."""

    def times(r):
        u, total, term, out = _uniform("unit", r), 0.0, math.exp(-1.0), F.lit(0.0)
        for k in range(1, 9):
            total += term
            out = out + (u > total).cast("double")
            term /= k
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), times)


def group_of(groups: int) -> Column:
    return F.pmod(F.xxhash64("unit"), F.lit(groups)).cast("int")


def leave_out_weights(groups: int) -> Column:
    """Array of weights that leave out the unit's own hash group in its place."""
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: (g != group_of(groups)).cast("double"))


def mean_gaps(fits: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (unit, n, gap) of fits (unit, n, effect, basis, weights): the mean of all seen gaps of units (y, start) from their starts on,
    with loadings as ``paths`` fits them; null where there are none.

    Paths are affine in what is seen before the start, so that units of one start and pattern go by their mean.
    """
    seen = F.concat_ws("", F.transform("y", lambda v: F.when(v.isNull(), "0").otherwise("1"))).alias("seen")
    cells = units.select("start", seen, F.posexplode("y").alias("k", "v")).groupBy("start", "seen", "k").agg(F.count("*").alias("n"), F.avg("v").alias("v"))
    groups = cells.groupBy("start", "seen").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("y"))
    groups = groups.select(F.xxhash64("start", "seen").alias("at"), "start", "n", "y").checkpoint()

    def lists(column: pa.ListArray) -> list[np.ndarray]:
        return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(column.value_lengths().to_numpy())[:-1])

    def run(batches):
        for batch in batches:
            for one, other in zip(*batch.columns, strict=True):
                (unit, n), (_, start, many) = (tuple(x.values.field(i) for i in range(k)) for x, k in ((one, 2), (other, 3)))
                y, out = np.array(lists(other.values.field(3))), []
                late = np.isfinite(y) & (np.arange(y.shape[1]) >= start.to_numpy()[:, None])
                before = np.isfinite(y) & ~late
                patterns, which = distinct(before)
                patterns, count, many = patterns.astype(float), before.sum(1), many.to_numpy()
                for effect, basis, weights in zip(*(lists(one.values.field(i)) for i in (2, 3, 4)), strict=True):
                    fit = Fit(effect, basis.reshape(len(effect), len(weights)), weights)
                    x = fit.design()[0]
                    left = np.where(before, y - effect, 0.0) @ x
                    gap = np.where(late, y - effect - (left[:, None, :] @ loading(patterns, fit)[which])[:, 0] @ x.T, 0.0)
                    ok = (count > len(weights) * (weights >= 1).all()) * many
                    out.append((ok @ gap.sum(1), ok @ late.sum(1)))
                columns = [unit, n, *(pa.array(np.array(v, float)) for v in zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "n", "s", "cells"])

    met = block_pairs(fits.select("unit", "n", "effect", "basis", "weights"), groups, 512, 4096)
    got = met.mapInArrow(run, "unit long, n long, s double, cells double").groupBy("unit", "n")
    return got.agg(F.try_divide(F.sum("s"), F.sum("cells")).alias("gap"))


def unseen_gaps(donors: DataFrame, fits: dict[int, Fit], starts: Iterable[int]) -> DataFrame:
    """Rows (start, event_time, n, s, q): number, sum and sum of squares of placebo gaps of donors in the replicates that didn't draw
    them, as if treated from each start on; event_time is null for the mean gap of a donor's whole path.

    donors: (unit, y, w) with the weights of the replicates.
    """
    begins = sorted(set(starts))

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            w, every = np.array(pdf["w"].tolist(), float), None
            for r, fit in fits.items():
                t = len(fit.effect)
                every = matrix(pdf["y"], t) if every is None else every
                ys = every[w[:, r] == 0]
                seen = np.isfinite(ys)
                for start in begins:
                    ok = (seen[:, :start].sum(1) > fit.basis.shape[1]) & seen[:, start:].any(1)
                    if not ok.any():
                        continue
                    free = np.where(np.arange(t) < start, ys[ok], np.nan)
                    gap = (ys[ok] - fitted(free, fit))[:, start:]
                    there = seen[ok, start:]
                    gap[~there] = 0.0
                    mean = gap.sum(1) / there.sum(1)
                    sums = np.array([there.sum(0), gap.sum(0), (gap**2).sum(0)], float).T
                    for k, v in enumerate([*sums, np.array([len(mean), mean.sum(), (mean**2).sum()])]):
                        at = (start, k if k < len(sums) else None)
                        total[at] = total.get(at, 0.0) + v
        rows = [(s, k, *v) for (s, k), v in total.items()]
        yield pd.DataFrame(rows, columns=["start", "event_time", "n", "s", "q"]).astype({"event_time": "Int32"})

    got = donors.select("y", "w").mapInPandas(run, "start int, event_time int, n double, s double, q double")
    return got.groupBy("start", "event_time").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])


def normal_inference(effect: Column, variance: Column, valid: Column, least_share: float = 0.9) -> list[Column]:
    """se, low, high and two-sided p of a normal approximation, null where too few replicates are valid; p is 1 or 0 at a zero se."""
    enough = (valid >= least_share) & effect.isNotNull() & variance.isNotNull()
    se = F.when(enough, F.sqrt(F.greatest(variance, F.lit(0.0))))
    # Abramowitz and Stegun 7.1.26 is too coarse for small p, so the tail is taken by the continued fraction below.
    z = F.abs(effect) / se
    p = F.when(se > 0, normal_tail(z)).when(se.isNotNull(), F.when(effect == 0, 1.0).otherwise(0.0))
    return [se.alias("se"), (effect - 1.959963984540054 * se).alias("low"), (effect + 1.959963984540054 * se).alias("high"), p.alias("p")]


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal: a series below 2.5, a continued fraction from there on."""

    def tail(z):
        density = F.exp(-z * z / 2) * (2 / math.sqrt(2 * math.pi))
        both = F.struct(z.alias("term"), z.alias("sum"))

        def added(acc, k):
            term = acc["term"] * z * z / (2 * k + 1)
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        series = F.aggregate(F.sequence(F.lit(1), F.lit(39)), both, added, lambda acc: acc["sum"])
        fraction = F.aggregate(F.sequence(F.lit(30), F.lit(1)), z, lambda of, k: z + k / of)
        return F.when(z < 2.5, 1 - density * series).otherwise(density / fraction)

    # Bound once and folded over few nodes: written out, the terms hold thousands of copies of z, which Spark plans for many seconds.
    return F.get(F.transform(F.array(z.cast("double")), tail), 0)


def inference(effect: float, replicates: list[float], sizes: list[float] | None = None, least_share: float = 0.8) -> tuple:
    """(effect, se, low, high, p, valid): spread of finite replicates, normal interval and two-sided p; nulls where too few are valid.

    ``sizes`` makes it a jackknife over left-out groups of these sizes: pseudo-values weighted by how much of the whole each leaves.
    """
    pairs = [(x, m) for x, m in zip(replicates, sizes or [1.0] * len(replicates), strict=True) if x is not None and np.isfinite(x)]
    valid = len(pairs) / max(len(replicates), 1)
    if len(pairs) < 2 or valid < least_share:
        return effect, None, None, None, None, valid
    v, m = (np.array(x, float) for x in zip(*pairs, strict=True))
    if sizes:
        h = m.sum() / m
        pseudo = h * effect - (h - 1) * v
        center = len(v) * effect - ((1 - 1 / h) * v).sum()
        se = float(np.sqrt(np.mean((pseudo - center) ** 2 / (h - 1))))
    else:
        se = float(v.std(ddof=1))
    return _normal_row(effect, se, valid)


def unit_jackknife(found: DataFrame, least_share: float = 0.8) -> tuple:
    """As ``inference``, from rows (unit, n, gap) of refits without one of n equal units each and of the whole fit (n = 0): the pseudo-values
    of N valid refits vary by (N - 1) squared times what the refits do, and the square of the error is an Nth of that.
    """
    whole = found.where("n = 0").first()
    effect = whole["gap"] if whole else None
    change = F.col("gap") - F.lit(effect).cast("double")
    of, n, s, q = found.where("n > 0").agg(F.sum("n"), F.sum(F.when(change.isNotNull(), F.col("n"))), F.sum(F.col("n") * change), F.sum(F.col("n") * change * change)).first()
    valid = (n or 0) / max(of or 0, 1)
    if effect is None or (n or 0) < 2 or valid < least_share:
        return effect, None, None, None, None, valid
    return _normal_row(effect, (n - 1) * math.sqrt(max(q - s * s / n, 0.0) / (n - 1) / n), valid)


def _normal_row(effect: float, se: float, valid: float) -> tuple:
    p = math.erfc(abs(effect) / se / math.sqrt(2)) if se else None
    return effect, se, effect - 1.959964 * se, effect + 1.959964 * se, p, valid
