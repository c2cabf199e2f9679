"""Queries of the low-rank counterfactual estimators, over all months of the outcome panel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import counterfactual as K
from ..operators import estimators as E
from ..operators import lowrank as L
from . import roles as R
from .base import book
from .estimators import ready

QUERIES, ORACLE, query = book()
RANKS, REPLICATES, PLACEBOS = (0, 1, 2, 3, 4, 5), 20, 20
#: Thresholds as shares of the largest singular value of the additive fit's residuals, from simple to rich.
SHARES = tuple(float(x) for x in np.geomspace(1.0, 1e-3, 10))


def months(s, d):
    """(first month as year * 12 + month - 1, number of months) of the panel."""
    # The panel's months are those of its items, which needn't be grouped for it; a row for each unit is joined instead of its items.
    spans = R.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    spans = spans.join(R.units(s, d).select("unit"), F.col("l_suppkey") == F.col("unit"))
    day = spans.agg(F.min("first").cast("date").alias("first"), F.max("last").cast("date").alias("last"))
    low, high = day.select(*[F.year(c) * 12 + F.month(c) - 1 for c in ("first", "last")]).first()
    return low, high - low + 1


def arrays(s, d):
    """((unit, treated, start, y), months): outcome arrays over all months, start is the opening's position."""
    low, t = months(s, d)
    at = lambda c: F.year(c) * 12 + F.month(c) - 1 - low
    m = R.panel(s, d).groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct(at("period").alias("k"), "y"))).alias("m"))
    u = R.units(s, d).select("unit", "treated", at("opening").alias("start"))
    y = F.transform(F.sequence(F.lit(0), F.lit(t - 1)), lambda i: F.try_element_at("m", i)).alias("y")
    ready(s)
    return m.join(u, "unit").select("unit", "treated", "start", y).checkpoint(), t


def scores(folded, t, plan):
    rows = K.held_out_scores(folded, t, plan).orderBy("name", "key").collect()
    return [(n, [(r["sse"], r["n"]) for r in rows if r["name"] == n]) for n in plan]


def ranks(donors):
    """Candidate ranks that the donors' seen cells can identify."""
    n = F.size(F.filter("y", lambda v: v.isNotNull()))
    least, cells, units, t = donors.agg(F.min(n), F.sum(n), F.count("*"), F.max(F.size("y"))).first()
    return [r for r in RANKS if r <= min(t, units, least - 1) and cells - r * (units + t) + r * r > 0] or [0]


def rank_scores(units, t):
    donors = units.where("not treated")
    candidates = ranks(donors)
    rows = scores(K.rolling_folds(donors), t, {k: (r, None) for k, r in enumerate(candidates)})
    return candidates, rows, K.one_se_choice(rows)


def chosen_rank(units, t):
    candidates, _, best = rank_scores(units, t)
    return candidates[best]


def chosen_threshold(units, t):
    donors = units.where("not treated")
    spread = L.single(donors, t).spread()
    largest = float(np.sqrt(max(np.linalg.eigvalsh(spread)[-1], 0.0)))
    plan = {k: (0, largest * share) for k, share in enumerate(SHARES)}
    return plan[K.one_se_choice(scores(K.rolling_folds(donors), t, plan))][1]


def by_unit(found):
    return K.gaps(found).groupBy("name", "unit", "start").agg(F.avg("gap").alias("effect"), F.count("*").alias("months"), F.max("pre_rmspe").alias("pre_rmspe"))


def replicated(units, t, rank):
    """(paths of treated units under the whole fit (name -1) and every replicate, placebo gaps of donors that a replicate didn't draw)."""
    donors, treated = units.where("not treated").withColumns({"key": F.lit(0), "w": K.bootstrap_weights(REPLICATES)}), units.where("treated")
    both = donors.withColumn("w", F.concat("w", F.array(F.lit(1.0)))).checkpoint()
    data = L.panel(both, t, REPLICATES + 1)
    fits = data.fit({r if r < REPLICATES else -1: ((0, r), rank, None) for r in range(REPLICATES + 1)})
    starts = [r[0] for r in treated.select("start").distinct().collect()]  # at most t of them
    found = K.paths(treated, fits).checkpoint()
    unseen = K.unseen_gaps(both, {r: f for r, f in fits.items() if r >= 0}, [k for k in starts if 0 < k < t]).checkpoint()
    return found, unseen


def placebo_variance():
    return (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)


@query("gsc_effect")
def _(s, d):
    units, t = arrays(s, d)
    found, unseen = replicated(units, t, chosen_rank(units, t))
    each = by_unit(found)
    spread = each.where("name >= 0").groupBy("unit").agg(F.var_samp("effect").alias("fits"), (F.count("*") / REPLICATES).alias("valid"))
    noise = unseen.where("event_time is null and n > 1").select("start", placebo_variance().alias("noise"))
    whole = each.where("name = -1").join(spread, "unit", "left").join(F.broadcast(noise), "start", "left")
    test = K.normal_inference(F.col("effect"), F.col("fits") + F.col("noise"), F.coalesce("valid", F.lit(0.0)))
    out = whole.select("unit", "months", "effect", "pre_rmspe", *test, F.coalesce("valid", F.lit(0.0)).alias("valid"))
    return out.select("unit", "months", *[F.round(c, 4).alias(c) for c in ("effect", "pre_rmspe", "se", "low", "high", "p", "valid")])


@query("mc_effect")
def _(s, d):
    units, t = arrays(s, d)
    fit = L.fit_one(units.where("not treated"), t, 0, chosen_threshold(units, t))
    return by_unit(K.paths(units.where("treated"), {0: fit})).select("unit", F.round("effect", 4).alias("effect"), "months", F.round("pre_rmspe", 4).alias("pre_rmspe"))


@query("gsc_rank_cv")
def _(s, d):
    units, t = arrays(s, d)
    candidates, rows, best = rank_scores(units, t)
    out = [(candidates[k], round(sum(a for a, _ in x) / max(sum(n for _, n in x), 1), 5), sum(n for _, n in x), k == best) for k, x in rows]
    return s.createDataFrame(out, "rank int, mspe double, cells long, chosen boolean")


@query("gsc_bootstrap")
def _(s, d):
    """Mean effect of the treated by event time: spread over refits on drawn donors, plus the mean's share of the placebo noise."""
    units, t = arrays(s, d)
    found, unseen = replicated(units, t, chosen_rank(units, t))
    late = K.gaps(found)
    noise = unseen.where("event_time is not null and n > 1").select("start", "event_time", placebo_variance().alias("noise"))
    own = late.where("name = -1").join(F.broadcast(noise), ["start", "event_time"], "left")
    effect = own.groupBy("event_time").agg(F.avg("gap").alias("effect"), F.count("*").alias("units"), (F.sum("noise") / F.pow(F.count("noise"), 2)).alias("noise"))
    draws = late.where("name >= 0").groupBy("event_time", "name").agg(F.avg("gap").alias("m")).groupBy("event_time").agg(F.var_samp("m").alias("fits"), (F.count("m") / REPLICATES).alias("valid"))
    j = effect.join(draws, "event_time", "left").withColumn("valid", F.coalesce("valid", F.lit(0.0)))
    j = j.select("event_time", "units", "effect", *K.normal_inference(F.col("effect"), F.col("fits") + F.col("noise"), F.col("valid")), "valid")
    return j.select("event_time", "units", *[F.round(c, 4).alias(c) for c in ("effect", "se", "low", "high", "p", "valid")])


@query("mc_jackknife")
def _(s, d):
    """Mean effect of the treated: a refit without each donor, of which equal ones share theirs, and the spread of the pseudo-values."""
    units, t = arrays(s, d)
    donors, soft = units.where("not treated"), chosen_threshold(units, t)
    each = donors.groupBy("y").agg(F.min("unit").alias("unit"), F.count("*").alias("n")).checkpoint()
    fits = L.left_out(each, L.single(donors, t), soft).checkpoint()
    row = K.unit_jackknife(K.mean_gaps(fits, units.where("treated")).checkpoint())
    frame = s.createDataFrame([row], "effect double, se double, low double, high double, p double, valid double")
    return frame.select(*[F.round(c, 4).alias(c) for c in frame.columns])


@query("masked_placebo_gate")
def _(s, d):
    """Months held out before the opening: the error of every treated unit against those of 20 donors that its control fit doesn't see.

    Units of one opening share their control fit, on the months before it, and their placebo donors.
    """
    units, t = arrays(s, d)
    rank = chosen_rank(units, t)
    starts = sorted(r[0] for r in units.where("treated").select("start").distinct().collect() if 5 < r[0] <= t)  # at most t of them
    donors = units.where("not treated")
    drawn = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(20260723), "key", "unit"), "unit")
    keyed = donors.select("unit", "y", F.explode(F.array(*[F.lit(b) for b in starts])).alias("key"))
    # At most 20 donors of each start reach the driver.
    picked = keyed.select("key", "unit", F.row_number().over(drawn).alias("n")).where(F.col("n") <= PLACEBOS).select("key", "unit").collect()
    taken = s.createDataFrame(picked, "key int, unit long")
    keyed = keyed.join(F.broadcast(taken), ["key", "unit"], "left_anti")
    before = F.transform("y", lambda v, i: F.when(i < F.col("key"), v)).alias("y")
    data = L.panel(keyed.select("key", before, F.array(F.lit(1.0)).alias("w")).checkpoint(), t, lengths={b: b for b in starts})
    hold = {b: min(12, b - 5) for b in starts}
    fits = data.fit({b: ((b, 0), min(rank, max(0, (b - hold[b] - 1) // 2)), None) for b in starts})
    placebos = F.broadcast(taken.select("unit", F.col("key").alias("start"), F.lit(True).alias("placebo")))
    every = units.where("treated").select("unit", "start", "y").unionByName(donors.select("unit", "y").join(placebos, "unit").select("unit", "start", "y"))
    got = K.paths(every, fits, hold, by_start=True).select("start", "unit", "pre_rmspe")
    marked = got.join(placebos, ["unit", "start"], "left").select("unit", "start", "pre_rmspe", F.col("placebo").isNull().alias("treated")).checkpoint()
    # 20 donors of each start.
    limit = marked.where("not treated").groupBy("start").agg(E.type8(F.collect_list("pre_rmspe"), 0.95).alias("limit"))
    own = marked.where("treated").join(F.broadcast(limit), "start")
    return own.select("unit", F.round("pre_rmspe", 4).alias("rmspe"), F.round("limit", 4).alias("limit"), (F.col("pre_rmspe") <= F.col("limit")).alias("passed"))
