"""Matching on treatment histories: equal histories by an equi-join, the nearest of them, and effects by lead with a unit bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counterfactual import bootstrap_weights, normal_inference
from .estimators import top_k, whitened, whitening


def history(start: Column, lag: int) -> Column:
    """Signature of the ``lag`` periods before a start: 1 treated, 0 not, - without an outcome (columns y, treated, opening)."""
    each = F.transform(
        F.sequence(start - lag, start - 1),
        lambda k: F.when(F.try_element_at("y", k + 1).isNull(), "-").when(F.col("treated") & (k >= F.col("opening")), "1").otherwise("0"),
    )
    return F.concat_ws("", each)


def matched_sets(units: DataFrame, lag: int, last: int, halves: int = 2) -> DataFrame:
    """Rows (treated, start, control, d2): the nearest unit of the same history for each treated one.

    units: (unit, city, treated, opening, y): outcome arrays over all periods and the period of the opening. A control of a start has
    the same city and history and no treatment up to ``last`` periods after it; the distance is Mahalanobis over the mean outcomes
    of ``halves`` parts of the lags. Units without an outcome in the period before the start, or in a whole part, meet nobody.
    """
    starts = [r[0] for r in units.where("treated").select("opening").distinct().collect() if r[0] >= lag]  # at most one a period
    rows = units.select("*", F.explode(F.array(*[F.lit(b) for b in sorted(starts)]).cast("array<int>")).alias("start"))
    role = F.when(F.col("treated") & (F.col("opening") == F.col("start")), "t").when(~F.col("treated") | (F.col("opening") > F.col("start") + last), "c")
    rows = rows.withColumn("role", role).where("role is not null and try_element_at(y, start) is not null")
    size = lag // halves

    def part(h):
        seen = F.filter(F.slice("y", F.col("start") - lag + h * size + 1, size), lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(seen, F.lit(0.0), lambda a, v: a + v), F.size(seen))

    names = [f"x{h}" for h in range(halves)]
    rows = rows.select("unit", "role", "start", F.concat_ws(":", "city", "start", history(F.col("start"), lag)).alias("block"), *[part(h).alias(n) for h, n in enumerate(names)]).dropna()
    rows = rows.checkpoint()
    near = whitened(rows, names, whitening(rows, names))
    t = near.where("role = 't'").select(F.col("unit").alias("target"), "block", "w", "start")
    found = top_k(t, near.where("role = 'c'").select(F.col("unit").alias("donor"), "block", F.col("w").alias("v")), "block", 1)
    return found.join(t.select("target", "start"), "target").select(F.col("target").alias("treated"), "start", F.col("donor").alias("control"), "d2")


def lead_effects(sets: DataFrame, units: DataFrame, last: int, replicates: int = 200) -> DataFrame:
    """Rows (lead, att, sets, se, low, high, p): mean change of treated against control since the period before the start.

    Standard errors come from redrawn units: each unit's part in all sets is summed once and weighted by its draws. Sets without one of
    the four outcomes of a lead don't count there.
    """
    y = units.select(F.col("unit"), "y")
    j = sets.join(y.select(F.col("unit").alias("treated"), F.col("y").alias("yt")), "treated").join(y.select(F.col("unit").alias("control"), F.col("y").alias("yc")), "control")
    lead = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("lead")
    change = lambda c: F.try_element_at(c, F.col("start") + F.col("lead") + 1) - F.try_element_at(c, F.col("start"))
    j = j.select("treated", "control", "start", "yt", "yc", lead).select("treated", "control", "lead", change(F.col("yt")).alias("a"), change(F.col("yc")).alias("b")).dropna()
    parts = F.explode(F.array(F.struct(F.col("treated").alias("unit"), F.col("a").alias("c"), F.lit(1).alias("n")), F.struct(F.col("control").alias("unit"), (-F.col("b")).alias("c"), F.lit(0).alias("n"))))
    own = j.select("lead", parts.alias("e")).groupBy("lead", F.col("e.unit").alias("unit")).agg(F.sum("e.c").alias("c"), F.sum("e.n").alias("n")).checkpoint()
    point = own.groupBy("lead").agg((F.sum("c") / F.sum("n")).alias("att"), F.sum("n").alias("sets"))
    drawn = own.select("lead", "c", "n", F.posexplode(bootstrap_weights(replicates)).alias("r", "w")).groupBy("lead", "r").agg(F.try_divide(F.sum(F.col("w") * F.col("c")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    spread = drawn.groupBy("lead").agg(F.var_samp("m").alias("v"), (F.count("m") / replicates).alias("valid"))
    return point.join(spread, "lead").select("lead", "att", "sets", *normal_inference(F.col("att"), F.col("v"), F.col("valid")))
