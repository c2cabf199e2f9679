"""Queries of surfaces, polygons, name matching and the remaining design operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import estimators as E
from ..operators import panelmatch as M
from ..operators import panels as P
from ..operators import spatial as S
from ..operators import studies as T
from ..operators import surfaces as U
from . import roles as R
from .base import book
from .estimators import effects, pairs, paths, placebo, ready, study_panel, whitened_sides
from .evaluation import X, probe_rows
from .panels import rel
from .sources import scratch

QUERIES, ORACLE, query = book()
EFF = "units panel pairs paths effects"


@query("normalize_community_name")
def _(s, d):
    return R.table(s, d, "part").select("p_partkey", U.normalize_community_name(F.concat(F.lit("Ｎo.①·"), "p_name")).alias("name"))


R.SQL["surf"] = """SELECT city, CAST(floor(y / 4000) AS INT) AS row, CAST(floor(x / 4000) AS INT) AS col, count(*)::DOUBLE AS z FROM mpoints GROUP BY 1, 2, 3"""


def surface(s, d):
    return P.lattice_cell(R.metric(R.points(s, d)), size=4000.0).groupBy("city", "row", "col").agg(F.count("*").cast("double").alias("z"))


SIGMAS, MIN_KM, MIN_AREA = [1.0, 1.5, 2.0], 8.0, 48.0


def fits(s, d):
    """Local quadratic fits of the log counts; cells are 4 km wide."""
    ready(s)
    return U.density_fit(surface(s, d).withColumn("z", F.log1p("z")), ["city"], SIGMAS)


@query("density_peaks")
def _(s, d):
    got = U.significant_peaks(fits(s, d), ["city"], 1)
    return got.select("city", "row", "col", *[F.round(c, 5).alias(c) for c in ("fit", "mean", "t", "p")], "n", "significant")


@query("centre_select")
def _(s, d):
    """The highest peak of a city is its main centre; other peaks are subcentres where they are significant and far enough from it,
    and where enough of the area around them stands above the city's median."""
    f = fits(s, d).checkpoint()
    peaks = U.significant_peaks(f, ["city"], 1)
    high = f.join(f.groupBy("city").agg(F.percentile("fit", 0.5).alias("floor")), "city").where("fit >= floor")
    area = U.offsets(peaks.select("city", "row", "col"), 2, keep_self=True).join(high.select("city", F.col("row").alias("nrow"), F.col("col").alias("ncol")), ["city", "nrow", "ncol"])
    area = area.groupBy("city", "row", "col").agg((F.count("*") * 16.0).alias("km2"))
    main = P.first_rows(peaks, ["city"], [F.col("fit").desc(), F.col("row"), F.col("col")]).select("city", F.col("row").alias("r0"), F.col("col").alias("c0"))
    j = peaks.join(main, "city").join(area, ["city", "row", "col"], "left").fillna(0.0, ["km2"]).withColumn("km", 4 * F.hypot(F.col("row") - F.col("r0"), F.col("col") - F.col("c0")))
    role = F.when(F.col("km") == 0, "main").when(~F.col("significant"), "not_significant").when(F.col("km") < MIN_KM, "too_near").when(F.col("km2") < MIN_AREA, "too_small").otherwise("sub")
    return j.select("city", "row", "col", F.round("fit", 5).alias("fit"), F.round("km", 3).alias("km"), "km2", role.alias("role"))


@query("contiguous_support")
def _(s, d):
    ready(s)
    w = surface(s, d)
    floor = w.groupBy("city").agg(F.percentile("z", 0.5).alias("floor"))
    high = w.join(floor, "city").where("z >= floor")
    seeds = P.first_rows(high, ["city"], [F.col("z").desc(), F.col("row"), F.col("col")]).withColumn("seed", F.lit(1))
    return U.grow(high, seeds, ["city"], 3).groupBy("city").agg((F.count("*") * 16.0).alias("km2"))


@query("centre_validation", """WITH top AS (SELECT city, row AS r0, col AS c0 FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY z DESC, row, col) AS r FROM surf) WHERE r = 1), v AS (SELECT ln(1 + sqrt((row - r0) * (row - r0) + (col - c0) * (col - c0))) AS dist, ln(1 + z) AS lz FROM surf JOIN top USING (city))
    SELECT round(regr_slope(lz, dist), 6) AS slope, round(regr_r2(lz, dist), 6) AS r2 FROM v""", "points mpoints surf")
def _(s, d):
    w = surface(s, d)
    top = P.first_rows(w, ["city"], [F.col("z").desc(), F.col("row"), F.col("col")]).select("city", F.col("row").alias("r0"), F.col("col").alias("c0"))
    j = w.join(top, "city").select(F.lit(1.0).alias("one"), F.log1p(F.hypot(F.col("row") - F.col("r0"), F.col("col") - F.col("c0"))).alias("dist"), F.log1p("z").alias("lz"))
    beta, _, rss = E.ols(j, "lz", ["one", "dist"])
    n, t, q = E.moments(j, ["lz"])
    return s.createDataFrame([(round(float(beta[1]), 6), round(1 - rss / float(q[0, 0] - t[0] ** 2 / n), 6))], "slope double, r2 double")


@query("local_density_fit")
def _(s, d):
    return fits(s, d).select("city", "row", "col", "sigma", *[F.round(c, 5).alias(c) for c in ("fit", "loo", "mass")], F.round(F.sqrt("variance"), 5).alias("se"))


def communities(s, d):
    return R.metric(R.prices(s, d).groupBy("community").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))).withColumn("name", F.concat(F.lit("garden"), F.col("community") % 7, F.lit("court"), "community"))


def matched(s, d):
    c = communities(s, d)
    right = c.select(F.col("community").alias("right"), (F.col("x") + 200).alias("rx"), F.col("y").alias("ry"), F.regexp_replace("name", "court", "crt").alias("rname"))
    near = S.within(c.select("community", "x", "y", "name"), right, 1500.0).withColumnRenamed("distance", "metres")
    return U.match_names(near, "community")


query("community_match")(lambda s, d: matched(s, d).select("community", "right", F.round("ratio", 6).alias("ratio"), F.round("metres", 2).alias("metres"), "status"))


@query("community_registry")
def _(s, d):
    m = matched(s, d).where("status = 'matched'").select("community", "right")
    c = communities(s, d).select("community", F.round("lon", 6).alias("lon"))
    return S.join_validated(c, m, ["community"]).select(F.coalesce("right", "community").alias("entity"), "community", "lon", F.when(F.col("right").isNotNull(), "A").otherwise("B").alias("grade"))


@query("substring_match", """SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, c_nationkey, right(c_name, 3) AS k FROM customer) JOIN supplier ON c_nationkey = s_nationkey AND contains(s_name, k)""")
def _(s, d):
    c = R.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.right("c_name", F.lit(3)).alias("k"))
    v = R.table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_name")
    grams = v.withColumn("k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s_name") - 2), lambda i: F.substring(F.col("s_name"), i, F.lit(3))))))
    return c.join(grams, ["nation", "k"]).select("c_custkey", "s_suppkey")


def hulls(s, d):
    """Hulls or discs of the communities. The tables spread a community over its city, so that the trim is 2 km here, and the largest area
    that of its circle."""
    p = R.prices(s, d).withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))
    h = U.robust_hulls(R.metric(p).select("community", "x", "y"), "community", 2000.0, most=1.3e7)
    return U.hulls_or_discs(h.withColumn("city", F.col("community") % 5), "city")


@query("aoi_hull_fallback")
def _(s, d):
    return hulls(s, d).select("community", "source", "n_points", F.size("ring").alias("vertices"), F.round(U.ring_area(F.col("ring")) / 1e6, 4).alias("km2"))


@query("aoi_known_boundary")
def _(s, d):
    c = communities(s, d).select("community", F.col("x").alias("cx"), F.col("y").alias("cy"))
    h = hulls(s, d).where("size(ring) >= 3").join(c, "community").withColumn("km2", U.ring_area(F.col("ring")) / 1e6)
    mid = lambda k: F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[k]) / F.size("ring")
    far = F.hypot(mid("x") - F.col("cx"), mid("y") - F.col("cy"))
    return h.where(F.col("km2").between(1, 900) & (far <= 5000)).select("community", F.round("km2", 4).alias("km2"), F.round(far, 2).alias("metres"))


def bridge(s, d):
    return U.cell_shares(hulls(s, d).where("size(ring) >= 3"), "community", 4000.0)


query("aoi_grid_bridge")(lambda s, d: bridge(s, d).select("community", "col", "row", F.round("share", 6).alias("share")))


@query("aoi_bridge_checks")
def _(s, d):
    g = bridge(s, d).groupBy("community").agg(F.sum("share").alias("w"), F.count("*").alias("n"), F.count_distinct("col", "row").alias("k"))
    return g.agg(F.count("*").alias("polygons"), F.count_if(F.abs(F.col("w") - 1) > 1e-9).alias("bad_weights"), F.count_if(F.col("n") != F.col("k")).alias("repeated_cells"))


@query("road_grid_metrics")
def _(s, d):
    u = R.metric(R.units(s, d))
    w = Window.partitionBy("city").orderBy("unit")
    seg = u.select("x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    return U.segment_lengths(seg, 4000.0).groupBy("col", "row").agg(F.round(F.sum("length"), 3).alias("metres"), F.count("*").alias("pieces"))


@query("sequence_binding", """SELECT unit, count(*) FILTER (WHERE t < 0) AS pre_frames, count(*) = 12 AS complete FROM rel WHERE treated AND t BETWEEN -6 AND 5 GROUP BY 1""", "units panel rel")
def _(s, d):
    return rel(s, d).where("treated and t between -6 and 5").groupBy("unit").agg(F.count_if(F.col("t") < 0).alias("pre_frames"), (F.count("*") == 12).alias("complete"))


@query("visual_pair_index", """SELECT unit, h::INT AS horizon, count(*) FILTER (WHERE t BETWEEN -3 AND -1) AS before, count(*) FILTER (WHERE t BETWEEN h AND h + 2) AS after, count(*) FILTER (WHERE t BETWEEN -3 AND -1) > 0 AND count(*) FILTER (WHERE t BETWEEN h AND h + 2) > 0 AS usable
    FROM rel, (SELECT unnest([1, 6, 12]) AS h) WHERE treated GROUP BY 1, 2""", "units panel rel")
def _(s, d):
    r = S.skeleton(rel(s, d).where("treated").select("unit", "t"), s.createDataFrame([(1,), (6,), (12,)], "horizon int"))
    before, after = F.count_if(F.col("t").between(-3, -1)), F.count_if(F.col("t").between(F.col("horizon"), F.col("horizon") + 2))
    return r.groupBy("unit", "horizon").agg(before.alias("before"), after.alias("after"), ((before > 0) & (after > 0)).alias("usable"))


@query("run_summary", """SELECT user_id, arg_max(value, (ts, event_id)) AS latest, count(*) AS records FROM events GROUP BY 1""")
def _(s, d):
    out = scratch(s)
    e = R.table(s, d, "events").select("user_id", F.struct("value", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")).alias("record"))
    e.write.json(out)
    j = s.read.schema("user_id long, record struct<value:double,event_id:long,ts:string>").json(out)
    return j.groupBy("user_id").agg(F.max_by("record.value", F.struct("record.ts", "record.event_id")).alias("latest"), F.count("*").alias("records"))


@query("few_shot_probe")
def _(s, d):
    from ..operators import evaluation as V

    e, rows = probe_rows(s, d), []
    test = e.where("vec_id % 5 = 0")
    for shots in (50, 100, 200):
        order = Window.orderBy(F.sha2(F.col("vec_id").cast("string"), 256))
        train = e.where("vec_id % 5 > 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= shots)
        err = F.col("label") - V.predict(X, V.ridge(train, "label", X, 1.0))
        rows.append((shots, round(float(test.agg(F.sqrt(F.avg(err * err))).first()[0]), 5)))
    return s.createDataFrame(rows, "shots int, rmse double")


def study_fit(s, d):
    """Coefficients, covariance and clusters of the study with a treated x early and a treated x post dummy."""
    ready(s)
    t = F.coalesce(F.col("t"), F.lit(-1))
    return T.study(study_panel(s, d), F.col("y"), [(t < -1).cast("double"), (t >= 0).cast("double")], "unit", "period", "cluster")[""][:3]


def pre_strata(s, d):
    """Third of its city that each unit's mean outcome before the openings falls into: low, middle or high."""
    means = rel(s, d).where("t < 0").groupBy("unit", "city").agg(F.avg("y").alias("m"))
    cuts = means.groupBy("city").agg(F.percentile("m", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cuts"))
    place = F.when(F.col("m") <= F.col("cuts")[0], "low").when(F.col("m") <= F.col("cuts")[1], "middle").otherwise("high")
    return means.join(cuts, "city").select("unit", place.alias("stratum"))


@query("cluster_covariance")
def _(s, d):
    beta, v, g = study_fit(s, d)
    return s.createDataFrame([(n, round(float(b), 6), round(float(v[k, k]) ** 0.5, 6), g) for k, (n, b) in enumerate(zip(("early", "post"), beta))], "term string, estimate double, se double, clusters int")


@query("wald_joint")
def _(s, d):
    beta, v, g = study_fit(s, d)
    f, rank, p = E.wald(beta, v, g - 1)
    return s.createDataFrame([(round(f, 5), rank, g - 1, round(float(p), 6))], "f double, df1 int, df2 int, p double")


@query("stratified_event_study")
def _(s, d):
    ready(s)
    rows = T.event_studies(study_panel(s, d).join(pre_strata(s, d), "unit"), "y", "unit", "period", "t", "cluster", by="stratum")
    out = s.createDataFrame([(k, t, b, se, float(E.t_p_value(b / se, g - 1)) if se and g > 1 else None, g) for k, t, b, se, g in rows], "stratum string, event_time int, estimate double, se double, p double, clusters int")
    return out.select("stratum", "event_time", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "p")], "clusters")


@query("sun_abraham")
def _(s, d):
    """Cohorts are the quarters of the openings."""
    ready(s)
    u = R.units(s, d).select("unit", (F.year("opening") * 4 + F.quarter("opening")).cast("int").alias("cohort"))
    rows = T.cohort_studies(study_panel(s, d).join(u, "unit"), "y", "unit", "period", "t", "cohort", "unit")
    return s.createDataFrame(rows, "event_time int, estimate double, se double, cohorts int").select("event_time", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"), "cohorts")


@query("control_design")
def _(s, d):
    t, c, _ = whitened_sides(s, d)
    best = E.top_k(t, c, "city", 1)
    all_t = R.units(s, d).where("treated").select(F.col("unit").alias("target"))
    j = all_t.join(best, "target", "left").crossJoin(F.broadcast(placebo(s, d)))
    status = F.when(F.col("donor").isNull(), "no_donor").when(F.col("d2") <= F.col("limit"), "matched").otherwise("fallback")
    return j.select("target", "donor", F.round("d2", 6).alias("d2"), status.alias("status"))


@query("panelmatch_att")
def _(s, d):
    from .counterfactuals import arrays

    u, _ = arrays(s, d)
    units = u.join(R.units(s, d).select("unit", "city"), "unit").select("unit", "city", "treated", F.col("start").alias("opening"), "y")
    got = M.lead_effects(M.matched_sets(units, 12, 11), units, 11)
    return got.select("lead", "sets", *[F.round(c, 5).alias(c) for c in ("att", "se", "low", "high", "p")])


@query("preonly_pairs", """SELECT treated, round(avg(y - y0) FILTER (WHERE t BETWEEN -12 AND -1) - avg(y - y0) FILTER (WHERE t BETWEEN -24 AND -13), 5) AS change FROM paths GROUP BY 1""", "units panel pairs paths")
def _(s, d):
    g = F.col("y") - F.col("y0")
    block = lambda a, b: F.avg(F.when(F.col("t").between(a, b), g))
    return paths(s, d).groupBy("treated").agg(F.round(block(-12, -1) - block(-24, -13), 5).alias("change"))


@query("robustness_grid", """WITH near AS (SELECT c.unit AS control, min(sqrt(power(c.x - t.x, 2) + power(c.y - t.y, 2))) AS metres FROM munits c JOIN munits t ON t.treated AND NOT c.treated WHERE power(c.x - t.x, 2) + power(c.y - t.y, 2) <= 4000000 GROUP BY 1),
    specs AS (SELECT * FROM (SELECT unnest([0, 6, 12]) AS anticipation) JOIN (SELECT unnest([1, 3]) AS "window") ON true JOIN (SELECT unnest([0.0::DOUBLE, 1000, 1500, 2000]) AS radius) ON true JOIN (SELECT unnest([6, 12]) AS h) ON true),
    c AS (SELECT p.treated, p.t, p.y, p.y0, s.* FROM paths p JOIN pairs q ON q.treated = p.treated LEFT JOIN near n ON n.control = q.control JOIN specs s ON coalesce(n.metres, 1e9) > s.radius),
    g AS (SELECT treated, anticipation, "window", radius, h, avg(y) FILTER (WHERE base) AS b, avg(y0) FILTER (WHERE base) AS b0, count(y) FILTER (WHERE base) AS nb, count(y0) FILTER (WHERE base) AS nb0,
        avg(y) FILTER (WHERE post) AS m, avg(y0) FILTER (WHERE post) AS m0, count(y) FILTER (WHERE post) AS np, count(y0) FILTER (WHERE post) AS np0
        FROM (SELECT *, t BETWEEN -anticipation - 12 AND -anticipation - 1 AS base, t BETWEEN greatest(1, h - "window" + 1) AND h AS post FROM c) GROUP BY 1, 2, 3, 4, 5)
    SELECT anticipation, "window", radius, h AS event_time, round(avg(m - b - m0 + b0) FILTER (WHERE ok), 4) AS mean, count(m - b - m0 + b0) FILTER (WHERE ok) AS n FROM (SELECT *, np >= least("window", h) AND np0 >= least("window", h) AND nb >= 6 AND nb0 >= 6 AS ok FROM g) GROUP BY 1, 2, 3, 4""", "units munits panel pairs paths")
def _(s, d):
    """Mean matched effect for every specification: anticipation x outcome window x donors' distance from any opening.

    Specifications are rows that the paths are crossed with, and grouping keys from there on."""
    u = R.metric(R.units(s, d)).select("unit", "x", "y", "treated")
    near = S.within(u.where("not treated").select("unit", "x", "y"), u.where("treated").select(F.col("x").alias("rx"), F.col("y").alias("ry")), 2000.0)
    far = near.withColumn("metres", F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))).groupBy(F.col("unit").alias("control")).agg(F.min("metres").alias("metres"))
    specs = s.createDataFrame([(a, w, r) for a in (0, 6, 12) for w in (1, 3) for r in (0.0, 1000.0, 1500.0, 2000.0)], "anticipation int, window int, radius double")
    p = paths(s, d).join(pairs(s, d).select("treated", "control"), "treated").join(far, "control", "left")
    crossed = p.join(F.broadcast(specs), F.coalesce(F.col("metres"), F.lit(1e9)) > F.col("radius"))
    key, out = ["anticipation", "window", "radius"], []
    base = F.col("t").between(-F.col("anticipation") - 12, -F.col("anticipation") - 1)
    aggs = [F.count(F.when(base, F.col("y"))).alias("nb"), F.count(F.when(base, F.col("y0"))).alias("nb0")]
    for h in (6, 12):
        inside = F.col("t").between(F.greatest(F.lit(1), h - F.col("window") + 1), h)
        aggs += [g(F.when(inside, F.col(c))).alias(f"{n}{c}{h}") for c in ("y", "y0") for n, g in (("m", F.avg), ("n", F.count))]
    # Baselines of both sides may have different months, so each has its own mean.
    aggs += [F.avg(F.when(base, F.col(c))).alias(f"b{c}") for c in ("y", "y0")]
    wide = crossed.groupBy(*key, "treated").agg(*aggs)
    for h in (6, 12):
        ok = (F.col(f"ny{h}") >= F.least("window", F.lit(h))) & (F.col(f"ny0{h}") >= F.least("window", F.lit(h))) & (F.col("nb") >= 6) & (F.col("nb0") >= 6)
        out.append(F.struct(F.lit(h).alias("event_time"), F.when(ok, F.col(f"my{h}") - F.col("by") - F.col(f"my0{h}") + F.col("by0")).alias("effect")))
    long = wide.select(*key, F.explode(F.array(*out)).alias("e")).groupBy(*key, "e.event_time").agg(F.round(F.avg("e.effect"), 4).alias("mean"), F.count("e.effect").alias("n"))
    return long
