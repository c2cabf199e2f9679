"""Queries of the design and estimation operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import estimators as E
from ..operators import lowrank as L
from ..operators import studies as T
from . import roles as R
from .base import book, ready
from .panels import rel

QUERIES, ORACLE, query = book()

# Each treated unit meets the untreated unit of its city with the next higher number (else the lowest).
R.SQL["pairs"] = """SELECT t.unit AS treated, t.opening, coalesce(min(CASE WHEN c.unit > t.unit THEN c.unit END), min(c.unit)) AS control FROM units t JOIN units c
    ON t.city = c.city AND NOT c.treated WHERE t.treated GROUP BY 1, 2"""
R.SQL["paths"] = """SELECT p.treated, (year(a.period) - year(p.opening)) * 12 + month(a.period) - month(p.opening) AS t, a.y, b.y AS y0 FROM pairs p JOIN panel a ON a.unit = p.treated
    LEFT JOIN panel b ON b.unit = p.control AND b.period = a.period"""


def pairs(s, d):
    u = R.units(s, d)
    donor = F.when(~F.col("treated"), F.col("unit"))
    # The next donor by id in the city, or else the first one: a running value of one sort, no pairs.
    down = Window.partitionBy("city").orderBy(F.col("unit").desc())
    first = u.groupBy("city").agg(F.min(donor).alias("first"))
    j = u.withColumn("next", F.last(donor, ignorenulls=True).over(down)).where("treated").join(first, "city")
    return j.select(F.col("unit").alias("treated"), "opening", F.coalesce("next", "first").alias("control")).where("control is not null")


def paths(s, d):
    p = R.panel(s, d)
    j = pairs(s, d).join(p.select(F.col("unit").alias("treated"), "period", "y"), "treated")
    j = j.join(p.select(F.col("unit").alias("control"), "period", F.col("y").alias("y0")), ["control", "period"], "left")
    return j.select("treated", E.event_time(F.col("period"), F.col("opening")).alias("t"), "y", "y0")


def _did_sql(h: int) -> str:
    post = f"t BETWEEN {max(1, h - 2)} AND {h}"
    base = "t BETWEEN -18 AND -7"
    ok = f"count(y) FILTER (WHERE {post}) >= {min(3, h)} AND count(y0) FILTER (WHERE {post}) >= {min(3, h)} AND count(y) FILTER (WHERE {base}) >= 6 AND count(y0) FILTER (WHERE {base}) >= 6"
    effect = f"avg(y) FILTER (WHERE {post}) - avg(y) FILTER (WHERE {base}) - avg(y0) FILTER (WHERE {post}) + avg(y0) FILTER (WHERE {base})"
    return f"SELECT treated, {h}::INT AS event_time, {ok} AS label_available, round(CASE WHEN {ok} THEN {effect} END, 5) AS effect FROM paths GROUP BY treated"


HORIZONS = [1, 3, 6, 12, 18, 24]


@query("did_label_monthly", " UNION ALL ".join(map(_did_sql, HORIZONS)), "units panel pairs paths")
def _(s, d):
    return E.did_monthly(paths(s, d), HORIZONS, 3, 6, 6).withColumn("effect", F.round("effect", 5))


R.SQL["annual"] = "SELECT unit, year(period)::INT AS year, avg(y) AS y, sum(n)::BIGINT AS n FROM panel GROUP BY 1, 2"


def annual(s, d):
    return R.panel(s, d).groupBy("unit", F.year("period").alias("year")).agg(F.avg("y").alias("y"), F.sum("n").alias("n"))


@query("did_label_annual", """SELECT p.treated, h AS horizon, round((a.y - a0.y) - (b.y - b0.y), 5) AS effect FROM pairs p CROSS JOIN (SELECT unnest([1, 2, 3])::INT AS h) JOIN annual a0 ON a0.unit = p.treated AND a0.year = year(opening) - 1
    JOIN annual b0 ON b0.unit = p.control AND b0.year = year(opening) - 1 LEFT JOIN annual a ON a.unit = p.treated AND a.year = year(opening) + h LEFT JOIN annual b ON b.unit = p.control AND b.year = year(opening) + h""", "units panel pairs annual")
def _(s, d):
    p, a = pairs(s, d), annual(s, d)
    side = lambda who, name, at, how: (lambda df: df.join(a.select(F.col("unit").alias(who), F.col("year").alias("_y"), F.col("y").alias(name)), [who, "_y"], how).drop("_y"), at)
    out = p.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (1, 2, 3)])))
    year = F.year("opening")
    for join, at in (side("treated", "a0", year - 1, "inner"), side("control", "b0", year - 1, "inner"), side("treated", "a", year + F.col("horizon"), "left"), side("control", "b", year + F.col("horizon"), "left")):
        out = join(out.withColumn("_y", at))
    return out.select("treated", "horizon", F.round((F.col("a") - F.col("a0")) - (F.col("b") - F.col("b0")), 5).alias("effect"))


@query("did_regression", """WITH c AS (SELECT treated, t >= 0 AS post, y AS v, 1 AS arm FROM paths WHERE t BETWEEN -12 AND 11 AND y IS NOT NULL UNION ALL SELECT treated, t >= 0, y0, 0 FROM paths WHERE t BETWEEN -12 AND 11 AND y0 IS NOT NULL),
    m AS (SELECT treated, arm, post, avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS ss FROM c GROUP BY 1, 2, 3)
    SELECT treated, round(sum(CASE WHEN arm = 1 THEN 1 ELSE -1 END * CASE WHEN post THEN 1 ELSE -1 END * m), 5) AS beta, round(sqrt(sum(ss) / (sum(n) - 4) * sum(1 / n)), 5) AS se FROM m GROUP BY 1 HAVING count(*) = 4""", "units panel pairs paths")
def _(s, d):
    p = paths(s, d).where(F.col("t").between(-12, 11))
    c = p.select("treated", (F.col("t") >= 0).alias("post"), F.explode(F.array(F.struct(F.lit(1).alias("arm"), F.col("y").alias("v")), F.struct(F.lit(0).alias("arm"), F.col("y0").alias("v")))).alias("x"))
    m = c.select("treated", "post", "x.*").where("v is not null").groupBy("treated", "arm", "post").agg(F.avg("v").alias("m"), F.count("*").alias("n"), (F.var_pop("v") * F.count("*")).alias("ss"))
    sign = F.when(F.col("arm") == 1, 1).otherwise(-1) * F.when(F.col("post"), 1).otherwise(-1)
    g = m.groupBy("treated").agg(F.sum(sign * F.col("m")).alias("b"), F.sum("ss").alias("ss"), F.sum("n").alias("n"), F.sum(1 / F.col("n")).alias("k"), F.count("*").alias("cells")).where("cells = 4")
    return g.select("treated", F.round("b", 5).alias("beta"), F.round(F.sqrt(F.try_divide("ss", F.col("n") - 4) * F.col("k")), 5).alias("se"))


@query("event_calendar", """SELECT unit, t::INT AS event_time, CAST(opening + to_months(CAST(t AS INT)) AS DATE) AS period, CASE WHEN t = -7 THEN 'reference' WHEN t < -7 THEN 'pre' WHEN t < 0 THEN 'anticipation' WHEN t = 0 THEN 'opening' ELSE 'post' END AS role
    FROM units, (SELECT unnest(range(-42, 25)) AS t) WHERE treated""", "units")
def _(s, d):
    return E.event_calendar(R.units(s, d).where("treated"), 36, 24, 6)


@query("event_time", "SELECT unit, period, t::BIGINT AS t FROM rel", "units panel rel")
def _(s, d):
    return rel(s, d).select("unit", "period", "t")


@query("pre_block_features", """SELECT unit, round(avg(y) FILTER (WHERE t BETWEEN -12 AND -1), 5) AS block1, round(avg(y) FILTER (WHERE t BETWEEN -24 AND -13), 5) AS block2, round(avg(y) FILTER (WHERE t BETWEEN -36 AND -25), 5) AS block3,
    count(*) FILTER (WHERE t BETWEEN -12 AND -1) >= 10 AS enough FROM rel GROUP BY unit""", "units panel rel")
def _(s, d):
    block = lambda k: F.round(F.avg(F.when(F.col("t").between(-12 * k, -12 * k + 11), F.col("y"))), 5).alias(f"block{k}")
    return rel(s, d).groupBy("unit").agg(block(1), block(2), block(3), (F.count_if(F.col("t").between(-12, -1)) >= 10).alias("enough"))


@query("pre_path_features", """SELECT unit, list(round(y, 5) ORDER BY k) AS path FROM (SELECT u.unit, k, y FROM units u CROSS JOIN (SELECT unnest(range(-12, 0)) AS k) LEFT JOIN rel r ON r.unit = u.unit AND r.t = k) GROUP BY unit""", "units panel rel")
def _(s, d):
    full = R.units(s, d).select("unit", F.explode(F.sequence(F.lit(-12).cast("long"), F.lit(-1).cast("long"))).alias("t"))
    j = full.join(rel(s, d).select("unit", "t", "y"), ["unit", "t"], "left")
    got = j.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("t", F.round("y", 5).alias("y")))).alias("l"))
    return got.select("unit", F.transform("l", lambda x: x["y"]).alias("path"))


@query("annual_lag_features", """SELECT u.unit, round(max(CASE WHEN year(opening) - year = 1 THEN y END), 5) AS lag1, round(max(CASE WHEN year(opening) - year = 2 THEN y END), 5) AS lag2, round(max(CASE WHEN year(opening) - year = 3 THEN y END), 5) AS lag3
    FROM units u LEFT JOIN annual a USING (unit) GROUP BY 1""", "units panel annual")
def _(s, d):
    j = R.units(s, d).select("unit", "opening").join(annual(s, d), "unit", "left")
    lag = lambda k: F.round(F.max(F.when(F.year("opening") - F.col("year") == k, F.col("y"))), 5).alias(f"lag{k}")
    return j.groupBy("unit").agg(lag(1), lag(2), lag(3))


@query("static_features", """SELECT coalesce(a.unit, b.unit) AS unit, lon, months FROM (SELECT unit, round(lon, 6) AS lon FROM units WHERE lon < 116.3) a FULL JOIN (SELECT unit, count(*) AS months FROM panel WHERE n > 1 GROUP BY 1) b USING (unit)""", "units panel")
def _(s, d):
    a = R.units(s, d).where("lon < 116.3").select("unit", F.round("lon", 6).alias("lon"))
    return a.join(R.panel(s, d).where("n > 1").groupBy("unit").agg(F.count("*").alias("months")), "unit", "full")


FEATURES = ["lag1", "lag2", "lag3"]
R.SQL["features"] = """SELECT unit, city, treated, avg(y) FILTER (WHERE t BETWEEN -12 AND -1) AS lag1, avg(y) FILTER (WHERE t BETWEEN -24 AND -13) AS lag2, avg(y) FILTER (WHERE t BETWEEN -36 AND -25) AS lag3 FROM rel GROUP BY 1, 2, 3"""


def features(s, d, *more):
    block = lambda k: F.avg(F.when(F.col("t").between(-12 * k, -12 * k + 11), F.col("y"))).alias(f"lag{k}")
    return rel(s, d).groupBy("unit", "city", "treated").agg(block(1), block(2), block(3), *more)


@query("feature_split", """SELECT count(*) FILTER (WHERE lag1 IS NOT NULL) = count(*) AS lag1_active, count(*) FILTER (WHERE lag2 IS NOT NULL) = count(*) AS lag2_active, count(*) FILTER (WHERE lag3 IS NOT NULL) = count(*) AS lag3_active FROM features""", "units panel rel features")
def _(s, d):
    return features(s, d).agg(*[F.bool_and(F.col(c).isNotNull()).alias(f"{c}_active") for c in FEATURES])


@query("robust_city_scale", """WITH m AS (SELECT city, median(lag1) AS m, stddev_samp(lag1) AS s FROM features WHERE NOT treated GROUP BY 1), q AS (SELECT f.city, 1.4826::DOUBLE * median(abs(lag1 - m)) AS mad FROM features f JOIN m USING (city) WHERE NOT treated GROUP BY 1)
    SELECT unit, round((lag1 - m) / CASE WHEN mad > 0 THEN mad WHEN s > 0 THEN s ELSE 1 END, 4) AS scaled FROM features JOIN m USING (city) JOIN q USING (city)""", "units panel rel features")
def _(s, d):
    return E.robust_scale(features(s, d), ["city"], "lag1", ~F.col("treated")).select("unit", F.round("scaled", 4).alias("scaled"))


@query("scope_frame", """SELECT unit, city, treated FROM features WHERE lag1 IS NOT NULL AND lag2 IS NOT NULL AND lag3 IS NOT NULL AND city IN (SELECT city FROM features WHERE NOT treated GROUP BY 1 HAVING count(*) >= 3)""", "units panel rel features")
def _(s, d):
    f = features(s, d).dropna(subset=FEATURES)
    enough = f.where("not treated").groupBy("city").agg(F.count("*").alias("k")).where("k >= 3")
    return f.join(enough, "city", "left_semi").select("unit", "city", "treated")


@query("common_support", """WITH b AS (SELECT city, min(lag1) AS a1, max(lag1) AS b1, min(lag2) AS a2, max(lag2) AS b2 FROM features WHERE NOT treated GROUP BY 1) SELECT unit, lag1 BETWEEN a1 AND b1 AND lag2 BETWEEN a2 AND b2 AS supported FROM features JOIN b USING (city) WHERE treated""", "units panel rel features")
def _(s, d):
    f = features(s, d)
    b = f.where("not treated").groupBy("city").agg(*[g(c).alias(f"{n}_{c}") for c in ("lag1", "lag2") for n, g in (("lo", F.min), ("hi", F.max))])
    ok = F.col("lag1").between(F.col("lo_lag1"), F.col("hi_lag1")) & F.col("lag2").between(F.col("lo_lag2"), F.col("hi_lag2"))
    return f.where("treated").join(b, "city").select("unit", ok.alias("supported"))


@query("covariance_whitening")
def _(s, d):
    f = features(s, d).dropna(subset=FEATURES)
    w = E.whitening(f, FEATURES)
    return E.whitened(f, FEATURES, w).select("unit", *[F.round(F.col("w")[k], 6).alias(f"w{k}") for k in range(len(w))])


def whitened_sides(s, d):
    ready(s)
    f = features(s, d).dropna(subset=FEATURES).checkpoint()
    w = E.whitened(f, FEATURES, E.whitening(f, FEATURES))
    return w.where("treated").select(F.col("unit").alias("target"), "city", "w"), w.where("not treated").select(F.col("unit").alias("donor"), "city", F.col("w").alias("v")), w


@query("topk_mahalanobis")
def _(s, d):
    t, c, _ = whitened_sides(s, d)
    return E.top_k(t, c, "city", 5).select("target", "donor", F.round("d2", 6).alias("d2"), "rank")


@query("topk_with_ties", """WITH k AS (SELECT t.unit AS target, c.unit AS donor, power(t.lag1 - c.lag1, 2) AS d2 FROM features t JOIN features c ON t.city = c.city AND t.treated AND NOT c.treated AND t.lag1 IS NOT NULL AND c.lag1 IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d2, donor) AS r FROM k) SELECT k.target, k.donor, round(k.d2, 5) AS d2 FROM k JOIN r ON r.target = k.target AND r.r = 3 WHERE k.d2 <= r.d2 + 1e-10""", "units panel rel features")
def _(s, d):
    ready(s)
    f = features(s, d).where("lag1 is not null").checkpoint()
    t = f.where("treated").select(F.col("unit").alias("target"), "city", F.array("lag1").alias("w"))
    c = f.where("not treated").select(F.col("unit").alias("donor"), "city", F.array("lag1").alias("v"))
    return E.top_k_ties(t, c, "city", 3).select("target", "donor", F.round("d2", 5).alias("d2"))


def placebo(s, d):
    _, c, w = whitened_sides(s, d)
    pseudo = c.where(F.substring(F.sha2(F.col("donor").cast("string"), 256), 1, 1) < "8")
    near = E.top_k(pseudo.select(F.col("donor").alias("target"), "city", F.col("v").alias("w")), c, "city", 1)
    return near.groupBy().agg(E.type8(F.collect_list("d2"), 0.95).alias("limit"))


query("placebo_thresholds")(lambda s, d: placebo(s, d).select(F.round("limit", 6).alias("limit")))


@query("match_refine_gate")
def _(s, d):
    t, c, _ = whitened_sides(s, d)
    u = R.metric(R.units(s, d)).select("unit", "x", "y")
    five = E.top_k(t, c, "city", 5)
    j = five.join(u.select(F.col("unit").alias("target"), "x", "y"), "target").join(u.select(F.col("unit").alias("donor"), F.col("x").alias("dx"), F.col("y").alias("dy")), "donor")
    far = F.hypot(F.col("x") - F.col("dx"), F.col("y") - F.col("dy"))
    one = j.groupBy("target").agg(F.min(F.struct(far.alias("metres"), "donor", "d2")).alias("m")).select("target", "m.*")
    return one.crossJoin(F.broadcast(placebo(s, d))).select("target", "donor", F.round("metres", 3).alias("metres"), (F.col("d2") <= F.col("limit")).alias("passed"))


@query("balance_smd", """WITH f AS (SELECT treated, unnest(['lag1', 'lag2', 'lag3']) AS feature, unnest([lag1, lag2, lag3]) AS v FROM features) SELECT feature, round((avg(v) FILTER (WHERE treated) - avg(v) FILTER (WHERE NOT treated)) /
    sqrt((var_samp(v) FILTER (WHERE treated) + var_samp(v) FILTER (WHERE NOT treated)) / 2), 4) AS smd FROM f GROUP BY 1""", "units panel rel features")
def _(s, d):
    long = features(s, d).unpivot(["treated"], FEATURES, "feature", "v")
    on = lambda g, a: g(F.when(a, F.col("v")))
    t = F.col("treated")
    smd = F.try_divide(on(F.avg, t) - on(F.avg, ~t), F.sqrt((on(F.var_samp, t) + on(F.var_samp, ~t)) / 2))
    return long.groupBy("feature").agg(F.round(smd, 4).alias("smd"))


@query("feature_balance", """SELECT p.treated AS unit, f AS feature, round(g, 4) AS gap FROM (SELECT p.treated, unnest(['lag1', 'lag2', 'lag3']) AS f, unnest([a.lag1 - b.lag1, a.lag2 - b.lag2, a.lag3 - b.lag3]) AS g FROM pairs p JOIN features a ON a.unit = p.treated JOIN features b ON b.unit = p.control) p""", "units panel pairs rel features")
def _(s, d):
    f = features(s, d)
    j = pairs(s, d).join(f.select(F.col("unit").alias("treated"), *FEATURES), "treated").join(f.select(F.col("unit").alias("control"), *[F.col(c).alias(f"c_{c}") for c in FEATURES]), "control")
    wide = j.select(F.col("treated").alias("unit"), *[F.round(F.col(c) - F.col(f"c_{c}"), 4).alias(c) for c in FEATURES])
    return wide.unpivot(["unit"], FEATURES, "feature", "gap")


@query("pair_panel", """SELECT p.treated AS pair, role, x.unit, x.period, x.y FROM pairs p, LATERAL (SELECT unnest(['treated', 'control']) AS role, unnest([p.treated, p.control]) AS unit) r JOIN panel x ON x.unit = r.unit
    WHERE (year(x.period) - year(p.opening)) * 12 + month(x.period) - month(p.opening) BETWEEN -6 AND 6""".replace("x.y FROM", "round(x.y, 6) AS y FROM"), "units panel pairs")
def _(s, d):
    roles = F.explode(F.array(F.struct(F.lit("treated").alias("role"), F.col("treated").alias("unit")), F.struct(F.lit("control").alias("role"), F.col("control").alias("unit"))))
    p = pairs(s, d).select(F.col("treated").alias("pair"), "opening", roles.alias("r")).select("pair", "opening", "r.*")
    j = p.join(R.panel(s, d).select("unit", "period", "y"), "unit").where(E.event_time(F.col("period"), F.col("opening")).between(-6, 6))
    return j.select("pair", "role", "unit", "period", F.round("y", 6).alias("y"))


@query("pair_support_gate", "SELECT treated, t::BIGINT AS t FROM paths WHERE y IS NOT NULL AND y0 IS NOT NULL AND t BETWEEN -12 AND 24", "units panel pairs paths")
def _(s, d):
    return paths(s, d).where(F.col("t").between(-12, 24)).groupBy("treated", F.col("t").cast("long").alias("t")).agg(F.bool_and(F.col("y").isNotNull() & F.col("y0").isNotNull()).alias("ok")).where("ok").drop("ok")


@query("admission_filters", """SELECT CASE WHEN year(day) < 1996 THEN 'too_early' WHEN source = '1-URGENT' THEN 'wrong_source' WHEN price > 5000 THEN 'out_of_range' ELSE 'admitted' END AS reason, count(*) AS n FROM prices GROUP BY 1""", "prices")
def _(s, d):
    reason = F.when(F.year("day") < 1996, "too_early").when(F.col("source") == "1-URGENT", "wrong_source").when(F.col("price") > 5000, "out_of_range").otherwise("admitted")
    return R.prices(s, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def study_panel(s, d):
    r = rel(s, d).withColumn("t", F.when(F.col("treated"), F.greatest(F.lit(-4), F.least(F.lit(4), F.floor(F.col("t") / 6)))).cast("int"))
    return r.select("unit", "city", "period", "y", "t", (F.col("unit") % 10).alias("cluster"))


@query("absorb_two_way")
def _(s, d):
    return T.absorb(study_panel(s, d).select("unit", "period", "y"), ["y"], "unit", "period").select("unit", "period", F.round("y", 6).alias("residual"))


def _study(s, frame, cluster):
    ready(s)
    return E.event_study(frame, "y", "unit", "period", "t", cluster)


@query("twfe_event_study")
def _(s, d):
    rows = _study(s, study_panel(s, d), "unit")
    return s.createDataFrame(rows, "event_time int, estimate double, se double, p double").select("event_time", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "p")])


@query("abadie_imbens_att")
def _(s, d):
    ready(s)
    f = features(s, d, F.avg(F.when(F.year("period") == 2000, F.col("y"))).alias("out")).dropna(subset=[*FEATURES, "out"])
    got = E.abadie_imbens(f.withColumn("id", F.col("unit")), "out", "treated", ["lag1", "lag2"])
    return s.createDataFrame([(got["estimate"], got["se"], got["unadjusted"], got["n_treated"])], "estimate double, se double, unadjusted double, n_treated long").select(
        *[F.round(c, 6).alias(c) for c in ("estimate", "se", "unadjusted")], "n_treated"
    )


@query("hedonic_price", """WITH p AS (SELECT obs_id, city, community, ln(price) AS raw, ln(area) AS la, year(day)::DOUBLE AS yr FROM prices), f AS (SELECT *, raw - avg(raw) OVER w AS y, la - avg(la) OVER w AS a, yr - avg(yr) OVER w AS b FROM p WINDOW w AS (PARTITION BY city, community)),
    m AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM f) SELECT obs_id, round(raw - a * (ay * bb - byy * ab) / (aa * bb - ab * ab) - b * (byy * aa - ay * ab) / (aa * bb - ab * ab), 6) AS adjusted FROM f, m""", "prices")
def _(s, d):
    p = R.prices(s, d).select("obs_id", "city", "community", F.log("price").alias("y"), F.log("area").alias("la"), F.year("day").cast("double").alias("yr"))
    w = Window.partitionBy("city", "community")
    flat = p.select("obs_id", *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ("y", "la", "yr")], F.col("y").alias("raw"))
    beta, _, rss = E.ols(flat, "y", ["la", "yr"])
    return flat.select("obs_id", F.round(F.col("raw") - F.col("la") * float(beta[0]) - F.col("yr") * float(beta[1]), 6).alias("adjusted"))


@query("estimation_panel", """WITH k AS (SELECT unit, count(*) AS pre FROM rel WHERE t < 0 GROUP BY 1 HAVING count(*) >= 36), g AS (SELECT city, avg(y) AS m, stddev_samp(y) AS s FROM rel JOIN k USING (unit) WHERE NOT treated GROUP BY 1)
    SELECT unit, period, CASE WHEN treated THEN 'treated' ELSE 'donor' END AS role, (treated AND t >= 0)::INT AS d, round((y - m) / s, 5) AS model_value FROM rel JOIN k USING (unit) JOIN g USING (city)""", "units panel rel")
def _(s, d):
    r = rel(s, d)
    r = r.join(r.where("t < 0").groupBy("unit").agg(F.count("*").alias("pre")).where("pre >= 36"), "unit")
    g = r.where("not treated").groupBy("city").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"))
    return r.join(g, "city").select("unit", "period", F.when(F.col("treated"), "treated").otherwise("donor").alias("role"), (F.col("treated") & (F.col("t") >= 0)).cast("int").alias("d"), F.round(F.try_divide(F.col("y") - F.col("m"), F.col("sd")), 5).alias("model_value"))


@query("low_rank_fit")
def _(s, d):
    from .counterfactuals import arrays

    units, t = arrays(s, d)
    fit = L.fit_one(units.where("not treated"), t, 2)
    leverage = fit.projection.diagonal()
    rows = [(k, float(fit.effect[k]), float(leverage[k])) for k in range(t)]
    return s.createDataFrame(rows, "time_id int, time_effect double, leverage double").select("time_id", F.round("time_effect", 4).alias("time_effect"), F.round("leverage", 3).alias("leverage"))


R.SQL["effects"] = " UNION ALL ".join(map(_did_sql, HORIZONS))


def effects(s, d):
    return QUERIES["did_label_monthly"](s, d)


@query("effect_labels", """SELECT treated, count(effect) AS n, round(avg(effect), 4) AS mean, round(regr_slope(effect, event_time), 4) AS slope FROM effects GROUP BY 1""", "units panel pairs paths effects")
def _(s, d):
    return effects(s, d).groupBy("treated").agg(F.count("effect").alias("n"), F.round(F.avg("effect"), 4).alias("mean"), F.round(F.regr_slope("effect", F.col("event_time").cast("double")), 4).alias("slope"))


@query("route_estimator_priority", """WITH c AS (SELECT treated, event_time, CASE WHEN treated % 3 = 0 THEN 3 WHEN treated % 2 = 0 THEN 2 ELSE 1 END AS p, effect FROM effects WHERE effect IS NOT NULL UNION ALL SELECT treated, event_time, 2, effect / 2 FROM effects WHERE effect IS NOT NULL AND treated % 4 = 0)
    SELECT treated, event_time, arg_min(p, p)::INT AS route FROM c GROUP BY 1, 2""", "units panel pairs paths effects")
def _(s, d):
    e = effects(s, d).where("effect is not null")
    k = F.col("treated")
    c = e.select("treated", "event_time", F.when(k % 3 == 0, 3).when(k % 2 == 0, 2).otherwise(1).alias("p")).unionByName(e.where(k % 4 == 0).select("treated", "event_time", F.lit(2).alias("p")))
    rank = F.row_number().over(Window.partitionBy("treated", "event_time").orderBy("p"))
    return c.withColumn("r", rank).where("r = 1").select("treated", "event_time", F.col("p").alias("route"))


@query("unit_rollup", """SELECT treated, CASE WHEN bool_and(label_available) THEN 'complete' WHEN bool_or(label_available) THEN 'partial' ELSE 'failed' END AS status, coalesce(string_agg(CASE WHEN NOT label_available THEN event_time::VARCHAR END, ';' ORDER BY event_time), '') AS missing FROM effects GROUP BY 1""", "units panel pairs paths effects")
def _(s, d):
    ok = F.col("label_available")
    missing = F.array_sort(F.collect_list(F.when(~ok, F.col("event_time"))))
    return effects(s, d).groupBy("treated").agg(F.when(F.bool_and(ok), "complete").when(F.bool_or(ok), "partial").otherwise("failed").alias("status"), F.array_join(F.transform(missing, lambda x: x.cast("string")), ";").alias("missing"))


@query("replicate_inference", """WITH r AS (SELECT event_time, abs(hash_k) % 20 AS rep, avg(effect) AS m FROM (SELECT event_time, effect, treated * 31 + event_time AS hash_k FROM effects WHERE effect IS NOT NULL) GROUP BY 1, 2) SELECT event_time, count(*) AS n, round(stddev_samp(m), 5) AS se FROM r GROUP BY 1""", "units panel pairs paths effects")
def _(s, d):
    e = effects(s, d).where("effect is not null").withColumn("rep", (F.col("treated") * 31 + F.col("event_time")) % 20)
    return e.groupBy("event_time", "rep").agg(F.avg("effect").alias("m")).groupBy("event_time").agg(F.count("*").alias("n"), F.round(F.stddev_samp("m"), 5).alias("se"))


@query("type8_quantile", """WITH v AS (SELECT city, list_sort(list(lon)) AS v, count(*) AS n, (count(*) + 1.0::DOUBLE / 3) * 0.95::DOUBLE + 1.0::DOUBLE / 3 AS p FROM units GROUP BY 1), w AS (SELECT *, least(greatest(p, 1), n) AS q FROM v)
    SELECT city, round(v[floor(q)::INT] + (q - floor(q)) * (v[least(floor(q)::INT + 1, n)] - v[floor(q)::INT]), 6) AS q95 FROM w""", "units")
def _(s, d):
    return R.units(s, d).groupBy("city").agg(F.round(E.type8(F.collect_list("lon"), 0.95), 6).alias("q95"))


