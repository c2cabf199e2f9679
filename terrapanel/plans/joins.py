"""Queries of the spatial, temporal and relational joins."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import panels as P
from ..operators import spatial as S
from . import roles as R
from .base import book, ready
from .panels import rel

QUERIES, ORACLE, query = book()
CELL = "CAST(floor(x / 500) AS INT) AS col, CAST(floor(y / 500) AS INT) AS row"
SUB = "(x - 500 * floor(x / 500))"
SUBY = "(y - 500 * floor(y / 500))"


def mpoints(s, d):
    return R.metric(R.points(s, d))


def stations(s, d):
    u = R.metric(R.units(s, d))
    return u.select("unit", "city", "opening", F.col("x").alias("rx"), F.col("y").alias("ry"))


@query("grid_generate", """SELECT a.c AS col, b.r AS row, concat('g', b.r, 'x', a.c) AS grid_id, a.c * 2000.0::DOUBLE AS xmin, b.r * 2000.0::DOUBLE AS ymin FROM
    (SELECT unnest(range(floor(min(x) / 2000)::BIGINT, floor(max(x) / 2000)::BIGINT + 1)) AS c FROM mpoints) a,
    (SELECT unnest(range(floor(min(y) / 2000)::BIGINT, floor(max(y) / 2000)::BIGINT + 1)) AS r FROM mpoints) b""", "points mpoints")
def _(s, d):
    return S.grid(mpoints(s, d), 2000.0).select("col", "row", "grid_id", "xmin", "ymin")


@query("grid_station_bbox", """WITH b AS (SELECT city, min(x) - 1000 AS x0, max(x) + 1000 AS x1, min(y) - 1000 AS y0, max(y) + 1000 AS y1 FROM munits GROUP BY city)
    SELECT city, ((floor(x1 / 500) - floor(x0 / 500) + 1) * (floor(y1 / 500) - floor(y0 / 500) + 1))::BIGINT AS cells FROM b""", "units munits")
def _(s, d):
    u = R.metric(R.units(s, d))
    ends = u.select("city", F.explode(F.array(F.lit(-1000.0), F.lit(1000.0))).alias("k"), "x", "y")
    return S.grid(ends.withColumn("x", F.col("x") + F.col("k")).withColumn("y", F.col("y") + F.col("k")), 500.0, ["city"]).groupBy("city").agg(F.count("*").alias("cells"))


RING = [(2000.0, 2000.0), (30000.0, 4000.0), (25000.0, 40000.0), (5000.0, 30000.0)]


@query("grid_clip_boundary")
def _(s, d):
    g = S.grid(mpoints(s, d), 2000.0)
    x, y = F.col("cx"), F.col("cy")
    return g.where(S.inside(x, y, RING) | (S.segment_distance(x, y, RING) <= 1000)).select("grid_id", "col", "row")


@query("lattice_origin", """WITH c AS (SELECT city, x - (floor(x / 500) + 0.5) * 500 + 250 AS r FROM munits) SELECT city, round(median(r), 4) AS origin, round(max(abs(r)), 4) AS residual FROM c GROUP BY 1""", "units munits")
def _(s, d):
    r = F.col("x") - (F.floor(F.col("x") / 500) + 0.5) * 500 + 250
    return R.metric(R.units(s, d)).groupBy("city").agg(F.round(F.median(r), 4).alias("origin"), F.round(F.max(F.abs(r)), 4).alias("residual"))


@query("lattice_assign", f"SELECT point_id, {CELL}, round(least({SUB}, 500 - {SUB}, {SUBY}, 500 - {SUBY}), 4) AS edge FROM mpoints", "points mpoints")
def _(s, d):
    return P.lattice_cell(mpoints(s, d)).select("point_id", "col", "row", F.round("edge", 4).alias("edge"))


SNAP = "round(x / 250) * 250 AS x, round(y / 250) * 250 AS y"


@query("point_in_cell_closed", f"""WITH p AS (SELECT point_id, {SNAP} FROM mpoints) SELECT point_id, ((CASE WHEN x = floor(x / 500) * 500 THEN 2 ELSE 1 END)
    * (CASE WHEN y = floor(y / 500) * 500 THEN 2 ELSE 1 END))::BIGINT AS cells, CASE WHEN x = floor(x / 500) * 500 OR y = floor(y / 500) * 500 THEN 'boundary' ELSE 'unique' END AS status FROM p""",
    "points mpoints")
def _(s, d):
    snap = lambda c: F.round(F.col(c) / 250) * 250
    p = mpoints(s, d).withColumn("x", snap("x")).withColumn("y", snap("y"))
    n = S.touching_cells(p, 500.0).groupBy("point_id").agg(F.count("*").alias("cells"))
    return n.select("point_id", "cells", F.when(F.col("cells") > 1, "boundary").otherwise("unique").alias("status"))


@query("point_in_cell_open", f"""SELECT city, {CELL}, count(*) AS n FROM (SELECT point_id, city, {SNAP} FROM mpoints) WHERE x <> floor(x / 500) * 500 AND y <> floor(y / 500) * 500 GROUP BY ALL""", "points mpoints")
def _(s, d):
    snap = lambda c: F.round(F.col(c) / 250) * 250
    p = P.lattice_cell(mpoints(s, d).withColumn("x", snap("x")).withColumn("y", snap("y")))
    return p.where("edge > 0").groupBy("city", "col", "row").agg(F.count("*").alias("n"))


@query("bbox_lookup", """SELECT point_id, unit FROM mpoints p JOIN munits u ON abs(p.x - u.x) <= 250 AND abs(p.y - u.y) <= 250""", "points mpoints units munits")
def _(s, d):
    near = S.within(mpoints(s, d).select("point_id", "x", "y"), stations(s, d).select("unit", "rx", "ry"), 360.0)
    return near.where((F.abs(F.col("x") - F.col("rx")) <= 250) & (F.abs(F.col("y") - F.col("ry")) <= 250)).select("point_id", "unit")


@query("nearest_event_distance", """WITH c AS (SELECT DISTINCT city, floor(x / 500) * 500 + 250 AS cx, floor(y / 500) * 500 + 250 AS cy FROM mpoints WHERE point_id % 20 = 0),
    k AS (SELECT c.*, unit, sqrt(power(greatest(abs(x - cx) - 250, 0), 2) + power(greatest(abs(y - cy) - 250, 0), 2)) AS dist FROM c JOIN munits u ON c.city = u.city)
    SELECT city, cx, cy, round(min(dist), 3) AS distance, min(dist) <= 2000 AS in_2000 FROM k GROUP BY 1, 2, 3 HAVING min(dist) <= 5000""", "points mpoints units munits")
def _(s, d):
    c = mpoints(s, d).where("point_id % 20 = 0").select("city", ((F.floor(F.col("x") / 500) * 500) + 250.0).alias("x"), ((F.floor(F.col("y") / 500) * 500) + 250.0).alias("y")).distinct()
    near = S.within(c, stations(s, d), 5400.0, ["city"])
    dist = S.rectangle_distance(F.col("rx"), F.col("ry"), F.col("x"), F.col("y"), 250.0)
    got = near.groupBy("city", F.col("x").alias("cx"), F.col("y").alias("cy")).agg(F.min(dist).alias("m")).where("m <= 5000")
    return got.select("city", "cx", "cy", F.round("m", 3).alias("distance"), (F.col("m") <= 2000).alias("in_2000"))


@query("cell_event_lists", """SELECT city, CAST(floor(x / 4000) AS INT) AS col, CAST(floor(y / 4000) AS INT) AS row, count(*) AS n, string_agg(unit::VARCHAR, ';' ORDER BY opening, unit) AS units
    FROM munits GROUP BY 1, 2, 3""", "units munits")
def _(s, d):
    c = P.lattice_cell(R.metric(R.units(s, d)), size=4000.0).groupBy("city", "col", "row").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("opening", "unit"))).alias("l"))
    return c.select("city", "col", "row", "n", F.array_join(F.transform("l", lambda x: x["unit"].cast("string")), ";").alias("units"))


NEAR = """WITH k AS (SELECT point_id, unit, sqrt(power(p.x - u.x, 2) + power(p.y - u.y, 2)) AS dist FROM mpoints p JOIN munits u ON abs(p.x - u.x) <= 1500 AND abs(p.y - u.y) <= 1500)
    SELECT point_id, arg_min(unit, (dist, unit)) AS unit, round(min(dist), 3) AS distance FROM k WHERE dist <= 1500 GROUP BY point_id"""


@query("nearest_centroid_within", NEAR, "points mpoints units munits")
def _(s, d):
    ready(s)
    got = S.nearest_within(mpoints(s, d).select("point_id", "x", "y").distinct(), stations(s, d).select("unit", "rx", "ry"), 1500.0, "unit")
    return got.select("point_id", F.round("distance", 3).alias("distance"), "unit")


@query("nearest_radius_reject", """WITH k AS (SELECT o.community, u.unit, 2 * 6371008.8::DOUBLE * asin(sqrt(least(power(sin(radians(u.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(u.lat)) * power(sin(radians(u.lon - o.lon) / 2), 2), 1))) AS m
    FROM (SELECT community, avg(lon) AS lon, avg(lat) AS lat FROM prices GROUP BY 1) o, units u) SELECT community, arg_min(unit, (m, unit)) AS unit, round(min(m), 2) AS metres FROM k GROUP BY 1 HAVING min(m) <= 3000""", "prices units")
def _(s, d):
    c = R.metric(R.prices(s, d).groupBy("community").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")))
    u = R.metric(R.units(s, d)).select("unit", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    m = S.haversine(F.col("lon"), F.col("lat"), F.col("rlon"), F.col("rlat"))
    near = S.within(c, u, 3200.0).withColumn("m", m).where("m <= 3000").groupBy("community").agg(F.min(F.struct("m", "unit")).alias("b"))
    return near.select("community", "b.unit", F.round("b.m", 2).alias("metres"))


@query("radius_join_all", """SELECT unit, count(*) AS n, round(avg(sqrt(power(p.x - u.x, 2) + power(p.y - u.y, 2))), 3) AS mean FROM mpoints p JOIN munits u ON
    power(p.x - u.x, 2) + power(p.y - u.y, 2) <= 1000000 GROUP BY unit""", "points mpoints units munits")
def _(s, d):
    near = S.within(mpoints(s, d).select("point_id", "x", "y"), stations(s, d).select("unit", "rx", "ry"), 1000.0)
    return near.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 3).alias("mean"))


@query("buffer_counts", """WITH k AS (SELECT p.point_id, u.unit, u.city, sqrt(power(p.x - u.x, 2) + power(p.y - u.y, 2)) AS dist FROM mpoints p JOIN munits u ON abs(p.x - u.x) <= 1500 AND abs(p.y - u.y) <= 1500)
    SELECT point_id, count(*) FILTER (WHERE dist <= 500) AS n500, count(*) FILTER (WHERE dist <= 800) AS n800, count(*) AS n1500, count(DISTINCT city) AS lines, round(min(dist), 3) AS nearest
    FROM k WHERE dist <= 1500 GROUP BY 1""", "points mpoints units munits")
def _(s, d):
    near = S.within(mpoints(s, d).select("point_id", "x", "y"), stations(s, d).select("unit", F.col("city").alias("line"), "rx", "ry"), 1500.0)
    return near.groupBy("point_id").agg(
        F.count_if(F.col("distance") <= 500).alias("n500"), F.count_if(F.col("distance") <= 800).alias("n800"), F.count("*").alias("n1500"),
        F.count_distinct("line").alias("lines"), F.round(F.min("distance"), 3).alias("nearest"),
    )


@query("centre_distances", """SELECT point_id, round(least(a, b, c), 3) AS nearest, round(a, 3) AS main, round(least(b, c), 3) AS sub FROM (SELECT point_id, sqrt(power(x - 17000, 2) + power(y - 22000, 2)) AS a,
    sqrt(power(x - 6000, 2) + power(y - 9000, 2)) AS b, sqrt(power(x - 28000, 2) + power(y - 35000, 2)) AS c FROM mpoints)""", "points mpoints")
def _(s, d):
    centres = s.createDataFrame([("main", 17000.0, 22000.0), ("sub", 6000.0, 9000.0), ("sub", 28000.0, 35000.0)], "role string, rx double, ry double")
    far = S.skeleton(mpoints(s, d).select("point_id", "x", "y"), centres).withColumn("m", F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")))
    best = lambda r: F.round(F.min(F.when(F.col("role") == r, F.col("m"))), 3).alias(r)
    return far.groupBy("point_id").agg(F.round(F.min("m"), 3).alias("nearest"), best("main"), best("sub"))


@query("alias_match", """SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS unit, CASE WHEN a.s_suppkey IS NOT NULL THEN 'exact' WHEN b.s_suppkey IS NOT NULL THEN 'core' ELSE 'none' END AS quality FROM
    (SELECT c_custkey, 'Supplier#' || lpad((c_custkey % 300)::VARCHAR, 9, '0') AS name FROM customer) c LEFT JOIN supplier a ON c.c_custkey % 2 = 0 AND a.s_name = c.name LEFT JOIN supplier b ON a.s_suppkey IS NULL AND lower(replace(b.s_name, '#', '')) = lower(replace(c.name, '#', ''))""")
def _(s, d):
    c = R.table(s, d, "customer").select("c_custkey", F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 300).cast("string"), 9, "0")).alias("name"))
    c = c.withColumn("name", F.when(F.col("c_custkey") % 2 == 0, F.col("name")).otherwise(F.lower("name")))
    core = lambda x: F.lower(F.regexp_replace(x, "#", ""))
    sup = R.table(s, d, "supplier").select("s_suppkey", "s_name")
    exact = sup.select(F.col("s_suppkey").alias("e"), F.col("s_name").alias("name"))
    cores = sup.select(F.col("s_suppkey").alias("k"), core("s_name").alias("core"))
    got = c.withColumn("core", core("name")).join(exact, "name", "left").join(cores, "core", "left")
    return got.select("c_custkey", F.coalesce("e", "k").alias("unit"), F.when(F.col("e").isNotNull(), "exact").when(F.col("k").isNotNull(), "core").otherwise("none").alias("quality"))


@query("crosswalk_with_fallback", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN s.s_suppkey END, n_nationkey + 100000) AS entity FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(s, d):
    c = R.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    walk = R.table(s, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("w"))
    reg = R.table(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") + 100000).cast("long").alias("f"))
    return c.join(walk, "c_custkey", "left").join(reg, "n_nationkey").select("c_custkey", F.coalesce("w", "f").alias("entity"))


@query("promote_unresolved", """SELECT o_custkey AS entity, count(*) AS n, min(o_orderdate)::DATE AS first_day FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""")
def _(s, d):
    o, sup = R.table(s, d, "orders"), R.table(s, d, "supplier")
    return o.join(sup, o.o_custkey == sup.s_suppkey, "left_anti").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("n"), F.min("o_orderdate").cast("date").alias("first_day"))


@query("cross_source_duplicates", """SELECT a.obs_id AS a, b.obs_id AS b, CASE WHEN abs(a.price - b.price) <= 0.1 * b.price AND abs(a.area - b.area) <= 0.05 * b.area THEN 'strict'
    WHEN abs(a.price - b.price) <= 0.5 * b.price THEN 'loose' ELSE 'different' END AS class FROM prices a JOIN prices b ON a.community = b.community AND a.day = b.day AND a.source < b.source""", "prices")
def _(s, d):
    p = R.prices(s, d).select("obs_id", "community", "day", "source", "price", "area")
    q = p.select("community", "day", *[F.col(c).alias(f"{c}2") for c in ("obs_id", "source", "price", "area")])
    j = p.join(q, ["community", "day"]).where("source < source2")
    close = lambda c, k: F.abs(F.col(c) - F.col(c + "2")) <= k * F.col(c + "2")
    kind = F.when(close("price", 0.1) & close("area", 0.05), "strict").when(close("price", 0.5), "loose").otherwise("different")
    return j.select(F.col("obs_id").alias("a"), F.col("obs_id2").alias("b"), kind.alias("class"))


R.SQL["names"] = "SELECT DISTINCT source, community FROM prices"


def names(s, d):
    return R.prices(s, d).select("source", "community").distinct()


@query("source_overlap", """WITH n AS (SELECT source, count(*) AS k FROM names GROUP BY 1), o AS (SELECT a.source AS a, b.source AS b, count(*) AS shared FROM names a JOIN names b ON a.community = b.community AND a.source < b.source GROUP BY 1, 2)
    SELECT a, b, shared, x.k - shared AS only_a, y.k - shared AS only_b, round(shared / (x.k + y.k - shared), 6) AS jaccard FROM o JOIN n x ON x.source = a JOIN n y ON y.source = b""", "prices names")
def _(s, d):
    n = names(s, d)
    k = n.groupBy("source").agg(F.count("*").alias("k"))
    o = n.select(F.col("source").alias("a"), "community").join(n.select(F.col("source").alias("b"), "community"), "community").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    o = o.join(k.select(F.col("source").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("source").alias("b"), F.col("k").alias("kb")), "b")
    return o.select("a", "b", "shared", (F.col("ka") - F.col("shared")).alias("only_a"), (F.col("kb") - F.col("shared")).alias("only_b"), F.round(F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared")), 6).alias("jaccard"))


HAV = "2 * 6371008.8::DOUBLE * asin(sqrt(least(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2), 1)))"


@query("coordinate_disagreement", f"""WITH c AS (SELECT community, source, avg(lon) AS lon, avg(lat) AS lat FROM prices GROUP BY 1, 2) SELECT a.community, round(max({HAV}), 2) AS metres FROM c a JOIN c b ON a.community = b.community AND a.source < b.source
    GROUP BY 1 HAVING max({HAV}) > 500""", "prices")
def _(s, d):
    c = R.prices(s, d).groupBy("community", "source").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    e = c.select("community", F.col("source").alias("s2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    j = c.join(e, "community").where("source < s2").withColumn("m", S.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")))
    return j.groupBy("community").agg(F.max("m").alias("m")).where("m > 500").select("community", F.round("m", 2).alias("metres"))


@query("source_score", """WITH n AS (SELECT city, source, count(*) AS k FROM prices GROUP BY 1, 2) SELECT city, source, k, round(least(k / 650, 1), 6) AS score, row_number() OVER (PARTITION BY city ORDER BY k DESC, source) = 1 AS best FROM n""", "prices")
def _(s, d):
    n = R.prices(s, d).groupBy("city", "source").agg(F.count("*").alias("k"))
    best = F.row_number().over(Window.partitionBy("city").orderBy(F.col("k").desc(), "source")) == 1
    return n.select("city", "source", "k", F.round(F.least(F.col("k") / 650, F.lit(1.0)), 6).alias("score"), best.alias("best"))


@query("source_merge_finest_date", """SELECT community, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, arg_min(day, (CASE stage WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, day)) AS day FROM prices GROUP BY 1""", "prices")
def _(s, d):
    rank = F.when(F.col("stage") == "F", 0).when(F.col("stage") == "O", 1).otherwise(2)
    return R.prices(s, d).groupBy("community").agg(F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"), F.min_by("day", F.struct(rank, "day")).alias("day"))


@query("priority_union", """SELECT s_suppkey AS k, 'left' AS side FROM supplier UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def _(s, d):
    a = R.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("left").alias("side"))
    return a.unionByName(R.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("right").alias("side")).join(a, "k", "left_anti"))


@query("station_resolution", """SELECT s_suppkey AS unit, CASE WHEN s_suppkey % 7 = 0 THEN 'excluded' WHEN s_suppkey % 7 = 1 THEN 'competing' WHEN s_suppkey % 7 = 2 THEN 'merged' ELSE 'kept' END AS branch,
    CASE WHEN s_suppkey % 7 = 2 THEN s_suppkey - 2 ELSE s_suppkey END AS resolved FROM supplier""")
def _(s, d):
    u = R.table(s, d, "supplier").select(F.col("s_suppkey").alias("unit"))
    k = F.col("unit") % 7
    decisions = u.where(k < 3).select("unit", F.when(k == 0, "excluded").when(k == 1, "competing").otherwise("merged").alias("decision"), F.when(k == 2, F.col("unit") - 2).alias("target"))
    got = S.join_validated(u, decisions, ["unit"])
    return got.select("unit", F.coalesce("decision", F.lit("kept")).alias("branch"), F.coalesce("target", "unit").alias("resolved"))


@query("pretreatment_lags", """WITH a AS (SELECT unit, year(period)::INT AS year, avg(y) AS v FROM panel GROUP BY 1, 2) SELECT u.unit, round(a1.v, 5) AS v_lag1, round(a2.v, 5) AS v_lag2, a1.v IS NOT NULL AND a2.v IS NOT NULL AS v_available
    FROM units u LEFT JOIN a a1 ON a1.unit = u.unit AND a1.year = year(opening) - 1 LEFT JOIN a a2 ON a2.unit = u.unit AND a2.year = year(opening) - 2""", "units panel")
def _(s, d):
    a = R.panel(s, d).groupBy("unit", F.year("period").alias("year")).agg(F.round(F.avg("y"), 5).alias("v"))
    return S.lags(R.units(s, d).withColumn("start", F.year("opening")), a, "unit", "start", "year", ["v"], [1, 2])


@query("asof_pre_assets", """SELECT unit, list(obs ORDER BY period DESC) AS assets FROM (SELECT unit, period, n AS obs, row_number() OVER (PARTITION BY unit ORDER BY period DESC) AS r FROM rel WHERE t < 0) WHERE r <= 4 GROUP BY unit""", "units panel rel")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("unit").orderBy(F.col("period").desc()))
    last = rel(s, d).where("t < 0").withColumn("r", r).where("r <= 4").groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("period", "n")), asc=False).alias("l"))
    return last.select("unit", F.transform("l", lambda x: x["n"]).alias("assets"))


@query("post_assets_coverage", """SELECT unit, k::INT AS event_year, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 11 THEN 'partial' ELSE 'full' END AS status FROM (SELECT unit, unnest(range(4)) AS k FROM units)
    LEFT JOIN (SELECT unit, t // 12 AS k, count(*) AS n FROM rel WHERE t BETWEEN 0 AND 47 GROUP BY 1, 2) USING (unit, k)""", "units panel rel")
def _(s, d):
    full = S.skeleton(R.units(s, d).select("unit"), s.range(4).select(F.col("id").cast("int").alias("event_year")))
    n = rel(s, d).where(F.col("t").between(0, 47)).groupBy("unit", F.floor(F.col("t") / 12).cast("int").alias("event_year")).agg(F.count("*").alias("n"))
    got = full.join(n, ["unit", "event_year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return got.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") < 11, "partial").otherwise("full"))


@query("masked_vector_attach", """SELECT unit, valid, CASE WHEN valid THEN round(e[1]::DOUBLE, 5) END AS a00, CASE WHEN valid THEN round(e[64]::DOUBLE, 5) END AS a63 FROM (SELECT unit, embedding AS e, label IS NOT NULL AND label < 7 AS valid FROM units LEFT JOIN embeddings ON vec_id = unit)""", "units")
def _(s, d):
    v = R.table(s, d, "embeddings").select(F.col("vec_id").alias("unit"), "embedding", "label")
    valid = F.col("label").isNotNull() & (F.col("label") < 7)
    got = R.units(s, d).select("unit").join(v, "unit", "left").withColumn("valid", valid)
    band = lambda k: F.when(F.col("valid"), F.round(F.col("embedding")[k].cast("double"), 5))
    return got.select("unit", "valid", band(0).alias("a00"), band(63).alias("a63"))


@query("edges_at_cutoff", """SELECT unit, cut FROM units, (SELECT unnest([DATE '1998-12-01', DATE '1999-06-01']) AS cut) WHERE opening <= cut AND cut < opening + INTERVAL 10 MONTH""", "units")
def _(s, d):
    cuts = s.createDataFrame([("1998-12-01",), ("1999-06-01",)], "c string").select(F.col("c").cast("date").alias("cut"))
    return S.skeleton(R.units(s, d).select("unit", "opening"), cuts).where("opening <= cut and cut < add_months(opening, 10)").select("unit", "cut")


def edges(s, d):
    w = Window.partitionBy("city").orderBy("unit")
    u = R.metric(R.units(s, d))
    e = u.select(F.col("unit").alias("src"), "x", "y", F.lead("unit").over(w).alias("dst"), F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny")).where("dst is not null")
    e = e.select("src", "dst", (F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")) / 1000).alias("km"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "km"))


@query("graph_closeness")
def _(s, d):
    from .estimators import ready

    ready(s)
    return S.shortest_paths(edges(s, d), 60.0).groupBy("src").agg(F.round(1 / F.sum("km"), 8).alias("closeness"), F.count("*").alias("reachable"))


@query("station_degree", """WITH e AS (SELECT unit AS a, lead(unit) OVER (PARTITION BY city ORDER BY unit) AS b FROM units), s AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION ALL SELECT b, a FROM e WHERE b IS NOT NULL)
    SELECT a AS unit, count(DISTINCT b) AS degree, count(DISTINCT b) = 1 AS terminal FROM s GROUP BY 1""", "units")
def _(s, d):
    return edges(s, d).groupBy(F.col("src").alias("unit")).agg(F.count_distinct("dst").alias("degree"), (F.count_distinct("dst") == 1).alias("terminal"))


@query("line_first_batch", """WITH c AS (SELECT city, opening, count(*) AS n FROM units GROUP BY 1, 2) SELECT city, coalesce(min(CASE WHEN n >= 2 THEN opening END), min(opening)) AS opening FROM c GROUP BY 1""", "units")
def _(s, d):
    c = R.units(s, d).groupBy("city", "opening").agg(F.count("*").alias("n"))
    return c.groupBy("city").agg(F.coalesce(F.min(F.when(F.col("n") >= 2, F.col("opening"))), F.min("opening")).alias("opening"))


@query("treatment_matrix", """WITH b AS (SELECT p.point_id, u.opening FROM mpoints p JOIN munits u ON power(p.x - u.x, 2) + power(p.y - u.y, 2) <= 1000000), y AS (SELECT unnest(range(1998, 2001)) AS year)
    SELECT point_id, year, count(*) FILTER (WHERE year(opening) <= year) AS n, min(year(opening))::BIGINT AS first_year FROM b, y GROUP BY 1, 2""", "points mpoints units munits")
def _(s, d):
    b = S.within(mpoints(s, d).select("point_id", "x", "y"), stations(s, d).select("opening", "rx", "ry"), 1000.0)
    years = s.range(1998, 2001).select(F.col("id").alias("year"))
    return S.skeleton(b, years).groupBy("point_id", "year").agg(F.count_if(F.year("opening") <= F.col("year")).alias("n"), F.min(F.year("opening")).cast("long").alias("first_year"))


@query("join_validated", "SELECT unit, treated, coalesce(k, 0) AS k FROM units LEFT JOIN (SELECT unit, count(*) AS k FROM panel GROUP BY 1) USING (unit)", "units panel")
def _(s, d):
    k = R.panel(s, d).groupBy("unit").agg(F.count("*").alias("k"))
    return S.join_validated(R.units(s, d).select("unit", "treated"), k, ["unit"]).withColumn("k", F.coalesce("k", F.lit(0)))


@query("multi_outer_merge", """SELECT unit, year, a, b FROM (SELECT unit, year(period)::INT AS year, count(*) AS a FROM panel WHERE y > 10 GROUP BY 1, 2) FULL JOIN (SELECT unit, year(period)::INT AS year, sum(n)::BIGINT AS b FROM panel WHERE n > 1 GROUP BY 1, 2) USING (unit, year)""", "panel")
def _(s, d):
    p = R.panel(s, d).withColumn("year", F.year("period"))
    a = p.where("y > 10").groupBy("unit", "year").agg(F.count("*").alias("a"))
    return a.join(p.where("n > 1").groupBy("unit", "year").agg(F.sum("n").alias("b")), ["unit", "year"], "full")


HORIZONS = [("y", h) for h in (1, 3, 6, 12, 18, 24)] + [("n", h) for h in (1, 2, 3)]
HVALUES = "(VALUES " + ", ".join(f"('{o}', {h}::INT)" for o, h in HORIZONS) + ") h(outcome, event_time)"


@query("label_skeleton", f"SELECT unit, outcome, event_time FROM units, {HVALUES} WHERE treated", "units")
def _(s, d):
    return S.skeleton(R.units(s, d).where("treated").select("unit"), s.createDataFrame(HORIZONS, "outcome string, event_time int"))


@query("task_skeleton", "SELECT unit, f AS family, 'pending' AS state FROM units, (VALUES ('housing'), ('poi')) v(f) WHERE treated", "units")
def _(s, d):
    return S.skeleton(R.units(s, d).where("treated").select("unit"), s.createDataFrame([("housing",), ("poi",)], "family string")).withColumn("state", F.lit("pending"))


@query("treated_anti_universe", """SELECT city, count(*) AS cells, count(*) FILTER (WHERE treated) AS n_treated, count(*) FILTER (WHERE NOT treated) AS donors FROM units GROUP BY 1""", "units")
def _(s, d):
    u = R.units(s, d)
    t = u.where("treated").select("unit", F.lit(True).alias("hit"))
    m = u.select("unit", "city").join(t, "unit", "left").withColumn("hit", F.col("hit").isNotNull())
    return m.groupBy("city").agg(F.count("*").alias("cells"), F.count_if("hit").alias("n_treated"), F.count_if(~F.col("hit")).alias("donors"))


@query("donor_admission", "SELECT concat(city, '::', unit) AS unit_id, city FROM units WHERE NOT treated AND lon < 116.35", "units")
def _(s, d):
    u = R.units(s, d).where("not treated and lon < 116.35").select(F.concat_ws("::", "city", "unit").alias("unit_id"), "city")
    return S.join_validated(u.select("unit_id"), u, ["unit_id"])


@query("set_equality_check", """SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right, count(*) FILTER (WHERE b.k IS NULL) = 0 AND count(*) FILTER (WHERE a.k IS NULL) = 0 AS equal
    FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer) b USING (k)""")
def _(s, d):
    return S.set_difference(R.table(s, d, "orders").select(F.col("o_custkey").alias("k")), R.table(s, d, "customer").select(F.col("c_custkey").alias("k")))


@query("identity_binding", """SELECT count(*) AS rows_bound, count(*) FILTER (WHERE p.city <> u.city) AS city_mismatch, count(*) FILTER (WHERE p.month <> u.opening) AS month_mismatch FROM units u JOIN (SELECT unit, city, min(period) AS month FROM panel GROUP BY 1, 2) p USING (unit)""", "units panel")
def _(s, d):
    p = R.panel(s, d).groupBy("unit", F.col("city").alias("city2")).agg(F.min("period").alias("month"))
    return R.units(s, d).join(p, "unit").agg(F.count("*").alias("rows_bound"), F.count_if(F.col("city") != F.col("city2")).alias("city_mismatch"), F.count_if(F.col("month") != F.col("opening")).alias("month_mismatch"))


@query("source_union", "SELECT o_orderkey AS id, o_totalprice AS price, NULL::BIGINT AS part FROM orders UNION ALL SELECT l_orderkey, l_extendedprice, l_partkey FROM lineitem")
def _(s, d):
    o = R.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return o.unionByName(R.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part")), allowMissingColumns=True)
