"""Queries of the panel, window and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import panels as P
from ..operators import spatial as S
from . import roles as R
from .base import book, ready
from .cleaning import poi

QUERIES, ORACLE, query = book()
CATS = ["retail", "food", "life_service", "office", "other"]
CELL = "CAST(floor(x / 500) AS INT) AS col, CAST(floor(y / 500) AS INT) AS row"
R.SQL["mpoi"] = "SELECT *, (lon - 116::DOUBLE) * 85000::DOUBLE AS x, (lat - 39.7::DOUBLE) * 111000::DOUBLE AS y FROM poi"
COUNTS = ("count(*) AS poi_count, sum(is_commercial)::BIGINT AS n_commercial, sum(is_chain)::BIGINT AS n_chain, "
          "sum(is_community_commerce)::BIGINT AS n_community, " + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS n_{c}" for c in CATS))  # fmt: skip
R.SQL["poi_cells"] = f"SELECT city, {CELL.replace('500', '4000')}, year, {COUNTS} FROM mpoi GROUP BY ALL"
R.SQL["cell_month"] = """SELECT city, CAST(floor(x / 4000) AS INT) AS col, CAST(floor(y / 4000) AS INT) AS row,
    CAST(date_trunc('month', day) AS DATE) AS month, source, stage, price, obs_id FROM mprices"""


def cells(df, size=4000.0):
    return P.lattice_cell(R.metric(df), size=size)


def cell_month(s, d):
    return cells(R.prices(s, d)).select("city", "col", "row", F.trunc("day", "MM").alias("month"), "source", "stage", "price", "obs_id")


def poi_cells(s, d):
    return P.poi_counts(cells(poi(s, d)), ["city", "col", "row", "year"], CATS)


query("poi_grid_counts", "SELECT * FROM poi_cells", "points poi mpoi poi_cells")(poi_cells)


@query("poi_year_finalize", """SELECT city, year, sum(poi_count)::BIGINT AS poi_count, round(sum(n_commercial) / sum(poi_count), 6) AS commercial_share,
    round(sum(n_chain) / sum(poi_count), 6) AS chain_share, round(sum(n_community) / sum(poi_count), 6) AS community_share FROM poi_cells GROUP BY city, year""",
    "points poi mpoi poi_cells")
def _(s, d):
    out = P.poi_finalize(poi_cells(s, d), ["city", "year"], CATS)
    return out.select("city", "year", "poi_count", *[F.round(f"{n}_share", 6).alias(f"{n}_share") for n in ("commercial", "chain", "community")])


@query("shannon_entropy", """SELECT city, col, row, round(-sum(CASE WHEN n > 0 THEN n / t * ln(n / t) ELSE 0 END), 6) + 0.0 AS entropy FROM (
    SELECT city, col, row, category, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY city, col, row)::DOUBLE AS t FROM
    (SELECT *, CAST(floor(x / 4000) AS INT) AS col, CAST(floor(y / 4000) AS INT) AS row FROM mpoi) GROUP BY city, col, row, category) GROUP BY 1, 2, 3""", "points poi mpoi")
def _(s, d):
    got = P.poi_finalize(P.poi_counts(cells(poi(s, d)), ["city", "col", "row"], CATS), ["city", "col", "row"], CATS)
    return got.select("city", "col", "row", (F.round("entropy", 6) + 0.0).alias("entropy"))


@query("canonical_samples", """SELECT c_nationkey, c_mktsegment, min(CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 3 END) AS v, count(DISTINCT CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 3 END)
    + max((c_custkey % 7 = 0)::INT) > 1 AS conflict, count(*) AS n_rows FROM customer GROUP BY 1, 2""")
def _(s, d):
    c = R.table(s, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey") % 3))
    return P.canonical_samples(c, ["c_nationkey", "c_mktsegment"], "v")


@query("grid_month_mean", f"""SELECT city, {CELL}, CAST(date_trunc('month', day) AS DATE) AS month, round(avg(value), 5) AS mean, count(*) AS support
    FROM (SELECT DISTINCT ON (city, lon, lat, day) * FROM mpoints ORDER BY city, lon, lat, day, value) GROUP BY ALL""", "points mpoints")
def _(s, d):
    unique = R.points(s, d).groupBy("city", "lon", "lat", "day").agg(F.min("value").alias("value"))
    return P.lattice_cell(R.metric(unique)).groupBy("city", "col", "row", F.trunc("day", "MM").alias("month")).agg(
        F.round(F.avg("value"), 5).alias("mean"), F.count("*").alias("support")
    )


@query("grid_month_nearest_mean", """WITH near AS (SELECT p.city, CAST(date_trunc('month', p.day) AS DATE) AS month, p.value, min(sqrt(power(p.x - u.x, 2) + power(p.y - u.y, 2))) AS metres, arg_min(u.unit, (sqrt(power(p.x - u.x, 2) + power(p.y - u.y, 2)), u.unit)) AS unit
    FROM mpoints p JOIN munits u ON u.city = p.city AND power(p.x - u.x, 2) + power(p.y - u.y, 2) <= 9000000 GROUP BY p.point_id, p.city, p.day, p.value), universe AS (SELECT city, unit, month FROM units JOIN (SELECT DISTINCT city, CAST(date_trunc('month', day) AS DATE) AS month FROM points) USING (city))
    SELECT city, unit, month, round(avg(value), 5) AS mean, count(metres) AS support, round(avg(metres), 3) AS metres_mean, round(max(metres), 3) AS metres_max FROM universe LEFT JOIN near USING (city, unit, month) GROUP BY ALL""", "points mpoints units munits")
def _(s, d):
    """Every point goes to the nearest cell centre of its city within 3 km; all cells stay for every month of their city."""
    ready(s)
    p = R.metric(R.points(s, d)).select("point_id", "city", "x", "y", "value", "day", F.trunc("day", "MM").alias("month"))
    u = R.metric(R.units(s, d)).select("unit", "city", F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = S.nearest_within(p.distinct(), u, 3000.0, "unit", ["city"])
    g = near.groupBy("city", "unit", "month").agg(
        F.avg("value").alias("mean"), F.count("*").alias("support"), F.avg("distance").alias("metres_mean"), F.max("distance").alias("metres_max")
    )
    universe = u.select("city", "unit").join(p.select("city", "month").distinct(), "city")
    out = universe.join(g, ["city", "unit", "month"], "left")
    return out.select("city", "unit", "month", F.round("mean", 5).alias("mean"), F.coalesce("support", F.lit(0)).alias("support"), *[F.round(c, 3).alias(c) for c in ("metres_mean", "metres_max")])


@query("partition_audit", """SELECT city, year(period)::INT AS year, month(period)::INT AS month, count(*) AS n_rows, count(*) FILTER (WHERE n > 1) AS n_multi,
    round(count(*) FILTER (WHERE n > 1) / count(*), 6) AS multi_share FROM panel GROUP BY 1, 2, 3""", "panel")
def _(s, d):
    multi = F.count_if(F.col("n") > 1)
    return R.panel(s, d).groupBy("city", F.year("period").alias("year"), F.month("period").alias("month")).agg(
        F.count("*").alias("n_rows"), multi.alias("n_multi"), F.round(multi / F.count("*"), 6).alias("multi_share")
    )


@query("annual_from_monthly", """SELECT unit, year(period)::INT AS year, round(avg(y), 5) AS mean, round(median(y), 5) AS median, round(min(y), 5) AS low,
    round(max(y), 5) AS high, round(stddev_samp(y), 5) AS sd, count(*) AS months, sum(n)::BIGINT AS support FROM panel GROUP BY 1, 2""", "panel")
def _(s, d):
    r = lambda c, n: F.round(c, 5).alias(n)
    return R.panel(s, d).groupBy("unit", F.year("period").alias("year")).agg(
        r(F.avg("y"), "mean"), r(F.median("y"), "median"), r(F.min("y"), "low"), r(F.max("y"), "high"), r(F.stddev_samp("y"), "sd"),
        F.count("*").alias("months"), F.sum("n").alias("support"),
    )


@query("population_union", """SELECT unit, year, round(sum(v), 4) AS population, count(*) > 1 AS repeated FROM (SELECT unit, year(period)::INT AS year, n * 25.0::DOUBLE AS v
    FROM panel WHERE year(period) < 1998 UNION ALL SELECT unit, year(period)::INT, n * 1.0::DOUBLE FROM panel WHERE year(period) >= 1998) GROUP BY 1, 2""", "panel")
def _(s, d):
    p = R.panel(s, d).withColumn("year", F.year("period"))
    old = p.where("year < 1998").select("unit", "year", (F.col("n") * 25.0).alias("v"))
    both = old.unionByName(p.where("year >= 1998").select("unit", "year", (F.col("n") * 1.0).alias("v")))
    return both.groupBy("unit", "year").agg(F.round(F.sum("v"), 4).alias("population"), (F.count("*") > 1).alias("repeated"))


@query("zonal_sum", f"SELECT {CELL}, round(sum(value), 4) AS total, count(*) AS n FROM mpoints WHERE value > 0 GROUP BY 1, 2", "points mpoints")
def _(s, d):
    return P.lattice_cell(R.metric(R.points(s, d).where("value > 0"))).groupBy("col", "row").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


R.SQL["balanced"] = """SELECT city, month, median(m) AS log_balanced, coalesce(stddev_samp(m), 0) AS dispersion, count(*) AS n_sources, sum(n)::BIGINT AS n_observations
    FROM (SELECT city, month, source, median(ln(price)) AS m, count(*) AS n FROM cell_month GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("source_balanced_panel", """SELECT city, month, round(log_balanced, 5) AS log_balanced, round(dispersion, 5) AS dispersion, n_sources, n_observations,
    round(log_raw, 5) AS log_raw FROM balanced JOIN (SELECT city, month, median(ln(price)) AS log_raw FROM cell_month GROUP BY 1, 2) USING (city, month)""",
    "prices mprices cell_month balanced")
def _(s, d):
    got = P.source_balanced(cell_month(s, d), ["city", "month"], "source", "price")
    return got.select("city", "month", "n_sources", "n_observations", *[F.round(c, 5).alias(c) for c in ("log_balanced", "dispersion", "log_raw")])


R.SQL["signatures"] = """SELECT city, month, string_agg(source, ';' ORDER BY source) AS signature, arg_min(source, (-n, source)) AS dominant FROM
    (SELECT city, month, source, count(*) AS n FROM cell_month GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("source_signature", "SELECT * FROM signatures", "prices mprices cell_month signatures")
def _(s, d):
    return P.source_signature(cell_month(s, d), ["city", "month"], "source")


@query("source_mix_change", """SELECT city, month, coalesce(dominant <> lag(dominant) OVER (PARTITION BY city ORDER BY month), false) AS changed FROM signatures""",
    "prices mprices cell_month signatures")
def _(s, d):
    sig = P.source_signature(cell_month(s, d), ["city", "month"], "source")
    before = F.lag("dominant").over(Window.partitionBy("city").orderBy("month"))
    return sig.select("city", "month", F.coalesce(F.col("dominant") != before, F.lit(False)).alias("changed"))


@query("panel_city_report", """SELECT city, count(*) AS n_rows, count(DISTINCT source) AS n_sources, count(*) FILTER (WHERE stage = 'F') AS n_final,
    count(*) FILTER (WHERE price > 1000) AS n_high FROM prices GROUP BY city""", "prices")
def _(s, d):
    return R.prices(s, d).groupBy("city").agg(
        F.count("*").alias("n_rows"), F.count_distinct("source").alias("n_sources"), F.count_if(F.col("stage") == "F").alias("n_final"),
        F.count_if(F.col("price") > 1000).alias("n_high"),
    )


@query("housing_annual", """SELECT city, year(month)::INT AS year, round(median(lp), 5) AS log_price, count(DISTINCT month) AS months, sum(n)::BIGINT AS n FROM
    (SELECT city, col, row, month, median(ln(price)) AS lp, count(*) AS n FROM cell_month GROUP BY ALL) GROUP BY 1, 2""", "prices mprices cell_month")
def _(s, d):
    m = cell_month(s, d).groupBy("city", "col", "row", "month").agg(F.median(F.log("price")).alias("lp"), F.count("*").alias("n"))
    return m.groupBy("city", F.year("month").alias("year")).agg(F.round(F.median("lp"), 5).alias("log_price"), F.count_distinct("month").alias("months"), F.sum("n").alias("n"))


@query("monthly_price_read", """SELECT city, col, row, month, round(median(price), 3) AS price, count(*) AS transactions FROM cell_month
    WHERE month BETWEEN DATE '1997-01-01' AND DATE '1997-12-01' GROUP BY ALL""", "prices mprices cell_month")
def _(s, d):
    m = cell_month(s, d).where(F.col("month").between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-01").cast("date")))
    return m.groupBy("city", "col", "row", "month").agg(F.round(F.median("price"), 3).alias("price"), F.count("*").alias("transactions"))


@query("weighted_grid_price", """SELECT city, year, round(sum(p * n) / sum(n), 4) AS price FROM (SELECT city, community, year(day)::INT AS year, avg(price) AS p, count(*) AS n
    FROM prices GROUP BY 1, 2, 3) GROUP BY 1, 2""", "prices")
def _(s, d):
    m = R.prices(s, d).groupBy("city", "community", F.year("day").alias("year")).agg(F.avg("price").alias("p"), F.count("*").alias("n"))
    return m.groupBy("city", "year").agg(F.round(P.weighted_mean(F.col("p"), F.col("n")), 4).alias("price"))


@query("snapshot_grid_price", """SELECT city, col, row, round(avg(price), 4) AS mean, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.75), 4) AS p75,
    count(*) AS n, array_to_string(list_sort(list_distinct(list(obs_id::VARCHAR)))[1:5], ';') AS names FROM cell_month GROUP BY 1, 2, 3""", "prices mprices cell_month")
def _(s, d):
    return cell_month(s, d).groupBy("city", "col", "row").agg(
        F.round(F.avg("price"), 4).alias("mean"), F.round(F.percentile("price", 0.25), 4).alias("p25"), F.round(F.percentile("price", 0.75), 4).alias("p75"),
        F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(F.col("obs_id").cast("string"))), 1, 5), ";").alias("names"),
    )


@query("community_centroids", """SELECT community, round(median(lon), 6) AS lon, round(median(lat), 6) AS lat, count(DISTINCT obs_id) AS n, year(min(day))::INT AS first_year,
    year(max(day))::INT AS last_year FROM prices GROUP BY 1""", "prices")
def _(s, d):
    return R.prices(s, d).groupBy("community").agg(
        F.round(F.median("lon"), 6).alias("lon"), F.round(F.median("lat"), 6).alias("lat"), F.count_distinct("obs_id").alias("n"),
        F.year(F.min("day")).alias("first_year"), F.year(F.max("day")).alias("last_year"),
    )


@query("community_month_panel", """SELECT strftime(day, '%Y-%m') AS month, count(DISTINCT community) AS communities, count(*) AS n FROM prices
    WHERE price BETWEEN 100 AND 10000 GROUP BY 1""", "prices")
def _(s, d):
    p = R.prices(s, d).where(F.col("price").between(100, 10000))
    return p.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count_distinct("community").alias("communities"), F.count("*").alias("n"))


@query("index_yearly", """SELECT unit, year(period)::INT AS year, round(avg(y), 5) AS mean, round(coalesce(max(CASE WHEN month(period) = 12 THEN y END), arg_max(y, period)), 5) AS last
    FROM panel GROUP BY 1, 2""", "panel")
def _(s, d):
    last = F.coalesce(F.max(F.when(F.month("period") == 12, F.col("y"))), F.max_by("y", "period"))
    return R.panel(s, d).groupBy("unit", F.year("period").alias("year")).agg(F.round(F.avg("y"), 5).alias("mean"), F.round(last, 5).alias("last"))


@query("index_chained", """WITH a AS (SELECT unit, year(period)::INT AS year, avg(y) / 10 AS m FROM panel GROUP BY 1, 2), b AS (SELECT unit, year, CASE WHEN (unit + year) % 11 > 0 THEN m END AS m FROM a)
    SELECT unit, year, round(CASE WHEN year >= 1998 THEN 100 * exp(coalesce((SELECT sum(coalesce(ln(c.m), 0)) FROM b c WHERE c.unit = b.unit AND c.year > 1998 AND c.year <= b.year), 0))
    WHEN (SELECT count(*) FROM b c WHERE c.unit = b.unit AND c.year > b.year AND c.year <= 1998 AND c.m IS NULL) = 0
    THEN 100 * exp(-coalesce((SELECT sum(ln(c.m)) FROM b c WHERE c.unit = b.unit AND c.year > b.year AND c.year <= 1998), 0)) END, 4) AS index FROM b""", "panel")
def _(s, d):
    a = R.panel(s, d).groupBy("unit", F.year("period").alias("year")).agg((F.avg("y") / 10).alias("m"))
    a = a.withColumn("m", F.when((F.col("unit") + F.col("year")) % 11 > 0, F.col("m")))
    return P.chained_index(a, ["unit"], "year", "m", 1998).select("unit", "year", F.round("index", 4).alias("index"))


@query("treatment_latest", """SELECT unit, arg_max(round(y, 6), period) AS y, max(period) AS period FROM panel GROUP BY unit""", "panel")
def _(s, d):
    last = F.max_by(F.struct(F.round("y", 6).alias("y"), "period"), "period").alias("r")
    return R.units(s, d).select("unit").join(R.panel(s, d).groupBy("unit").agg(last), "unit").select("unit", "r.*")


@query("density_window_mean", """WITH m AS (SELECT unit, city, avg(y) AS v FROM panel WHERE year(period) BETWEEN 1996 AND 1998 GROUP BY 1, 2)
    SELECT unit, round((v - avg(v) OVER (PARTITION BY city)) / stddev_pop(v) OVER (PARTITION BY city), 4) AS z FROM m""", "panel")
def _(s, d):
    m = R.panel(s, d).where(F.year("period").between(1996, 1998)).groupBy("unit", "city").agg(F.avg("y").alias("v"))
    w = Window.partitionBy("city")
    return m.select("unit", F.round(F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w)), 4).alias("z"))


@query("city_year_summary", """SELECT city, year(period)::INT AS year, round(ln(1 + sum(n)), 6) AS log_total, round(count(DISTINCT unit) / any_value(k), 6) AS coverage FROM panel
    JOIN (SELECT city, count(*) AS k FROM units GROUP BY 1) USING (city) GROUP BY 1, 2""", "units panel")
def _(s, d):
    cells_of = R.units(s, d).groupBy("city").agg(F.count("*").alias("k"))
    y = R.panel(s, d).groupBy("city", F.year("period").alias("year")).agg(F.log1p(F.sum("n")).alias("t"), F.count_distinct("unit").alias("u"))
    return y.join(cells_of, "city").select("city", "year", F.round("t", 6).alias("log_total"), F.round(F.col("u") / F.col("k"), 6).alias("coverage"))


@query("aggregate_safe_dup_keys", """SELECT count(*) FILTER (WHERE k > 1) AS repeated_keys, sum(k)::BIGINT AS n_rows, sum(bad)::BIGINT AS bad_values FROM (SELECT community, day, count(*) AS k,
    count(*) FILTER (WHERE price < 100) AS bad FROM prices GROUP BY 1, 2)""", "prices")
def _(s, d):
    g = R.prices(s, d).groupBy("community", "day").agg(F.count("*").alias("k"), F.count_if(F.col("price") < 100).alias("bad"))
    return g.agg(F.count_if(F.col("k") > 1).alias("repeated_keys"), F.sum("k").alias("n_rows"), F.sum("bad").alias("bad_values"))


@query("panel_change_metrics", """SELECT unit, year, n, lag, greatest(coalesce(n - lag, 0), 0)::BIGINT AS net_new, greatest(coalesce(lag - n, 0), 0)::BIGINT AS net_exit,
    round(CASE WHEN lag > 0 THEN (n - lag) / lag END, 6) AS growth FROM (SELECT unit, year, n, lag(n) OVER (PARTITION BY unit ORDER BY year) AS lag FROM
    (SELECT unit, year(period)::INT AS year, sum(n)::BIGINT AS n FROM panel GROUP BY 1, 2))""", "panel")
def _(s, d):
    y = R.panel(s, d).groupBy("unit", F.year("period").alias("year")).agg(F.sum("n").alias("n"))
    return P.change_metrics(y, ["unit"], "year", "n").withColumn("growth", F.round("growth", 6))


R.SQL["rel"] = """SELECT unit, city, period, y, n, treated, (year(period) - year(opening)) * 12 + month(period) - month(opening) AS t FROM panel JOIN
    (SELECT unit, treated, opening FROM units) USING (unit)"""


def rel(s, d):
    p = R.panel(s, d).join(R.units(s, d).select("unit", "treated", "opening"), "unit")
    t = (F.year("period") - F.year("opening")) * 12 + F.month("period") - F.month("opening")
    return p.withColumn("t", t.cast("long"))


@query("treatment_order", """SELECT unit, row_number() OVER (ORDER BY city, opening, lon, unit) AS treatment_order FROM units WHERE treated""", "units")
def _(s, d):
    t = R.units(s, d).where("treated").select("unit", "city", "opening", "lon")
    inner = F.row_number().over(Window.partitionBy("city").orderBy("opening", "lon", "unit"))
    sizes = t.groupBy("city").agg(F.count("*").alias("k"))
    before = sizes.select("city", F.coalesce(F.sum("k").over(Window.orderBy("city").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return t.withColumn("r", inner).join(before, "city").select("unit", (F.col("r") + F.col("before")).alias("treatment_order"))


@query("trailing_window_mean", """SELECT unit, t, round(CASE WHEN t <= 0 THEN y WHEN (SELECT count(*) FROM rel b WHERE b.unit = a.unit AND b.t BETWEEN a.t - 2 AND a.t AND b.t > 0) = least(3, t)
    THEN (SELECT avg(y) FROM rel b WHERE b.unit = a.unit AND b.t BETWEEN a.t - 2 AND a.t AND b.t > 0) END, 5) AS y_window FROM rel a WHERE t BETWEEN -3 AND 12""", "units panel rel")
def _(s, d):
    r = rel(s, d).where(F.col("t").between(-3, 12)).select("unit", "t", "y")
    return P.trailing_mean(r, ["unit"], "t", "y", 3).select("unit", "t", F.round("y_window", 5).alias("y_window"))


@query("latest_clean_leads", """SELECT unit, t FROM (SELECT unit, t, dense_rank() OVER (PARTITION BY unit ORDER BY t DESC) AS r FROM rel WHERE t < 0) WHERE r <= 5""", "units panel rel")
def _(s, d):
    return P.latest_leads(rel(s, d).select("unit", "t"), ["unit"], "t", 5)


@query("percentile_with_fallback", """WITH p AS (SELECT obs_id, price, city, stage, community, count(*) OVER (PARTITION BY city, stage, community) AS n1, count(*) OVER (PARTITION BY city, stage) AS n2,
    (rank() OVER (PARTITION BY city, stage, community ORDER BY price) + (count(*) OVER (PARTITION BY city, stage, community, price) - 1) / 2) / count(*) OVER (PARTITION BY city, stage, community) AS p1,
    (rank() OVER (PARTITION BY city, stage ORDER BY price) + (count(*) OVER (PARTITION BY city, stage, price) - 1) / 2) / count(*) OVER (PARTITION BY city, stage) AS p2 FROM prices)
    SELECT obs_id, round(CASE WHEN n1 >= 150 THEN p1 WHEN n2 >= 150 THEN p2 ELSE 0.5 END, 6) AS percentile FROM p""", "prices")
def _(s, d):
    got = P.percentile_with_fallback(R.prices(s, d), "price", [["city", "stage", "community"], ["city", "stage"]], 150)
    return got.select("obs_id", F.round("percentile", 6).alias("percentile"))


@query("duplicate_marking", """SELECT obs_id, row_number() OVER (PARTITION BY community, day ORDER BY price, obs_id) > 1 AS is_repeat, count(*) OVER (PARTITION BY community, day) > 1 AS in_group FROM prices""", "prices")
def _(s, d):
    return P.mark_duplicates(R.prices(s, d), [F.col("community"), F.col("day")], ["price", "obs_id"]).select("obs_id", "is_repeat", "in_group")


@query("winsorize_by_group", """WITH q AS (SELECT city, quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.99) AS b FROM prices GROUP BY 1),
    c AS (SELECT obs_id, city, least(greatest(price, a), b) AS v FROM prices JOIN q USING (city)) SELECT obs_id, round(v / avg(v) OVER (PARTITION BY city), 5) AS weight FROM c""", "prices")
def _(s, d):
    return P.winsorize(R.prices(s, d), "price", ["city"]).select("obs_id", F.round("weight", 5).alias("weight"))


@query("group_event_counts", "SELECT unit, count(*) OVER (PARTITION BY city, opening) AS n FROM units", "units")
def _(s, d):
    return R.units(s, d).select("unit", F.count("*").over(Window.partitionBy("city", "opening")).alias("n"))


@query("union_all_schema", """SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def _(s, d):
    a = R.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(R.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("intersect_names", "SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem")
def _(s, d):
    return R.table(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(R.table(s, d, "lineitem").select("l_suppkey"))


@query("except_names", "SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem)")
def _(s, d):
    return R.table(s, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(R.table(s, d, "lineitem").select("l_suppkey").distinct())


@query("drop_duplicates_first", "SELECT DISTINCT ON (community) community, obs_id, day FROM prices ORDER BY community, day, obs_id", "prices")
def _(s, d):
    return P.first_rows(R.prices(s, d), ["community"], [F.col("day"), F.col("obs_id")]).select("community", "obs_id", "day")
