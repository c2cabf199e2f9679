"""Queries of samples, splits and data-quality audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import sampling as A
from ..operators import spatial as S
from . import roles as R
from .base import book
from .estimators import annual, paths
from .panels import rel

QUERIES, ORACLE, query = book()


def H(key: str, seed: int) -> str:
    return f"sha256({key}::VARCHAR || '::seed={seed}')"


@query("donor_cap_by_support", """SELECT city, unit, k FROM (SELECT city, unit, count(*) AS k, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, unit) AS r FROM rel WHERE t < 0 AND NOT treated GROUP BY 1, 2) WHERE r <= 10""", "units panel rel")
def _(s, d):
    k = rel(s, d).where("t < 0 and not treated").groupBy("city", "unit").agg(F.count("*").alias("k"))
    r = F.row_number().over(Window.partitionBy("city").orderBy(F.col("k").desc(), "unit"))
    return k.withColumn("r", r).where("r <= 10").drop("r")


@query("hash_sample", f"SELECT unit FROM units ORDER BY {H('unit', 7)}, unit LIMIT 25", "units")
def _(s, d):
    return A.hash_sample(R.units(s, d).select("unit"), "unit", 25, 7)


@query("hash_city_split", f"""SELECT nation, CASE WHEN r / n <= 0.7 THEN 'train' WHEN r / n <= 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT n_name AS nation, row_number() OVER (ORDER BY {H('n_name', 1)}, n_name) AS r, count(*) OVER () AS n FROM nation)""")
def _(s, d):
    return A.hash_split(R.table(s, d, "nation").select(F.col("n_name").alias("nation")), "nation", 1, (0.7, 0.15))


@query("balanced_folds")
def _(s, d):
    sizes = R.table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return s.createDataFrame(A.balanced_folds(sizes, "c_nationkey", "n", 5), "c_nationkey int, fold int")


QUOTA = """q0 AS (SELECT community, count(*) AS n, count(*) * 400.0::DOUBLE / sum(count(*)) OVER () AS e FROM prices GROUP BY 1), q1 AS (SELECT *, greatest(floor(e), 1) AS f FROM q0),
    q AS (SELECT community, n, (f + (row_number() OVER (ORDER BY e - floor(e) DESC, community) <= greatest(400 - sum(f) OVER (), 0))::INT)::BIGINT AS quota FROM q1)"""


def community_quota(s, d):
    return A.quotas(R.prices(s, d).groupBy("community").agg(F.count("*").alias("n")), "community", "n", 400)


query("stratified_quota", f"WITH {QUOTA} SELECT * FROM q", "prices")(community_quota)


@query("stratified_sample", f"""WITH {QUOTA} SELECT community, obs_id FROM (SELECT p.community, obs_id, quota, row_number() OVER (PARTITION BY p.community ORDER BY area DESC, {H('obs_id', 3)}, obs_id) AS r FROM prices p JOIN q USING (community)) WHERE r <= quota""", "prices")
def _(s, d):
    return A.stratified(R.prices(s, d), "community", "obs_id", community_quota(s, d), 3, [F.col("area").desc()]).select("community", "obs_id")


@query("even_index_sample", """WITH a AS (SELECT city, unit, row_number() OVER (PARTITION BY city ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY city) AS n FROM units)
    SELECT city, unit FROM a WHERE i IN (SELECT round_even(k * (a.n - 1) / (least(5, a.n) - 1)::DOUBLE, 0)::BIGINT FROM range(5) r(k))""", "units")
def _(s, d):
    return A.spread(R.units(s, d).select("city", "unit"), "city", "unit", 5)


@query("candidate_frame", """SELECT unit, city, coalesce(k, 0) AS pre, coalesce(k, 0) >= 36 AS ready, CASE WHEN lon < 116.2 THEN 'west' ELSE 'east' END AS stratum FROM units LEFT JOIN (SELECT unit, count(*) AS k FROM rel WHERE t < 0 GROUP BY 1) USING (unit) WHERE treated""", "units panel rel")
def _(s, d):
    k = rel(s, d).where("t < 0").groupBy("unit").agg(F.count("*").alias("k"))
    got = S.join_validated(R.units(s, d).where("treated").select("unit", "city", "lon"), k, ["unit"])
    pre = F.coalesce("k", F.lit(0))
    return got.select("unit", "city", pre.alias("pre"), (pre >= 36).alias("ready"), F.when(F.col("lon") < 116.2, "west").otherwise("east").alias("stratum"))


@query("assess_annual_support", """SELECT unit, count(DISTINCT year) FILTER (WHERE year - yo BETWEEN -3 AND -1) AS pre, count(DISTINCT year) FILTER (WHERE year - yo BETWEEN 1 AND 2) AS post, count(DISTINCT year) FILTER (WHERE year - yo BETWEEN -3 AND -1) = 3
    AND count(DISTINCT year) FILTER (WHERE year - yo BETWEEN 1 AND 2) = 2 AS exact FROM annual JOIN (SELECT unit, year(opening) AS yo FROM units WHERE treated) USING (unit) GROUP BY 1""", "units panel annual")
def _(s, d):
    a = annual(s, d).join(R.units(s, d).where("treated").select("unit", F.year("opening").alias("yo")), "unit").withColumn("r", F.col("year") - F.col("yo"))
    n = lambda lo, hi: F.count_distinct(F.when(F.col("r").between(lo, hi), F.col("year")))
    return a.groupBy("unit").agg(n(-3, -1).alias("pre"), n(1, 2).alias("post")).withColumn("exact", (F.col("pre") == 3) & (F.col("post") == 2))


def _count(lo, hi):
    return F.count_if(F.col("t").between(lo, hi))


@query("assess_monthly_support", """SELECT unit, count(*) FILTER (WHERE t BETWEEN -12 AND -1) AS pre12, count(*) FILTER (WHERE t BETWEEN 1 AND 24) AS post24, count(*) FILTER (WHERE t IN (1, 3, 6, 12, 18, 24)) AS horizons FROM rel WHERE treated GROUP BY 1""", "units panel rel")
def _(s, d):
    return rel(s, d).where("treated").groupBy("unit").agg(_count(-12, -1).alias("pre12"), _count(1, 24).alias("post24"), F.count_if(F.col("t").isin(1, 3, 6, 12, 18, 24)).alias("horizons"))


@query("family_support", """SELECT unit, count(DISTINCT year) FILTER (WHERE year < yo) AS pre_years, count(DISTINCT year) FILTER (WHERE year > yo) AS post_years, count(DISTINCT year) FILTER (WHERE year < yo) >= 3 AND count(DISTINCT year) FILTER (WHERE year > yo) >= 2 AS ready
    FROM annual JOIN (SELECT unit, year(opening) AS yo FROM units) USING (unit) GROUP BY 1""", "units panel annual")
def _(s, d):
    a = annual(s, d).join(R.units(s, d).select("unit", F.year("opening").alias("yo")), "unit")
    n = lambda ok: F.count_distinct(F.when(ok, F.col("year")))
    g = a.groupBy("unit").agg(n(F.col("year") < F.col("yo")).alias("pre_years"), n(F.col("year") > F.col("yo")).alias("post_years"))
    return g.withColumn("ready", (F.col("pre_years") >= 3) & (F.col("post_years") >= 2))


@query("pretrend_availability", """SELECT unit, m, q, (m >= 3)::INT + (q >= 3)::INT AS families3 FROM (SELECT unit, count(DISTINCT period) FILTER (WHERE t BETWEEN -6 AND -1) AS m, count(DISTINCT quarter(period)) FILTER (WHERE t BETWEEN -12 AND -1) AS q FROM rel GROUP BY 1)""", "units panel rel")
def _(s, d):
    g = rel(s, d).groupBy("unit").agg(
        F.count_distinct(F.when(F.col("t").between(-6, -1), F.col("period"))).alias("m"), F.count_distinct(F.when(F.col("t").between(-12, -1), F.quarter("period"))).alias("q")
    )
    return g.withColumn("families3", (F.col("m") >= 3).cast("int") + (F.col("q") >= 3).cast("int"))


@query("input_coverage", """SELECT city, count(*) AS n_rows, count(DISTINCT unit) AS cells, min(period) AS first_month, max(period) AS last_month FROM rel WHERE treated GROUP BY 1""", "units panel rel")
def _(s, d):
    return rel(s, d).where("treated").groupBy("city").agg(F.count("*").alias("n_rows"), F.count_distinct("unit").alias("cells"), F.min("period").alias("first_month"), F.max("period").alias("last_month"))


@query("treated_support_windows", "SELECT unit, " + ", ".join(f"count(*) FILTER (WHERE t BETWEEN {-k} AND -1) AS pre{k}, count(*) FILTER (WHERE t BETWEEN 1 AND {k}) AS post{k}" for k in (12, 24, 36)) + " FROM rel WHERE treated GROUP BY 1", "units panel rel")
def _(s, d):
    cols = [c for k in (12, 24, 36) for c in (_count(-k, -1).alias(f"pre{k}"), _count(1, k).alias(f"post{k}"))]
    return rel(s, d).where("treated").groupBy("unit").agg(*cols)


@query("city_year_coverage", """WITH k AS (SELECT city, year(day)::INT AS year, count(*) AS n FROM prices GROUP BY 1, 2) SELECT city, year, n, round(n / median(n) OVER (PARTITION BY city), 5) AS share, n < 0.5 * median(n) OVER (PARTITION BY city) AS short FROM k""", "prices")
def _(s, d):
    k = R.prices(s, d).groupBy("city", F.year("day").alias("year")).agg(F.count("*").alias("n"))
    k = k.join(k.groupBy("city").agg(F.median("n").alias("m")), "city")
    return k.select("city", "year", "n", F.round(F.col("n") / F.col("m"), 5).alias("share"), (F.col("n") < 0.5 * F.col("m")).alias("short"))


@query("poi_coverage", "SELECT city, count(*) AS n, median(k) AS median_day FROM (SELECT city, day, count(*) AS k FROM points GROUP BY 1, 2) GROUP BY 1", "points")
def _(s, d):
    return R.points(s, d).groupBy("city", "day").agg(F.count("*").alias("k")).groupBy("city").agg(F.count("*").alias("n"), F.median("k").alias("median_day"))


@query("station_quality", """SELECT city, count(*) AS n, count(*) FILTER (WHERE lon > 116.3) AS out_of_range, count(*) - count(DISTINCT opening) AS repeated, greatest(25 - count(*), 0) AS quota_gap FROM units GROUP BY 1""", "units")
def _(s, d):
    return R.units(s, d).groupBy("city").agg(F.count("*").alias("n"), F.count_if(F.col("lon") > 116.3).alias("out_of_range"), (F.count("*") - F.count_distinct("opening")).alias("repeated"), F.greatest(F.lit(25) - F.count("*"), F.lit(0)).alias("quota_gap"))


@query("composition_event_path", """SELECT k AS event_year, sum(n)::BIGINT AS transactions, round(avg(y), 5) AS level FROM (SELECT floor(t / 12)::BIGINT AS k, n, y FROM rel WHERE treated AND t BETWEEN -36 AND 35) GROUP BY 1""", "units panel rel")
def _(s, d):
    r = rel(s, d).where("treated and t between -36 and 35").withColumn("k", F.floor(F.col("t") / 12))
    return r.groupBy(F.col("k").alias("event_year")).agg(F.sum("n").alias("transactions"), F.round(F.avg("y"), 5).alias("level"))


@query("generation_tables", """SELECT c.city, f.source, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY c.city), 6) AS share FROM (SELECT DISTINCT city FROM prices) c CROSS JOIN (SELECT DISTINCT source FROM prices) f
    LEFT JOIN (SELECT city, source, count(*) AS n FROM prices WHERE stage = 'F' GROUP BY 1, 2) k ON k.city = c.city AND k.source = f.source""", "prices")
def _(s, d):
    p = R.prices(s, d)
    grid = S.skeleton(p.select("city").distinct(), p.select("source").distinct())
    k = grid.join(p.where("stage = 'F'").groupBy("city", "source").agg(F.count("*").alias("n")), ["city", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return k.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("city")), 6))


@query("distribution_tukey", """WITH q AS (SELECT city, count(*) AS n, avg(price) AS m, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM prices GROUP BY 1)
    SELECT city, n, round(any_value(m), 4) AS mean, round(any_value(b - a), 4) AS iqr, round(count(*) FILTER (WHERE price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a)) / n, 6) AS outliers FROM prices JOIN q USING (city) GROUP BY city, n""", "prices")
def _(s, d):
    p = R.prices(s, d)
    q = p.groupBy("city").agg(F.count("*").alias("n"), F.avg("price").alias("m"), F.percentile("price", 0.25).alias("a"), F.percentile("price", 0.75).alias("b"))
    width = F.col("b") - F.col("a")
    out = (F.col("price") < F.col("a") - 1.5 * width) | (F.col("price") > F.col("b") + 1.5 * width)
    g = p.join(q, "city").groupBy("city", "n", "m", "a", "b").agg(F.count_if(out).alias("o"))
    return g.select("city", "n", F.round("m", 4).alias("mean"), F.round(width, 4).alias("iqr"), F.round(F.col("o") / F.col("n"), 6).alias("outliers"))


@query("lattice_support_mismatch", """SELECT unit, label IS NULL AS missing, round(greatest(0, 500 - abs(x - 500 * floor(x / 500) - 250)) * greatest(0, 500 - abs(y - 500 * floor(y / 500) - 250)) / 250000, 5) AS overlap FROM munits LEFT JOIN embeddings ON vec_id = unit""", "units munits")
def _(s, d):
    gap = lambda c: F.greatest(F.lit(0.0), 500 - F.abs(F.col(c) - 500 * F.floor(F.col(c) / 500) - 250))
    v = R.table(s, d, "embeddings").select(F.col("vec_id").alias("unit"), "label")
    return R.metric(R.units(s, d)).join(v, "unit", "left").select("unit", F.col("label").isNull().alias("missing"), F.round(gap("x") * gap("y") / 250000, 5).alias("overlap"))


@query("source_overlap_keys", """SELECT city, round(avg(hit::INT), 6) AS share FROM (SELECT city, EXISTS (SELECT 1 FROM prices b WHERE b.source = '1-URGENT' AND b.community = a.community AND b.day = a.day) AS hit FROM prices a WHERE source <> '1-URGENT') GROUP BY 1""", "prices")
def _(s, d):
    p = R.prices(s, d)
    ref = p.where("source = '1-URGENT'").select("community", "day", F.lit(1).alias("hit")).distinct()
    j = p.where("source <> '1-URGENT'").join(ref, ["community", "day"], "left")
    return j.groupBy("city").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("share"))


@query("crs_ambiguity", """SELECT shift::INT AS shift, round(median(d), 3) AS p50, round(quantile_cont(d, 0.9), 3) AS p90 FROM (SELECT shift, sqrt(power(x - 500 * floor(x / 500) - 250 + shift, 2) + power(y - 500 * floor(y / 500) - 250, 2)) AS d FROM munits, (SELECT unnest([0, 100, 200]) AS shift)) GROUP BY 1""", "units munits")
def _(s, d):
    off = lambda c: F.col(c) - 500 * F.floor(F.col(c) / 500) - 250
    u = R.metric(R.units(s, d)).withColumn("shift", F.explode(F.array(*[F.lit(k) for k in (0, 100, 200)]))).withColumn("d", F.hypot(off("x") + F.col("shift"), off("y")))
    return u.groupBy("shift").agg(F.round(F.median("d"), 3).alias("p50"), F.round(F.percentile("d", 0.9), 3).alias("p90"))


@query("source_stack_coverage", """SELECT city, source, count(*) AS n, count(DISTINCT year(day)) AS years, count(*) FILTER (WHERE community % 3 > 0) AS matched FROM prices GROUP BY 1, 2""", "prices")
def _(s, d):
    return R.prices(s, d).groupBy("city", "source").agg(F.count("*").alias("n"), F.count_distinct(F.year("day")).alias("years"), F.count_if(F.col("community") % 3 > 0).alias("matched"))


@query("capture_traceability", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, count(*) AS attempts, arg_max(event_type, (ts, event_id)) <> 'purchase' AS open FROM events GROUP BY 1""")
def _(s, d):
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return R.table(s, d, "events").groupBy("user_id").agg(last.alias("latest"), F.count("*").alias("attempts"), (last != "purchase").alias("open"))


@query("source_year_completeness", """SELECT source, city, n_years, n_years < max(n_years) OVER (PARTITION BY source) AS short FROM (SELECT source, city, count(DISTINCT strftime(day, '%Y-%m')) AS n_years FROM prices GROUP BY 1, 2)""", "prices")
def _(s, d):
    k = R.prices(s, d).groupBy("source", "city").agg(F.count_distinct(F.date_format("day", "yyyy-MM")).alias("n_years"))
    return k.withColumn("short", F.col("n_years") < F.max("n_years").over(Window.partitionBy("source")))


@query("grid_bbox_audit", """SELECT city, round(min(lon) - 116, 6) AS d_left, round(116.4 - max(lon), 6) AS d_right, min(lon) - 116 > 0.001 AS flagged FROM units GROUP BY 1""", "units")
def _(s, d):
    return R.units(s, d).groupBy("city").agg(F.round(F.min("lon") - 116, 6).alias("d_left"), F.round(116.4 - F.max("lon"), 6).alias("d_right"), (F.min("lon") - 116 > 0.001).alias("flagged"))


@query("station_attribute_audit", """SELECT city, count(*) AS eligible, count(k) AS covered, count(*) FILTER (WHERE k IS NULL) AS uncovered FROM units LEFT JOIN (SELECT c_nationkey AS unit, count(*) AS k FROM customer GROUP BY 1 HAVING count(*) > 55) USING (unit) GROUP BY 1""", "units")
def _(s, d):
    k = R.table(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("unit")).agg(F.count("*").alias("k")).where("k > 55")
    return S.join_validated(R.units(s, d).select("unit", "city"), k, ["unit"]).groupBy("city").agg(F.count("*").alias("eligible"), F.count("k").alias("covered"), F.count_if(F.col("k").isNull()).alias("uncovered"))


@query("treated_registry", """SELECT unit, CASE WHEN year(opening) < 1999 THEN 'early' WHEN count(*) OVER (PARTITION BY city, opening) > 1 THEN 'competing' ELSE 'kept' END AS reason FROM units WHERE treated""", "units")
def _(s, d):
    n = F.count("*").over(Window.partitionBy("city", "opening"))
    return R.units(s, d).where("treated").select("unit", F.when(F.year("opening") < 1999, "early").when(n > 1, "competing").otherwise("kept").alias("reason"))


@query("city_spatial_summary", """SELECT city, count(*) AS n, count(*) FILTER (WHERE treated) AS n_treated, count(DISTINCT opening) AS cohorts, round(avg((NOT treated)::INT), 6) AS donor_share FROM units GROUP BY 1""", "units")
def _(s, d):
    return R.units(s, d).groupBy("city").agg(F.count("*").alias("n"), F.count_if("treated").alias("n_treated"), F.count_distinct("opening").alias("cohorts"), F.round(F.avg((~F.col("treated")).cast("int")), 6).alias("donor_share"))


@query("spatial_issue_queue", """SELECT city, opening, count(*) AS n, string_agg(unit::VARCHAR, ';' ORDER BY unit) AS units, bool_and(treated) AS all_treated, printf('%.7f', min(lon)) AS lon FROM units GROUP BY 1, 2 HAVING count(*) > 1""", "units")
def _(s, d):
    g = R.units(s, d).groupBy("city", "opening").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("unit")).alias("l"), F.bool_and("treated").alias("all_treated"), F.format_string("%.7f", F.min("lon")).alias("lon"))
    return g.where("n > 1").select("city", "opening", "n", F.array_join(F.transform("l", lambda x: x.cast("string")), ";").alias("units"), "all_treated", "lon")


@query("event_support_tables", """WITH p AS (SELECT treated, t, t - row_number() OVER (PARTITION BY treated ORDER BY t) AS g FROM paths WHERE y IS NOT NULL AND y0 IS NOT NULL) SELECT treated, min(lo)::BIGINT AS first_t, max(hi)::BIGINT AS last_t, max(n) AS longest FROM (SELECT treated, g, min(t) AS lo, max(t) AS hi, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1""", "units panel pairs paths")
def _(s, d):
    p = paths(s, d).dropna(subset=["y", "y0"]).withColumn("g", F.col("t") - F.row_number().over(Window.partitionBy("treated").orderBy("t")))
    runs = p.groupBy("treated", "g").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    return runs.groupBy("treated").agg(F.min("lo").cast("long").alias("first_t"), F.max("hi").cast("long").alias("last_t"), F.max("n").alias("longest"))


