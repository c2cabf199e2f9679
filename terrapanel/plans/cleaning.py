"""Queries of the typing, parsing and flag operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from . import roles as R
from .base import book

QUERIES, ORACLE, query = book()


@query("finite_or_null", """SELECT event_id, round(CASE WHEN value > 0 THEN ln(value) END, 6) AS log_value,
    TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def _(s, d):
    e = R.table(s, d, "events")
    log = C.finite_or_null(F.when(F.col("value") > 0, F.log("value")).otherwise(float("nan")))
    return e.select("event_id", F.round(log, 6).alias("log_value"), C.finite_or_null(F.get_json_object("props", "$.k")).alias("k"))


@query("outcome_transforms", """SELECT unit, period, round(ln(1 + greatest(n, 0)), 6) AS log_n, round(asinh(y), 6) AS asinh_y,
    round(ln(y), 6) AS log_y FROM panel WHERE y > 0""", "panel")
def _(s, d):
    p = R.panel(s, d).where("y > 0")
    cols = [C.log_count(F.col("n").cast("double")), C.asinh(F.col("y")), C.log_price(F.col("y"))]
    return p.select("unit", "period", *[F.round(c, 6).alias(n) for c, n in zip(cols, ("log_n", "asinh_y", "log_y"))])


@query("validate_export_rows", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(n BETWEEN 0 AND 31, false)) AS bad_count,
    count(*) FILTER (WHERE NOT coalesce(period >= DATE '1995-02-01', false)) AS bad_period, count(*) FILTER (WHERE unit IS NULL) AS bad_unit
    FROM panel""", "panel")
def _(s, d):
    rules = {"count": F.col("n").between(0, 31), "period": F.col("period") >= F.lit("1995-02-01").cast("date"), "unit": F.col("unit").isNotNull()}
    return C.violations(R.panel(s, d), rules)


@query("coordinate_filter", "SELECT point_id, lon, lat FROM points WHERE lon BETWEEN 116.1 AND 116.3 AND lat BETWEEN 39.8 AND 40.0", "points")
def _(s, d):
    return C.coordinate_filter(R.points(s, d), "lon", "lat", (116.1, 39.8, 116.3, 40.0)).select("point_id", "lon", "lat")


@query("parse_number_text", r"""SELECT event_id, TRY_CAST(regexp_extract(replace(props, ',', ''), '-?\d+(\.\d+)?', 0) AS DOUBLE) AS number FROM events""")
def _(s, d):
    return R.table(s, d, "events").select("event_id", C.parse_number(F.col("props")).alias("number"))


@query("parse_point_text", "SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat, 2::INT AS n_vertices FROM points", "points")
def _(s, d):
    p = R.points(s, d)
    text = F.format_string("POINT(%.6f %.6f)", "lon", "lat")
    ring = F.format_string("%.6f,%.6f;%.6f,%.6f", "lon", "lat", "lon", "lat")
    got = p.select("point_id", C.parse_point(text).alias("p"), F.size(C.parse_vertices(ring)).alias("n_vertices"))
    return got.select("point_id", "p.lon", "p.lat", "n_vertices")


@query("parse_month_text", """SELECT unit, strftime(period, '%Y-%m') AS month, round(arg_max(y, period), 6) AS latest FROM panel
    GROUP BY unit, strftime(period, '%Y-%m')""", "panel")
def _(s, d):
    p = R.panel(s, d).withColumn("text", F.concat(F.year("period"), F.lit("."), F.month("period")))
    return p.groupBy("unit", C.parse_month(F.col("text")).alias("month")).agg(F.round(F.max_by("y", "period"), 6).alias("latest"))


@query("normalize_station_name", """SELECT s_suppkey, lower(replace(replace(s_name, '#', ''), '-', '')) AS name FROM (
    SELECT s_suppkey, regexp_replace(s_name, '\\s+', '', 'g') AS s_name FROM supplier)""")
def _(s, d):
    noisy = F.concat(F.lit(" "), F.regexp_replace("s_name", "#", ""), F.lit("站（A口）"))
    return R.table(s, d, "supplier").select("s_suppkey", C.normalize_station_name(noisy).alias("name"))


CATEGORIES = {"click": "retail", "view": "food", "purchase": "life_service", "signup": "office"}


@query("category_map", """SELECT point_id, CASE category WHEN 'click' THEN 'retail' WHEN 'view' THEN 'food'
    WHEN 'purchase' THEN 'life_service' WHEN 'signup' THEN 'office' ELSE 'other' END AS category FROM points""", "points")
def _(s, d):
    return R.points(s, d).select("point_id", C.lookup(F.col("category"), CATEGORIES, "other").alias("category"))


@query("keyword_flags", """SELECT p_partkey, (lower(p_name) LIKE '%1%' OR lower(p_name) LIKE '%part%')::INT AS is_chain,
    (lower(p_type) LIKE '%a%')::INT AS has_a FROM part""")
def _(s, d):
    return R.table(s, d, "part").select(
        "p_partkey", C.keyword_flag(F.col("p_name"), ["1", "PART"]).alias("is_chain"), C.keyword_flag(F.col("p_type"), ["A"]).alias("has_a")
    )


POI_SQL = """SELECT point_id, city, category, (category IN ('retail', 'food', 'life_service'))::INT AS is_commercial,
    (lower(name) LIKE '%1%')::INT AS is_chain,
    ((category IN ('retail', 'food', 'life_service')) AND lower(name) LIKE '%2%')::INT AS is_community_commerce, lon, lat,
    CAST(day(day) % 4 + 2020 AS INT) AS year FROM (SELECT * REPLACE (CASE category WHEN 'click' THEN 'retail' WHEN 'view' THEN 'food'
    WHEN 'purchase' THEN 'life_service' WHEN 'signup' THEN 'office' ELSE 'other' END AS category) FROM points)"""
R.SQL["poi"] = POI_SQL


def poi(s, d):
    p = R.points(s, d).withColumnRenamed("category", "raw_category")
    got = C.poi_normalize(p, CATEGORIES, ["1"], ["retail", "food", "life_service"], ["2"])
    return got.withColumn("year", (F.dayofmonth("day") % 4 + 2020).cast("int")).select(
        "point_id", "city", "category", "is_commercial", "is_chain", "is_community_commerce", "lon", "lat", "year"
    )


query("poi_normalize", "SELECT * FROM poi", "points poi")(poi)


@query("quality_flags", """SELECT obs_id, concat_ws(';', CASE WHEN price <= 500 THEN 'low_price' END, CASE WHEN area > 140 THEN 'large_area' END,
    CASE WHEN lon > 116.39 THEN 'invalid_lon' END, CASE WHEN stage = 'F' AND count(CASE WHEN stage = 'F' THEN 1 END)
    OVER (PARTITION BY community, day) > 1 THEN 'duplicate_key' END) AS flags FROM prices""", "prices")
def _(s, d):
    p = C.repeated(R.prices(s, d), ["community", "day"], F.col("stage") == "F", "dup")
    rules = {"low_price": F.col("price") <= 500, "large_area": F.col("area") > 140, "invalid_lon": F.col("lon") > 116.39, "duplicate_key": F.col("dup")}
    return p.select("obs_id", C.flags(rules).alias("flags"))


@query("source_flag_rules", """SELECT obs_id, concat_ws(';', CASE WHEN price <= 500 THEN 'low_price' END,
    CASE WHEN source = '1-URGENT' THEN 'urgent' END, CASE WHEN stage = 'P' THEN 'pending' END) AS flags FROM prices""", "prices")
def _(s, d):
    p = R.prices(s, d).withColumn("flags", C.flags({"low_price": F.col("price") <= 500}))
    for column, value, flag in (("source", "1-URGENT", "urgent"), ("stage", "P", "pending")):
        p = p.withColumn("flags", C.append_flag(F.col("flags"), F.col(column) == value, flag))
    return p.select("obs_id", "flags")


@query("flag_union", """SELECT obs_id, array_to_string(list_sort(list_distinct(list_filter([stage, source, CASE WHEN price < 900 THEN 'cheap' ELSE '' END,
    stage], lambda x: x <> ''))), ';') AS flags FROM prices""", "prices")
def _(s, d):
    left = F.concat_ws(";", "stage", "source")
    right = F.concat_ws("; ", F.when(F.col("price") < 900, "cheap").otherwise(""), "stage")
    return R.prices(s, d).select("obs_id", C.flag_union(left, right, F.lit(None).cast("string")).alias("flags"))


@query("derive_unit_price", """SELECT obs_id, CASE WHEN obs_id % 3 = 0 THEN total / area ELSE price * 1.02::DOUBLE END AS price,
    CASE WHEN obs_id % 3 <> 0 THEN round(abs(price * 1.02::DOUBLE - total / area) / (total / area), 6) END AS error FROM prices""", "prices")
def _(s, d):
    given = F.when(F.col("obs_id") % 3 != 0, F.col("price") * 1.02)
    got = R.prices(s, d).select("obs_id", C.derive_unit_price(given, F.col("total"), F.col("area")).alias("p"))
    return got.select("obs_id", F.col("p.price"), F.round("p.error", 6).alias("error"))


@query("transaction_rebuild", r"""SELECT obs_id, TRY_CAST(regexp_extract(t, '(\d+)R', 1) AS INT) AS rooms,
    TRY_CAST(regexp_extract(t, '-(\d{4})-', 1) AS INT) AS built, TRY_CAST(regexp_extract(t, '-(\d{4})-', 1) AS INT) BETWEEN 1995 AND 2000 AS built_valid,
    substr(sha256(t), 1, 24) AS id FROM (SELECT obs_id, concat(obs_id % 6, 'R', obs_id % 3, 'H-', year(day), '-', stage) AS t FROM prices)""", "prices")
def _(s, d):
    k = F.col("obs_id")
    text = F.concat(k % 6, F.lit("R"), k % 3, F.lit("H-"), F.year("day"), F.lit("-"), "stage")
    t = R.prices(s, d).select("obs_id", text.alias("t"))
    built = F.regexp_extract("t", r"-(\d{4})-", 1).try_cast("int")
    return t.select(
        "obs_id", F.regexp_extract("t", r"(\d+)R", 1).try_cast("int").alias("rooms"), built.alias("built"),
        built.between(1995, 2000).alias("built_valid"), C.stable_id(F.col("t")).alias("id"),
    )


@query("open_source_normalize", """SELECT o_orderkey AS record_id, 'open' AS source_id, year(o_orderdate)::INT AS year, round(o_totalprice, 2) AS price,
    concat_ws(';', CASE WHEN o_totalprice < 1000 THEN 'nonpositive' END, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1
    THEN 'duplicate' END) AS flags FROM orders""")
def _(s, d):
    o = R.table(s, d, "orders").toDF("record_id", "cust", "status", "price", "day", "priority")
    o = C.repeated(o, ["cust", "day"], F.lit(True), "dup")
    flags = C.flags({"nonpositive": F.col("price") < 1000, "duplicate": F.col("dup")})
    return o.select("record_id", F.lit("open").alias("source_id"), F.year("day").alias("year"), F.round("price", 2).alias("price"), flags.alias("flags"))


@query("wide_to_long", """SELECT p_partkey, measure, round(value, 4) AS value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price
    FROM part) UNPIVOT INCLUDE NULLS (value FOR measure IN (size, price))""")
def _(s, d):
    p = R.table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return C.wide_to_long(p, ["p_partkey"], ["size", "price"], "measure", "value").withColumn("value", F.round("value", 4))


@query("stable_row_id", "SELECT obs_id, substr(sha256(concat_ws('|', source, stage, obs_id::VARCHAR)), 1, 24) AS id FROM prices", "prices")
def _(s, d):
    return R.prices(s, d).select("obs_id", C.stable_id(F.col("source"), F.col("stage"), F.col("obs_id").cast("string")).alias("id"))


@query("time_precision_fields", """SELECT obs_id, year(day)::INT AS observed_year, CASE WHEN stage = 'F' THEN CAST(date_trunc('month', day) AS DATE) END AS observed_month,
    CASE WHEN stage <> 'P' THEN concat(year(day), 'Q', quarter(day)) END AS observed_quarter FROM prices""", "prices")
def _(s, d):
    p = R.prices(s, d).withColumn("precision", F.when(F.col("stage") == "F", "day").when(F.col("stage") == "P", "year").otherwise("quarter"))
    return C.time_fields(p, "day", "precision").select("obs_id", "observed_year", "observed_month", "observed_quarter")


@query("eligibility_flags", """SELECT obs_id, price > 0 AND lon < 116.35 AND stage <> 'P' AND year(day) > 1996 AS month_ok,
    price > 0 AND lon < 116.35 AND stage <> 'P' AS year_ok FROM prices""", "prices")
def _(s, d):
    p = R.prices(s, d)
    args = F.col("price"), F.col("lon") < 116.35, F.col("stage") != "P"
    month = F.when(F.year("day") > 1996, F.trunc("day", "MM"))
    return p.select("obs_id", C.eligibility(*args, month).alias("month_ok"), C.eligibility(*args, F.year("day")).alias("year_ok"))


@query("lifecycle_supersede", """SELECT obs_id, 'transaction' AS stage, CAST(day + to_days(CAST(obs_id % 60 AS INT)) AS DATE) AS day, price FROM prices
    WHERE obs_id % 4 <> 0 UNION ALL SELECT obs_id, 'listing', day, price * 1.1::DOUBLE FROM prices WHERE obs_id % 4 = 0
    OR date_trunc('month', day) <> date_trunc('month', CAST(day + to_days(CAST(obs_id % 60 AS INT)) AS DATE))""", "prices")
def _(s, d):
    k = F.col("obs_id")
    p = R.prices(s, d).select(
        "obs_id", F.col("day").alias("listed"), F.when(k % 4 != 0, F.date_add("day", (k % 60).cast("int"))).alias("sold"),
        (F.col("price") * 1.1).alias("ask"), F.col("price").alias("got"),
    )
    return C.lifecycle(p, "listed", "sold", "ask", "got")


@query("under_construction_filter", """SELECT unit, opening FROM units WHERE city <> 3 AND year(opening) <= 1999""", "units")
def _(s, d):
    u = R.units(s, d).withColumn("status", F.when(F.col("city") == 3, "Planned line").otherwise("open")).withColumn("year", F.year("opening").cast("string"))
    return C.not_planned(u, "status", "year", ["planned", "future"], 1999).select("unit", "opening")


@query("coordinate_systems")
def _(s, d):
    return C.gcj02_to_wgs84(R.points(s, d), "lon", "lat").select("point_id", F.round("wgs_lon", 7).alias("wgs_lon"), F.round("wgs_lat", 7).alias("wgs_lat"))


@query("project_utm")
def _(s, d):
    return C.project_utm(R.points(s, d), "lon", "lat").select("point_id", "utm_zone", F.round("utm_x", 3).alias("utm_x"), F.round("utm_y", 3).alias("utm_y"))


@query("intervention_fields", """SELECT unit, CASE WHEN treated THEN opening END AS opening, treated AS opening_available,
    CASE WHEN treated AND city <> 2 THEN city END AS line, treated AND city <> 2 AS line_available FROM units""", "units")
def _(s, d):
    opening, line = F.when(F.col("treated"), F.col("opening")), F.when(F.col("treated") & (F.col("city") != 2), F.col("city"))
    return R.units(s, d).select(
        "unit", opening.alias("opening"), opening.isNotNull().alias("opening_available"), line.alias("line"), line.isNotNull().alias("line_available")
    )


@query("status_classification", """SELECT obs_id, CASE WHEN source LIKE '%URGENT' THEN 'failed' WHEN source LIKE '%NOT%' THEN 'unsupported'
    WHEN starts_with(source, '2') THEN 'retry' ELSE 'ok' END AS class FROM prices""", "prices")
def _(s, d):
    t = F.col("source")
    kind = F.when(t.rlike("URGENT$"), "failed").when(t.contains("NOT"), "unsupported").when(t.startswith("2"), "retry").otherwise("ok")
    return R.prices(s, d).select("obs_id", kind.alias("class"))


@query("mc_label_demotion", """SELECT unit, CASE WHEN count(*) FILTER (WHERE period < opening) = 0 THEN 'no_pre_anchor'
    WHEN NOT bool_and(n > 1) THEN 'invalid_proof' ELSE 'kept' END AS reason FROM panel JOIN units USING (unit) GROUP BY unit""", "units panel")
def _(s, d):
    p = R.panel(s, d).join(R.units(s, d).select("unit", "opening"), "unit")
    got = p.groupBy("unit").agg(F.count_if(F.col("period") < F.col("opening")).alias("pre"), F.bool_and(F.col("n") > 1).alias("proof"))
    return got.select("unit", F.when(F.col("pre") == 0, "no_pre_anchor").when(~F.col("proof"), "invalid_proof").otherwise("kept").alias("reason"))


@query("event_phase", """SELECT unit, period, CASE WHEN t = -1 THEN 'reference' WHEN t < 0 THEN 'pre' WHEN t = 0 THEN 't0' ELSE 'post' END AS phase
    FROM (SELECT unit, period, (year(period) - year(opening)) * 12 + month(period) - month(opening) AS t FROM panel JOIN units USING (unit))""", "units panel")
def _(s, d):
    p = R.panel(s, d).join(R.units(s, d).select("unit", "opening"), "unit")
    t = (F.year("period") - F.year("opening")) * 12 + F.month("period") - F.month("opening")
    return p.select("unit", "period", C.event_phase(t, -1).alias("phase"))
