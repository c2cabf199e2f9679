"""Queries of scans, sinks and fingerprints; written tables go to the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tables as T
from . import roles as R
from .base import book
from .estimators import ready

QUERIES, ORACLE, query = book()


def scratch(s) -> str:
    ready(s)
    return f"{(s.conf.get('spark.checkpoint.dir', None) or s.sparkContext.getCheckpointDir()).rstrip('/')}/plan-{uuid.uuid4().hex}"


def stored_panel(s, d) -> str:
    out = scratch(s)
    T.write_partitions(R.panel(s, d).withColumn("month", F.month("period")), out, ["city", "month"])
    return out


@query("scan_hive_month", "SELECT unit, period, round(y, 6) AS y FROM panel WHERE city = 2 AND month(period) IN (3, 4)", "panel")
def _(s, d):
    cells = R.units(s, d).select("unit")
    return T.scan_partitions(s, stored_panel(s, d), 2, [3, 4], cells).select("unit", "period", F.round("y", 6).alias("y"))


@query("scan_typed_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(s, d):
    out = scratch(s)
    R.table(s, d, "supplier").write.option("header", True).csv(out)
    return T.scan_csv(s, out, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("scan_annual_family", "SELECT unit, year(period)::INT AS year, round(ln(1 + sum(n)), 6) AS log_n FROM panel GROUP BY 1, 2", "panel")
def _(s, d):
    return R.panel(s, d).groupBy("unit", F.year("period").alias("year")).agg(F.round(F.log1p(F.sum("n")), 6).alias("log_n"))


@query("import_mapped_table", "SELECT o_orderkey AS record_id, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day, 'orders' AS source_id, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders")
def _(s, d):
    o = R.table(s, d, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return T.import_mapped(o, {"record_id": "o_orderkey", "price": "o_totalprice", "day": "d"}, {"source_id": "orders"}, "day")


@query("manifest_completeness", """WITH e AS (SELECT unit, year FROM (SELECT unit FROM units), (SELECT unnest(range(1996, 2001))::INT AS year)), f AS (SELECT unit, year(period)::INT AS year, count(*) AS n FROM panel WHERE month(period) < 3 GROUP BY 1, 2)
    SELECT coalesce(e.unit, f.unit) AS unit, coalesce(e.year, f.year) AS year, CASE WHEN n IS NULL THEN 'missing' WHEN e.unit IS NULL THEN 'extra' ELSE 'duplicate' END AS status FROM e FULL JOIN f ON e.unit = f.unit AND e.year = f.year WHERE n IS NULL OR e.unit IS NULL OR n > 1""", "units panel")
def _(s, d):
    years = s.range(1996, 2001).select(F.col("id").cast("int").alias("year"))
    found = R.panel(s, d).where(F.month("period") < 3).select("unit", F.year("period").alias("year"))
    return T.completeness(R.units(s, d).select("unit").crossJoin(years), found, ["unit", "year"])


@query("sink_replace_years", "SELECT year(period)::INT AS year, count(*) AS n, sum(CASE WHEN year(period) >= 2000 THEN 2 ELSE 1 END)::BIGINT AS version FROM panel GROUP BY 1", "panel")
def _(s, d):
    out = scratch(s)
    p = R.panel(s, d).withColumn("year", F.year("period"))
    T.write_partitions(p.select("unit", "year", F.lit(1).alias("v")), out, ["year"])
    T.write_partitions(p.where("year >= 2000").select("unit", "year", F.lit(2).alias("v")), out, ["year"])
    return s.read.parquet(out).groupBy("year").agg(F.count("*").alias("n"), F.sum("v").alias("version"))


@query("sink_year_filter", "SELECT unit, period FROM panel WHERE year(period) BETWEEN 1997 AND 1998", "panel")
def _(s, d):
    out = scratch(s)
    R.panel(s, d).select("unit", "period", F.year("period").alias("year")).write.partitionBy("year").parquet(out)
    return s.read.parquet(out).where("year between 1997 and 1998").select("unit", "period")


@query("sink_release", "SELECT count(*) AS n_rows, true AS same FROM panel", "panel")
def _(s, d):
    p = R.panel(s, d).select("unit", "period", "n")
    kept, made = T.write_release(p, scratch(s)), T.fingerprint(p)
    return kept.join(made.withColumnRenamed("n_rows", "m").withColumnRenamed("content", "c")).select("n_rows", ((F.col("n_rows") == F.col("m")) & (F.col("content") == F.col("c"))).alias("same"))


@query("panel_content_fingerprint", "SELECT city, bit_xor(('0x' || h[1:15])::BIGINT) AS high, bit_xor(('0x' || h[16:30])::BIGINT) AS low, count(*) AS n FROM (SELECT city, sha256(unit::VARCHAR || chr(31) || period::VARCHAR || chr(31) || n::VARCHAR) AS h FROM panel) GROUP BY 1", "panel")
def _(s, d):
    h = R.panel(s, d).select("city", T.row_hash([F.col("unit"), F.col("period"), F.col("n")]).alias("h"))
    part = lambda at: F.bit_xor(F.conv(F.substring("h", at, 15), 16, 10).cast("long"))
    return h.groupBy("city").agg(part(1).alias("high"), part(16).alias("low"), F.count("*").alias("n"))


@query("ingest_incremental", "SELECT city, count(*) AS n_rows FROM points GROUP BY 1", "points")
def _(s, d):
    base = scratch(s)
    p = R.points(s, d).select("point_id", "city", "value")
    for half in (0, 1):
        p.where(F.col("point_id") % 2 == half).write.mode("append").parquet(f"{base}/in")
        T.ingest_new_files(s, f"{base}/in", "point_id long, city long, value double", f"{base}/out", f"{base}/checkpoint", ["city"])
    return s.read.parquet(f"{base}/out/audit").groupBy("city").agg(F.sum("n_rows").alias("n_rows"))
