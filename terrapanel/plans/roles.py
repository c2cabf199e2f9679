"""Domain tables derived from the given star-schema tables, in Spark and (for checks) in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metres a degree at the study area, and lattice origin.
MX, MY, LON0, LAT0 = 85000.0, 111000.0, 116.0, 39.7


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lon(k: Column) -> Column:
    return F.lit(116.0) + (k * 7919 % 10007).cast("double") / 10007.0 * 0.4


def _lat(k: Column) -> Column:
    return F.lit(39.7) + (k * 104729 % 10009).cast("double") / 10009.0 * 0.4


def _place_sql(k: str) -> str:
    return (
        f"116.0::DOUBLE + CAST({k} * 7919 % 10007 AS DOUBLE) / 10007::DOUBLE * 0.4::DOUBLE AS lon, "
        f"39.7::DOUBLE + CAST({k} * 104729 % 10009 AS DOUBLE) / 10009::DOUBLE * 0.4::DOUBLE AS lat"
    )


def units(s, d) -> DataFrame:
    """Grid cells under study: one for each supplier."""
    sup, nat = table(s, d, "supplier"), table(s, d, "nation")
    k = F.col("s_suppkey")
    return sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(
        k.alias("unit"),
        F.col("n_regionkey").alias("city"),
        (k % 5 == 0).alias("treated"),
        F.add_months(F.lit("1998-07-01").cast("date"), (k % 16).cast("int")).alias("opening"),
        _lon(k).alias("lon"),
        _lat(k).alias("lat"),
    )


def panel(s, d) -> DataFrame:
    """Monthly outcome of each unit; months without an item are missing."""
    li, u = table(s, d, "lineitem"), units(s, d)
    month = F.trunc(F.col("l_shipdate").cast("date"), "MM")
    return (
        li.groupBy(F.col("l_suppkey").alias("unit"), month.alias("period"))
        .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"), F.count("*").alias("n"))
        .join(u.select("unit", "city"), "unit")
        .select("unit", "city", "period", F.log1p("v").alias("y"), "n")
    )


def points(s, d) -> DataFrame:
    e, k = table(s, d, "events"), F.col("event_id")
    return e.select(
        k.alias("point_id"), (k % 5).alias("city"), _lon(k).alias("lon"), _lat(k).alias("lat"), "value",
        F.col("ts").cast("date").alias("day"), F.col("event_type").alias("category"), F.col("props").alias("name"),
    )


def prices(s, d) -> DataFrame:
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    area = (30 + k % 120).cast("double")
    return o.select(
        k.alias("obs_id"), (F.col("o_custkey") % 5).alias("city"), (F.col("o_custkey") % 50).alias("community"),
        F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("stage"), F.col("o_totalprice").alias("total"),
        area.alias("area"), (F.col("o_totalprice") / area).alias("price"), F.col("o_orderdate").cast("date").alias("day"),
        _lon(k).alias("lon"), _lat(k).alias("lat"),
    )


def metric(df: DataFrame) -> DataFrame:
    """Add planar metres x and y."""
    return df.withColumn("x", (F.col("lon") - LON0) * MX).withColumn("y", (F.col("lat") - LAT0) * MY)


SQL = {
    "units": f"""SELECT s_suppkey AS unit, n_regionkey AS city, s_suppkey % 5 = 0 AS treated,
        CAST(DATE '1998-07-01' + to_months(CAST(s_suppkey % 16 AS INT)) AS DATE) AS opening, {_place_sql('s_suppkey')}
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "panel": """SELECT unit, city, period, ln(1 + v) AS y, n FROM (
        SELECT l_suppkey AS unit, n_regionkey AS city, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
        sum(l_extendedprice * (1 - l_discount)) AS v, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)""",
    "points": f"""SELECT event_id AS point_id, event_id % 5 AS city, {_place_sql('event_id')}, value, CAST(ts AS DATE) AS day,
        event_type AS category, props AS name FROM events""",
    "prices": f"""SELECT o_orderkey AS obs_id, o_custkey % 5 AS city, o_custkey % 50 AS community, o_orderpriority AS source,
        o_orderstatus AS stage, o_totalprice AS total, CAST(30 + o_orderkey % 120 AS DOUBLE) AS area,
        o_totalprice / CAST(30 + o_orderkey % 120 AS DOUBLE) AS price, CAST(o_orderdate AS DATE) AS day,
        {_place_sql('o_orderkey')} FROM orders""",
    "mpoints": "SELECT *, (lon - 116::DOUBLE) * 85000::DOUBLE AS x, (lat - 39.7::DOUBLE) * 111000::DOUBLE AS y FROM points",
    "munits": "SELECT *, (lon - 116::DOUBLE) * 85000::DOUBLE AS x, (lat - 39.7::DOUBLE) * 111000::DOUBLE AS y FROM units",
    "mprices": "SELECT *, (lon - 116::DOUBLE) * 85000::DOUBLE AS x, (lat - 39.7::DOUBLE) * 111000::DOUBLE AS y FROM prices",
}
