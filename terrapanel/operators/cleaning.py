"""Typing, text parsing, flags and time fields: row-wise operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite_or_null(x: Column) -> Column:
    """Numeric value of x; null where it isn't a finite number."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def log_count(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def asinh(x: Column) -> Column:
    return F.asinh(x)


def log_price(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of rows and, for each rule, of rows that break it (null counts as broken)."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.coalesce(r, F.lit(False))).alias(f"bad_{n}") for n, r in rules.items()])


def coordinate_filter(df: DataFrame, lon: str, lat: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    x, y = finite_or_null(F.col(lon)), finite_or_null(F.col(lat))
    return df.where(x.between(bounds[0], bounds[2]) & y.between(bounds[1], bounds[3]))


def parse_number(text: Column) -> Column:
    """First number in a text; thousands separators are ignored."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def parse_point(text: Column) -> Column:
    """struct(lon, lat) of POINT(lon lat); null parts where the text is something else."""
    pattern = r"(?i)^\s*POINT\s*\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    return F.struct(part(1).alias("lon"), part(2).alias("lat"))


def parse_vertices(text: Column) -> Column:
    """Array of struct(lon, lat) of lon,lat;lon,lat lists."""
    pair = F.filter(F.split(text, ";"), lambda x: F.size(F.split(x, ",")) == 2)
    number = lambda x, k: F.trim(F.element_at(F.split(x, ","), k)).try_cast("double")
    return F.transform(pair, lambda x: F.struct(number(x, 1).alias("lon"), number(x, 2).alias("lat")))


def parse_month(text: Column) -> Column:
    """yyyy-MM of a month token such as 2020-1, 2020.01 or 202001; null where there is none."""
    pattern = r"(\d{4})\D?(\d{1,2})"
    month = F.regexp_extract(text, pattern, 2).try_cast("int")
    return F.when(month.between(1, 12), F.concat_ws("-", F.regexp_extract(text, pattern, 1), F.lpad(month.cast("string"), 2, "0")))


def normalize_station_name(name: Column) -> Column:
    """Matching key of a station name: bracketed parts, dots, dashes, endings and blanks go; lower case."""
    # Optional ending before a bracket, brackets, separators, endings.
    t = F.trim(F.coalesce(name, F.lit("")))
    t = F.regexp_replace(t, "站?[（(][^）)]*[）)]", "")
    t = F.regexp_replace(t, "[（）()·-]", "")
    t = F.regexp_replace(F.regexp_replace(t, "站$", ""), "路$", "")
    return F.lower(F.regexp_replace(t, r"\s+", ""))


def lookup(value: Column, mapping: dict[str, str], default: str) -> Column:
    """Value of a small fixed mapping, for trimmed keys."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.trim(value)), F.lit(default))


def keyword_flag(text: Column, words: list[str]) -> Column:
    """1 where any word occurs, whatever the case; null text counts as none."""
    found = [F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w.lower())) for w in words]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out.cast("int")


def poi_normalize(df: DataFrame, categories: dict[str, str], chains: list[str], commercial: list[str], community: list[str]) -> DataFrame:
    """Rows with category and the three flags; community commerce needs a shop-like category and a keyword."""
    out = df.withColumn("category", lookup(F.col("raw_category"), categories, "other"))
    shop = F.col("category").isin(commercial[:3]).cast("int")
    return (
        out.withColumn("is_commercial", F.col("category").isin(commercial).cast("int"))
        .withColumn("is_chain", keyword_flag(F.col("name"), chains))
        .withColumn("is_community_commerce", shop * keyword_flag(F.col("name"), community))
    )


def flags(rules: dict[str, Column]) -> Column:
    """Semicolon list of the rules that hold, in their order."""
    return F.array_join(F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()])), ";")


def repeated(df: DataFrame, keys: list[str], where: Column, name: str) -> DataFrame:
    """Mark the rows whose key occurs more than once among the rows for which ``where`` holds."""
    n = F.count(F.when(where, 1)).over(Window.partitionBy(*keys))
    return df.withColumn(name, where & (n > 1))


def append_flag(old: Column, hit: Column, flag: str) -> Column:
    return F.when(hit, F.concat_ws(";", F.when(old != "", old), F.lit(flag))).otherwise(old)


def flag_union(*lists: Column) -> Column:
    """Sorted, distinct union of semicolon lists."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(x, F.lit("")), ";") for x in lists]))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))), ";")


def derive_unit_price(unit: Column, total: Column, area: Column) -> Column:
    """Unit price, filled from total / area; relative difference of a given one from the derived one beside it."""
    derived = F.try_divide(total, area)
    return F.struct(F.coalesce(unit, derived).alias("price"), F.try_divide(F.abs(unit - derived), derived).alias("error"))


def stable_id(*parts: Column, size: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def time_fields(df: DataFrame, day: str, precision: str) -> DataFrame:
    """Month, quarter and year keys that are no finer than the stated precision."""
    p, x = F.col(precision), F.col(day)
    return (
        df.withColumn("observed_year", F.year(x))
        .withColumn("observed_month", F.when(p.isin("day", "month", "snapshot_month"), F.trunc(x, "MM")))
        .withColumn("observed_quarter", F.when(p.isin("day", "month", "snapshot_month", "quarter"), quarter_label(x)))
    )


def eligibility(price: Column, located: Column, canonical: Column, key: Column) -> Column:
    """Whether an observation may enter a panel of the period named by ``key``."""
    ok = finite_or_null(price)
    return F.coalesce(ok > 0, F.lit(False)) & F.coalesce(located, F.lit(False)) & F.coalesce(canonical, F.lit(False)) & key.isNotNull()


def wide_to_long(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def lifecycle(df: DataFrame, listed: str, sold: str, list_price: str, sold_price: str) -> DataFrame:
    """A record as a transaction row and a listing row; no listing where it was sold in the month it was listed."""
    keep = [c for c in df.columns if c not in (listed, sold, list_price, sold_price)]
    deal = df.where(F.col(sold).isNotNull()).select(*keep, F.lit("transaction").alias("stage"), F.col(sold).alias("day"), F.col(sold_price).alias("price"))
    same = F.coalesce(F.trunc(listed, "MM") == F.trunc(sold, "MM"), F.lit(False))
    offer = df.where(F.col(listed).isNotNull() & ~same)
    return deal.unionByName(offer.select(*keep, F.lit("listing").alias("stage"), F.col(listed).alias("day"), F.col(list_price).alias("price")))


def not_planned(df: DataFrame, status: str, year: str, words: list[str], last_year: int) -> DataFrame:
    """Drop rows whose status names a planned object or whose year lies in the future."""
    y = F.col(year).try_cast("int")
    return df.where((keyword_flag(F.col(status), words) == 0) & F.coalesce(y <= last_year, F.lit(True)))


def event_phase(t: Column, reference: int) -> Column:
    return F.when(t.isNull(), "unknown").when(t == reference, "reference").when(t < 0, "pre").when(t == 0, "t0").otherwise("post")


# Geographic transforms as closed column arithmetic. Ellipsoid and offset constants.
_A, _EE = 6378245.0, 0.00669342162296594323


def _offset_lat(x: Column, y: Column) -> Column:
    pi = F.lit(3.141592653589793)
    s = lambda v, k: F.sin(v * pi * F.lit(k))
    out = F.lit(-100.0) + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x))
    out += (20.0 * s(x, 6.0) + 20.0 * s(x, 2.0)) * 2.0 / 3.0
    out += (20.0 * s(y, 1.0) + 40.0 * s(y, 1 / 3)) * 2.0 / 3.0
    return out + (160.0 * s(y, 1 / 12) + 320.0 * s(y, 1 / 30)) * 2.0 / 3.0


def _offset_lon(x: Column, y: Column) -> Column:
    pi = F.lit(3.141592653589793)
    s = lambda v, k: F.sin(v * pi * F.lit(k))
    out = F.lit(300.0) + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x))
    out += (20.0 * s(x, 6.0) + 20.0 * s(x, 2.0)) * 2.0 / 3.0
    out += (20.0 * s(x, 1.0) + 40.0 * s(x, 1 / 3)) * 2.0 / 3.0
    return out + (150.0 * s(x, 1 / 12) + 300.0 * s(x, 1 / 30)) * 2.0 / 3.0


def gcj02_to_wgs84(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Add wgs_lon and wgs_lat: one step of the shifted-datum inverse."""
    x, y = F.col(lon) - 105.0, F.col(lat) - 35.0
    rad = F.radians(F.col(lat))
    magic = 1 - _EE * F.sin(rad) * F.sin(rad)
    dlat = _offset_lat(x, y) * 180.0 / ((_A * (1 - _EE)) / (magic * F.sqrt(magic)) * 3.141592653589793)
    dlon = _offset_lon(x, y) * 180.0 / (_A / F.sqrt(magic) * F.cos(rad) * 3.141592653589793)
    return df.withColumn("wgs_lon", F.col(lon) - dlon).withColumn("wgs_lat", F.col(lat) - dlat)


def project_utm(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Add utm_zone, utm_x and utm_y (northern hemisphere) by the third-order Krüger series on WGS84."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
        13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4,
        49561 / 161280 * n**4,
    )
    e = 2 * n**0.5 / (1 + n)
    zone = F.floor((F.col(lon) + 180) / 6).cast("int") + 1
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon) - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return df.withColumn("utm_zone", zone).withColumn("utm_x", 500000.0 + k0 * radius * east).withColumn("utm_y", k0 * radius * north)
