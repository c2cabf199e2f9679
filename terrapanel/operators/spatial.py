"""Spatial, temporal and relational joins. Distances meet through lattice buckets, never through a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EARTH = 6371008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def grid(df: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """Lattice cells over the extent of points x, y (for each key), with corners and centre."""
    lo = lambda f, c: F.floor(f(c) / size).cast("int")
    box = df.groupBy(*(keys or [])).agg(
        lo(F.min, "x").alias("c0"), lo(F.max, "x").alias("c1"), lo(F.min, "y").alias("r0"), lo(F.max, "y").alias("r1")
    )
    cells = box.withColumn("col", F.explode(F.sequence("c0", "c1"))).withColumn("row", F.explode(F.sequence("r0", "r1")))
    out = cells.select(*(keys or []), "col", "row", (F.col("col") * size).alias("xmin"), (F.col("row") * size).alias("ymin"))
    return out.withColumn("grid_id", F.concat(F.lit("g"), "row", F.lit("x"), "col")).withColumn("cx", F.col("xmin") + size / 2).withColumn("cy", F.col("ymin") + size / 2)


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon of few fixed vertices (ray casting)."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        at = (y - y1) * (x2 - x1) / (y2 - y1) + x1
        crossings = crossings + (((y >= min(y1, y2)) & (y < max(y1, y2)) & (x < at)).cast("int"))
    return crossings % 2 == 1


def segment_distance(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Distance of a point from the nearest edge of a polygon."""
    parts = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = x2 - x1, y2 - y1
        t = F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
        parts.append(F.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return F.least(*parts)


def _bucket(df: DataFrame, size: float, prefix: str = "_") -> DataFrame:
    return df.withColumn(f"{prefix}c", F.floor(F.col("x") / size)).withColumn(f"{prefix}r", F.floor(F.col("y") / size))


def within(left: DataFrame, right: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs at most ``radius`` apart: left has x, y; right has rx, ry. The right side stands in the 9 buckets around it."""
    steps = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as i, j as j))))"))
    spread = right.withColumn("x", F.col("rx")).withColumn("y", F.col("ry"))
    spread = _bucket(spread, radius).drop("x", "y").withColumn("_s", steps)
    spread = spread.withColumn("_c", F.col("_c") + F.col("_s.i")).withColumn("_r", F.col("_r") + F.col("_s.j")).drop("_s")
    joined = _bucket(left, radius).join(spread, ["_c", "_r", *(keys or [])])
    return joined.withColumn("distance", F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))).where(F.col("distance") <= radius).drop("_c", "_r")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, right_id: str, keys: list[str] | None = None, most: int = 16) -> DataFrame:
    """Rows of left (x, y) with ``right_id`` and ``distance`` of the nearest right row (rx, ry) of equal keys within the radius; ties go to
    the smaller id, rows without one are dropped.

    Right places are listed by buckets with their 3 x 3 neighbourhood, so that a left row meets one list and no pairs are made. Buckets
    start so narrow that none holds more than ``most`` places (at the least, a 2^20th of the radius); rows that have nothing nearer than
    a bucket's side go on to buckets twice as wide, up to the radius.
    """
    keys = keys or []
    places = right.groupBy(*keys, "rx", "ry").agg(F.min(right_id).alias(right_id)).checkpoint()
    side = F.lit(float(radius)) / F.pow(F.lit(2.0), "level")
    levels = places.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(20)))).groupBy("level", *keys, F.floor(F.col("rx") / side).alias("_c"), F.floor(F.col("ry") / side).alias("_r")).count()
    crowds = dict(map(tuple, levels.groupBy("level").agg(F.max("count")).collect()))
    level = next((k for k in sorted(crowds) if crowds[k] <= most), 20)
    around = F.expr("explode(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as i, j as j)))))").alias("_s")
    away = lambda p: F.sqrt((F.col("x") - p["rx"]) * (F.col("x") - p["rx"]) + (F.col("y") - p["ry"]) * (F.col("y") - p["ry"]))
    out, rest = None, left
    for k in range(level, -1, -1):
        size = radius / 2**k
        lists = _bucket(places.withColumn("x", F.col("rx")).withColumn("y", F.col("ry")), size).select("*", around)
        lists = lists.groupBy(*keys, (F.col("_c") + F.col("_s.i")).alias("_c"), (F.col("_r") + F.col("_s.j")).alias("_r")).agg(F.collect_list(F.struct("rx", "ry", right_id)).alias("_near"))
        found = _bucket(rest, size).join(lists, [*keys, "_c", "_r"], "left")
        found = found.withColumn("_m", F.array_min(F.transform("_near", lambda p: F.struct(away(p).alias("distance"), p[right_id].alias(right_id))))).select(*left.columns, "_m")
        # Whatever is nearer than a bucket's side stands in the neighbourhood; the last buckets are as wide as the radius.
        near = F.coalesce(F.col("_m.distance") < size * (1 - 1e-9), F.lit(False))
        if k:
            found = found.checkpoint()
            rest = found.where(~near).drop("_m")
            found = found.where(near)
        found = found.where(F.col("_m.distance") <= radius).select(*left.columns, "_m.*")
        out = found if out is None else out.unionByName(found)
    return out


def rectangle_distance(x: Column, y: Column, cx: Column, cy: Column, half: float) -> Column:
    """Distance of a point from the nearest point of a square cell."""
    gap = lambda a, b: F.greatest(F.abs(a - b) - half, F.lit(0.0))
    return F.hypot(gap(x, cx), gap(y, cy))


def touching_cells(df: DataFrame, size: float) -> DataFrame:
    """One row for each closed cell that holds the point (several on a shared edge)."""

    def along(v):
        k = F.floor(v / size)
        return F.when(v == k * size, F.array(k - 1, k)).otherwise(F.array(k))

    return df.withColumn("col", F.explode(along(F.col("x")))).withColumn("row", F.explode(along(F.col("y"))))


def join_validated(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Left join that fails at run time where the right side has a key twice, or where other columns share a name."""
    clash = set(left.columns) & set(right.columns) - set(keys)
    if clash:
        raise ValueError(f"ambiguous columns: {sorted(clash)}")
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = right.withColumn("_n", n).where(F.coalesce(F.assert_true(F.col("_n") == 1, "right keys are not unique").isNull(), F.lit(True))).drop("_n")
    return left.join(checked, keys, how)


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: keys only in either side, and whether the two sets are equal."""
    a = left.distinct().withColumn("_l", F.lit(1)).join(right.distinct().withColumn("_r", F.lit(1)), left.columns, "full")
    return a.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right")).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0)
    )


def skeleton(units: DataFrame, parts: DataFrame) -> DataFrame:
    """Every unit with every row of a small table of fixed size."""
    return units.crossJoin(F.broadcast(parts))


def lags(units: DataFrame, features: DataFrame, key: str, start: str, t: str, values: list[str], steps: list[int]) -> DataFrame:
    """Feature values at start - lag for positive lags, one column a value and lag, with availability flags."""
    if min(steps) < 1:
        raise ValueError("lags must be positive")
    wide = units.select(key, start).join(features, key).withColumn("_lag", F.col(start) - F.col(t)).where(F.col("_lag").isin(steps))
    cols = [F.max(F.when(F.col("_lag") == k, F.col(v))).alias(f"{v}_lag{k}") for v in values for k in steps]
    out = units.select(key).join(wide.groupBy(key).agg(*cols), key, "left")
    for v in values:
        out = out.withColumn(f"{v}_available", F.lit(True))
        for k in steps:
            out = out.withColumn(f"{v}_available", F.col(f"{v}_available") & F.col(f"{v}_lag{k}").isNotNull())
    return out


def shortest_paths(edges: DataFrame, limit: float, rounds: int = 50) -> DataFrame:
    """Rows (src, dst, km) of the shortest paths of at most ``limit``; edges are (src, dst, km), each way.

    Repeated min-plus steps; every round is checkpointed to the shared folder.
    """
    paths = edges.groupBy("src", "dst").agg(F.min("km").alias("km"))
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("km").alias("more"))
    before = None
    for _ in range(rounds):
        longer = paths.join(step, "dst").where(F.col("to") != F.col("src")).select("src", F.col("to").alias("dst"), (F.col("km") + F.col("more")).alias("km"))
        paths = paths.unionByName(longer.where(F.col("km") <= limit)).groupBy("src", "dst").agg(F.min("km").alias("km")).checkpoint()
        state = paths.agg(F.count("*"), F.round(F.sum("km"), 6)).first()
        if state == before:
            return paths
        before = state
    raise RuntimeError(f"shortest paths aren't settled after {rounds} steps")
