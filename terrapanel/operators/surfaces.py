"""Density surfaces, polygons, and name matching."""

from __future__ import annotations

import difflib
import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .counterfactual import normal_tail


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of blocked candidate pairs."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)


def normalize_community_name(name: Column) -> Column:
    """Compatibility form, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{N}]", "")


def match_names(pairs: DataFrame, left: str, margin: float = 0.04) -> DataFrame:
    """Best candidate of each left row from blocked pairs (left, right, name, rname, metres).

    Score 0.8 name ratio + 0.2 closeness; accepted at ratio 0.82 within 1,000 m or 0.72 within 300 m, unless the runner-up is
    within the margin.
    """
    scored = pairs.withColumn("ratio", name_ratio("name", "rname")).withColumn("score", 0.8 * F.col("ratio") + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("metres") / 1500.0))
    w = Window.partitionBy(left).orderBy(F.col("score").desc(), "right")
    best = scored.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("r = 1")
    accept = ((F.col("ratio") >= 0.82) & (F.col("metres") <= 1000)) | ((F.col("ratio") >= 0.72) & (F.col("metres") <= 300))
    clear = F.coalesce(F.col("score") - F.col("second") >= margin, F.lit(True))
    return best.select(left, "right", "ratio", "metres", F.when(~clear, "ambiguous").when(accept, "matched").otherwise("rejected").alias("status"))


def offsets(df: DataFrame, radius: int, keep_self: bool = False) -> DataFrame:
    """Each lattice cell (row, col) with every neighbour position (nrow, ncol) within ``radius`` cells (square window)."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    out = df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    out = out if keep_self else out.where("_i <> 0 or _j <> 0")
    return out.withColumn("nrow", F.col("row") + F.col("_i")).withColumn("ncol", F.col("col") + F.col("_j")).drop("_i", "_j")


def local_quadratic(surface: DataFrame, keys: list[str], sigmas: list[float], ridge: float = 1e-8) -> DataFrame:
    """Locally weighted quadratic fits of z at every cell: (keys, row, col, z, sigma, fit, lever, loo, mass) for every bandwidth.

    Gaussian weights of ``sigma`` cells, cut off at three of them along both axes, centred at the cell, so that the fit is the local
    intercept. ``loo`` is the fit without the cell itself (its part of the normal equations is known exactly), ``mass`` the sum of
    weights, ``lever`` the variance of the fit for a residual variance of one. Cells meet their neighbours by an equi-join; a cell
    has at most the window's number of them.
    """
    reach = math.ceil(3 * max(sigmas))
    other = surface.select(*keys, F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("z").cast("double").alias("nz"))
    near = offsets(surface.select(*keys, "row", "col", F.col("z").cast("double").alias("z")), reach, keep_self=True).join(other, [*keys, "nrow", "ncol"])
    lists = [F.collect_list(c.cast("double")).alias(n) for n, c in (("dr", F.col("nrow") - F.col("row")), ("dc", F.col("ncol") - F.col("col")), ("nz", F.col("nz")))]
    cells = near.groupBy(*keys, "row", "col", "z").agg(*lists)
    names = ["sigma", "fit", "lever", "loo", "mass"]

    def run(batches):
        for pdf in batches:
            out = []
            for i, (dr, dc, nz, z) in enumerate(zip(pdf["dr"], pdf["dc"], pdf["nz"], pdf["z"])):
                u, v, y = (np.asarray(x, float) for x in (dr, dc, nz))
                for sigma in sigmas:
                    w = np.exp(-(u * u + v * v) / (2 * sigma * sigma)) * (np.maximum(abs(u), abs(v)) <= 3 * sigma)
                    a, b = u / sigma, v / sigma
                    x = np.column_stack([np.ones(len(u)), a, b, a * a, b * b, a * b])
                    gram, right = (x * w[:, None]).T @ x + ridge * np.eye(6), (x * w[:, None]).T @ y
                    beta, own = np.linalg.solve(gram, np.column_stack([right, np.eye(6)[0]])).T
                    lever = own @ ((x * (w * w)[:, None]).T @ x) @ own
                    gram[0, 0] -= 1.0
                    right[0] -= z
                    loo = np.linalg.lstsq(gram, right, rcond=1e-12)[0][0]
                    out.append((i, sigma, beta[0], lever, loo, w.sum()))
            got = pd.DataFrame(out, columns=["i", *names])
            yield pd.concat([pdf[[*keys, "row", "col", "z"]].iloc[got["i"]].reset_index(drop=True), got[names]], axis=1)

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in [*keys, "row", "col", "z"])
    return cells.mapInPandas(run, kinds + ", sigma double, fit double, lever double, loo double, mass double")


def density_fit(surface: DataFrame, keys: list[str], sigmas: list[float], least_mass: float = 7.0) -> DataFrame:
    """The local quadratic fits of the bandwidth with the least leave-one-out error of each key (the smallest of ties), with
    ``variance`` of the fit from the local residual variance. Cells with a mass up to ``least_mass`` don't vote on the bandwidth;
    where none does, the largest bandwidth is taken."""
    fits = local_quadratic(surface, keys, sigmas).checkpoint()
    error = F.avg(F.when(F.col("mass") > least_mass, F.pow(F.col("loo") - F.col("z"), 2)))
    votes = fits.groupBy(*keys, "sigma").agg(error.alias("e")).groupBy(*keys).agg(F.min(F.when(F.col("e").isNotNull(), F.struct("e", "sigma"))).alias("m"))
    best = votes.select(*keys, F.coalesce(F.col("m.sigma"), F.lit(max(sigmas))).alias("sigma"))
    chosen = fits.join(best, [*keys, "sigma"])
    reach = math.ceil(3 * max(sigmas))
    other = chosen.select(*keys, F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.pow(F.col("z") - F.col("fit"), 2).alias("e2"))
    near = offsets(chosen.select(*keys, "row", "col", "sigma"), reach, keep_self=True).join(other, [*keys, "nrow", "ncol"])
    dr, dc = F.col("nrow") - F.col("row"), F.col("ncol") - F.col("col")
    w = F.when(F.greatest(F.abs(dr), F.abs(dc)) <= 3 * F.col("sigma"), F.exp(-(dr * dr + dc * dc) / (2 * F.col("sigma") * F.col("sigma")))).otherwise(0.0)
    s2 = near.groupBy(*keys, "row", "col").agg((F.sum(w * F.col("e2")) / F.greatest(F.sum(w) - 6, F.lit(1.0))).alias("s2"))
    return chosen.join(s2, [*keys, "row", "col"]).withColumn("variance", F.col("s2") * F.col("lever")).drop("s2")


def significant_peaks(fits: DataFrame, keys: list[str], radius: int, alpha: float = 0.05) -> DataFrame:
    """Peaks of the fitted surface with t and p against the mean of their neighbours, and Benjamini-Hochberg marks within keys.

    fits: as density_fit gives them. Cells without a neighbour are no peaks; where the variance is zero there is no test."""
    other = fits.select(*keys, F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("fit").alias("nfit"), F.col("variance").alias("nvar"))
    near = offsets(fits.select(*keys, "row", "col", "fit", "variance"), radius).join(other, [*keys, "nrow", "ncol"])
    g = near.groupBy(*keys, "row", "col", "fit", "variance").agg(F.max("nfit").alias("top"), F.avg("nfit").alias("mean"), F.avg("nvar").alias("mean_var"), F.count("*").alias("n"))
    t = F.try_divide(F.col("fit") - F.col("mean"), F.sqrt(F.col("variance") + F.col("mean_var")))
    found = g.where("fit >= top").withColumn("t", t).withColumn("p", F.when(F.col("t").isNotNull(), normal_tail(F.abs("t"))))
    return benjamini_hochberg(found, keys, "p", alpha).drop("top", "mean_var")


def peaks(surface: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Cells (value z) that no neighbour within the radius exceeds, with the neighbours' mean, count and variance."""
    near = offsets(surface, radius).join(surface.select(*keys, F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("z").alias("nz")), [*keys, "nrow", "ncol"])
    g = near.groupBy(*keys, "row", "col", "z").agg(F.max("nz").alias("top"), F.avg("nz").alias("mean"), F.count("*").alias("n"), F.coalesce(F.var_samp("nz"), F.lit(0.0)).alias("v"))
    return g.where("z >= top")


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, alpha: float) -> DataFrame:
    """Mark the p-values significant at false discovery rate alpha within keys."""
    n = F.count(p).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last()))
    cut = F.max(F.when(F.col(p) <= alpha * F.col("_r") / F.col("_n"), F.col(p))).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).withColumn("_r", rank).withColumn("significant", F.coalesce(F.col(p) <= cut, F.lit(False))).drop("_n", "_r")


def grow(surface: DataFrame, seeds: DataFrame, keys: list[str], radius: int, rounds: int = 50) -> DataFrame:
    """Cells of the 8-connected component of each seed (keys, seed, row, col) inside its square window; a round is checkpointed."""
    found = seeds.select(*keys, "seed", F.col("row").alias("srow"), F.col("col").alias("scol"), "row", "col")
    cells = surface.select(*keys, F.col("row").alias("nrow"), F.col("col").alias("ncol")).distinct()
    before = found.count()
    for _ in range(rounds):
        near = offsets(found, 1, keep_self=True).join(cells, [*keys, "nrow", "ncol"], "left_semi")
        near = near.where((F.abs(F.col("nrow") - F.col("srow")) <= radius) & (F.abs(F.col("ncol") - F.col("scol")) <= radius))
        found = near.select(*keys, "seed", "srow", "scol", F.col("nrow").alias("row"), F.col("ncol").alias("col")).distinct().checkpoint()
        now = found.count()
        if now == before:
            return found
        before = now
    raise RuntimeError(f"components aren't complete after {rounds} rounds")


def ring_area(ring: Column) -> Column:
    """Area of a closed or open ring of struct(x, y) by the shoelace formula."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def _area(ring: list) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def widened_hull(s: pd.Series, least: pd.Series, most: pd.Series, buffer: pd.Series) -> pd.Series:
    """Convex hull of an array of points whose area is within least..most, widened by ``buffer``; null otherwise."""
    turns = [k * 2 * math.pi / 64 for k in range(64)]

    def ring(points, low, high, wide):
        hull = _hull([(p["x"], p["y"]) for p in points])
        if len(hull) < 3 or not low <= _area(hull) <= high:
            return None
        around = [(x + wide * math.cos(t), y + wide * math.sin(t)) for x, y in hull for t in turns] if wide else hull
        return [{"x": x, "y": y} for x, y in _hull(around)]

    return pd.Series([ring(*row) for row in zip(s, least, most, buffer)], index=s.index, dtype=object)


def disc(x: Column, y: Column, radius: Column, segments: int = 64) -> Column:
    """Ring of a regular polygon inside the circle around (x, y)."""
    turn = lambda k: k * (2 * math.pi / segments)
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda k: F.struct((x + radius * F.cos(turn(k))).alias("x"), (y + radius * F.sin(turn(k))).alias("y")))


def robust_hulls(points: DataFrame, key: str, radius: float = 750.0, least: float = 500.0, most: float = 1e6, buffer: float = 20.0) -> DataFrame:
    """Rows (key, mx, my, n_points, ring): the hull of each key's different points (x, y) within ``radius`` of their median, widened
    by ``buffer``.

    ring is null where fewer than three points are near, or the hull's area is outside least..most. Of points with one x only the lowest and
    the highest can be corners, so what meets in one row has at most two points for each x of the circle: all points count,
    and for rounded coordinates the row's size doesn't grow with them. Rows with a null key or coordinate are left out.
    """
    p = points.select(key, "x", "y").dropna().distinct()
    middle = p.groupBy(key).agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    near = p.join(middle, key).withColumn("near", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")) <= radius)
    ends = near.where("near").groupBy(key, "x").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n"))
    corners = F.flatten(F.collect_list(F.array(*[F.struct("x", F.col(c).alias("y")) for c in ("low", "high")])))
    h = ends.groupBy(key).agg(corners.alias("ps"), F.sum("n").alias("n"))
    h = h.select(key, F.col("n").alias("n_points"), widened_hull("ps", F.lit(least), F.lit(most), F.lit(buffer)).alias("ring"))
    return middle.join(h, key, "left").select(key, "mx", "my", F.coalesce("n_points", F.lit(0).cast("long")).alias("n_points"), "ring")


def hulls_or_discs(hulls: DataFrame, group: str, known: DataFrame | None = None, default: float = 250.0) -> DataFrame:
    """robust_hulls with a disc around the median where there is no ring; adds source.

    Its radius is that of a circle with the median area of the group's known boundaries (rows group, area), within 150 to 500; or
    ``default`` where the group has none.
    """
    known = known if known is not None else hulls.where("ring is not null").select(group, ring_area(F.col("ring")).alias("area"))
    size = known.groupBy(group).agg(F.median("area").alias("area"))
    fitted = F.when(F.col("area").isNotNull(), F.least(F.greatest(F.sqrt(F.col("area") / math.pi), F.lit(150.0)), F.lit(500.0)))
    j = hulls.join(size, group, "left").withColumn("made", disc(F.col("mx"), F.col("my"), F.coalesce(fitted, F.lit(default))))
    source = F.when(F.col("ring").isNotNull(), "hull").when(F.col("area").isNotNull(), "calibrated_disc").otherwise("default_disc")
    return j.withColumn("source", source).withColumn("ring", F.coalesce("ring", "made")).drop("made", "area")


def _clip(ring: list, x0: float, y0: float, x1: float, y1: float) -> float:
    """Area of a ring inside a rectangle (Sutherland-Hodgman)."""
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ia, ib = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ia != ib:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cut = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                out += [cut, b] if ib else [cut]
            elif ib:
                out.append(b)
        ring = out
        if not ring:
            return 0.0
    return _area(ring)


@F.pandas_udf(T.DoubleType())
def clipped_area(ring: pd.Series, x0: pd.Series, y0: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([_clip([(p["x"], p["y"]) for p in r], x, y, x + k, y + k) for r, x, y, k in zip(ring, x0, y0, size)], dtype=float)


def cell_shares(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """Area shares of each polygon (key, ring) over the lattice cells it meets; shares of a polygon sum to 1."""
    lo = lambda c: F.floor(F.array_min(F.transform("ring", lambda p: p[c])) / size).cast("int")
    hi = lambda c: F.floor(F.array_max(F.transform("ring", lambda p: p[c])) / size).cast("int")
    cells = polygons.withColumn("col", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("row", F.explode(F.sequence(lo("y"), hi("y"))))
    area = clipped_area("ring", F.col("col") * size, F.col("row") * size, F.lit(size))
    out = cells.withColumn("area", area).where("area > 0").drop("ring")
    return out.withColumn("share", F.col("area") / F.sum("area").over(Window.partitionBy(key)))


def segment_lengths(segments: DataFrame, size: float) -> DataFrame:
    """Length of segments (x, y, x2, y2) in each cell: cut at lattice lines, each piece goes to the cell of its midpoint."""
    cuts = lambda a, b: F.transform(
        F.when(F.floor(F.least(a, b) / size) < F.floor(F.greatest(a, b) / size), F.sequence(F.floor(F.least(a, b) / size) + 1, F.floor(F.greatest(a, b) / size))).otherwise(F.array().cast("array<bigint>")),
        lambda k: (k * size - a) / (b - a),
    )
    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts(F.col("x"), F.col("x2")), cuts(F.col("y"), F.col("y2")))))
    pieces = segments.withColumn("_t", t).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_t") - 1)))
    a, b = F.element_at("_t", F.col("_k")), F.element_at("_t", F.col("_k") + 1)
    mid = lambda p, q: F.floor((F.col(p) + (F.col(q) - F.col(p)) * (a + b) / 2) / size).cast("int")
    length = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")) * (b - a)
    return pieces.select(mid("x", "x2").alias("col"), mid("y", "y2").alias("row"), length.alias("length"))
