"""Small fixtures for the panel, spatial and estimation operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import cleaning as C
from terrapanel.operators import counterfactual as K
from terrapanel.operators import estimators as E
from terrapanel.operators import evaluation as V
from terrapanel.operators import lowrank as L
from terrapanel.operators import panels as P
from terrapanel.operators import sampling as A
from terrapanel.operators import spatial as S
from terrapanel.operators import studies as D
from terrapanel.operators import surfaces as U
from terrapanel.operators.matching import candidates


def one(df):
    return df.first()[0]


def test_matching_att_reproduces_the_frozen_example(spark):
    x1 = [-0.8, -0.4, 0, 0.4, 0.8, -2, -1, -0.5, -0.1, 0.2, 0.6, 1, 2]
    x2 = [-0.6, 0.4, 0, -0.4, 0.6, -2, -0.5, 0.5, 0.1, -0.2, 0.4, 1, -1.5]
    noise = [0.10, -0.05, 0.02, 0.08, -0.03, -0.04, 0.03, -0.02, 0.01, -0.01, 0.04, -0.05, 0.02]
    rows = [(i, float(a), float(b), i < 5, 1 + 0.7 * a - 0.3 * b + 2 * (i < 5) + e) for i, (a, b, e) in enumerate(zip(x1, x2, noise))]
    got = E.abadie_imbens(spark.createDataFrame(rows, "id long, x1 double, x2 double, t boolean, y double"), "y", "t", ["x1", "x2"])
    assert abs(got["estimate"] - 2.0106058394160584) < 1e-9
    assert abs(got["se"] - 0.025602767545806086) < 1e-9
    assert abs(got["unadjusted"] - 2.144) < 1e-9


def test_matching_att_reads_once_and_opens_no_copies(spark, monkeypatch):
    rng = np.random.default_rng(1)
    copies = rng.integers(1, 6, size=60)
    x, t = np.repeat(rng.normal(size=(60, 2)), copies, 0), np.repeat(rng.random(60) < 0.3, copies)
    y = 50 + x @ [0.7, -0.3] + 2 * t + rng.normal(size=len(x)) * 0.1
    w = x / x.std(0, ddof=1)
    # Whitened distances as the operator takes them: d' C^-1 d with the correlations of the scaled covariates.
    d = w[:, None] - w[None, :]
    d2 = np.einsum("abi,ij,abj->ab", d, np.linalg.inv(np.corrcoef(x.T)), d)
    np.fill_diagonal(d2, np.inf)
    link = lambda a, b: (lambda m: m / m.sum(1, keepdims=True))((d2[np.ix_(a, b)] <= d2[np.ix_(a, b)].min(1, keepdims=True) + 1e-10).astype(float))
    m, same = link(t, ~t), link(~t, ~t)
    k, z = m.sum(0), np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(z[~t] * np.sqrt(k)[:, None], y[~t] * np.sqrt(k), rcond=None)[0]
    left = y - z @ beta
    each = left[t] - m @ left[~t]
    j = 1 / same.max(1)
    s2 = j / (j + 1) * (y[~t] - same @ y[~t]) ** 2
    variance = (((each - each.mean()) ** 2).sum() + (s2 * (k**2 - (m**2).sum(0))).sum()) / t.sum() ** 2
    read, asked = spark.sparkContext.accumulator(0), []

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    search = E.top_k_ties
    monkeypatch.setattr(E, "top_k_ties", lambda targets, *rest, **more: (asked.append(targets.count()), search(targets, *rest, **more))[1])
    rows = [(i, float(a), float(b), bool(c), float(v)) for i, ((a, b), c, v) in enumerate(zip(x, t, y))]
    kind = "id long, x1 double, x2 double, t boolean, y double"
    got = E.abadie_imbens(spark.createDataFrame(rows, kind).mapInPandas(count, kind), "y", "t", ["x1", "x2"])
    assert abs(got["estimate"] - each.mean()) < 1e-9 and abs(got["unadjusted"] - (y[t] - m @ y[~t]).mean()) < 1e-9
    assert abs(got["se"] - variance**0.5) < 1e-9 and got["n_treated"] == t.sum()
    assert read.value == len(rows) and sum(asked) <= 60


def test_event_study_recovers_planted_effects(spark):
    rng = np.random.default_rng(3)
    rows = []
    for pair in range(12):
        start = 2010 + pair % 4
        for role in (1, 0):
            level = rng.normal()
            for year in range(2005, 2018):
                t = year - start
                if -3 <= t <= 2:
                    effect = role * {0: 0.5, 1: 1.25, 2: 2.0}.get(t, 0.0)
                    rows.append((pair * 2 + role, year, t if role else None, level + 0.1 * year + effect))
    df = spark.createDataFrame(rows, "unit long, period int, t int, y double")
    got = {t: b for t, b, _, _ in E.event_study(df, "y", "unit", "period", "t", "unit")}
    assert all(abs(got[t] - v) < 0.02 for t, v in {-3: 0, -2: 0, 0: 0.5, 1: 1.25, 2: 2.0}.items())


def test_tails():
    assert abs(E.t_p_value(2.0, 10) - 0.0733880348) < 1e-9
    assert abs(E.f_p_value(3.0, 2, 20) - 0.0725381503) < 1e-9


def test_entropy_and_source_balance(spark):
    df = spark.createDataFrame([(10, 0, 0, 0), (1, 1, 1, 1)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(P.entropy([F.col(c) for c in "abcd"])).collect()]
    assert abs(got[0]) < 1e-12 and abs(got[1] - math.log(4)) < 1e-12
    rows = [(1, "a", 10000.0)] * 100 + [(1, "b", 40000.0)]
    out = P.source_balanced(spark.createDataFrame(rows, "cell int, source string, price double"), ["cell"], "source", "price").first()
    assert abs(math.exp(out["log_raw"]) - 10000) < 1e-6 and abs(math.exp(out["log_balanced"]) - 20000) < 1e-6


@pytest.mark.parametrize("bounds", [{}, {"per_pivot": 5, "chunk": 7, "part": 3}, {"per_pivot": 400}, {"most_pivots": 2, "per_pivot": 1}])
def test_nearest_by_cells_equals_all_pairs(spark, bounds):
    rng = np.random.default_rng(9)
    # Clusters, many points at one place, points on a coarse grid (ties), a block with one donor, a block without any.
    v = np.concatenate([rng.normal(size=(80, 2)), np.round(rng.normal(size=(80, 2)) * 2), np.zeros((60, 2)), rng.normal(size=(30, 2)) * 0.01 + 5])
    donors = [(i, i % 3, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, 7, [0.0, 0.0]), (1001, None, [0.0, 0.0]), (1002, 1, None)]
    w = np.concatenate([v[::4], rng.normal(size=(20, 2)) * 4])
    targets = [(4 * i if i < len(v[::4]) else 2000 + i, i % 3, [float(x) for x in r]) for i, r in enumerate(w)] + [(3000, 7, [1.0, 1.0]), (3001, 8, [1.0, 1.0]), (3002, 1, None)]
    t = spark.createDataFrame(targets, "target long, block int, w array<double>").repartition(3)
    c = spark.createDataFrame(donors, "donor long, block int, v array<double>").repartition(3)
    pairs = {}
    for a, block, x in targets:
        if x and block is not None:
            pairs[a] = sorted(((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2, b) for b, other, y in donors if other == block and y and a != b)
    got = [(r["target"], r["rank"], r["d2"], r["donor"]) for r in E.top_k(t, c, "block", 3, **bounds).collect()]
    assert sorted(got) == sorted((a, k + 1, *p) for a, of in pairs.items() for k, p in enumerate(of[:3]))
    ties = [(r["target"], r["d2"], r["donor"]) for r in E.top_k_ties(t, c, "block", 2, **bounds).collect()]
    assert sorted(ties) == sorted((a, *p) for a, of in pairs.items() if len(of) > 1 for p in of if p[0] <= of[1][0] + 1e-10)
    assert E.top_k(t, c.limit(0), "block", 3).count() == 0


def test_ties_beyond_k_stay_in_their_task(spark):
    t = spark.createDataFrame([(k, 0, [0.0]) for k in range(5)], "target long, block int, w array<double>")
    c = spark.createDataFrame([(100 + k, 0, [1.0]) for k in range(200)], "donor long, block int, v array<double>")
    assert candidates(t, c, "block", 3, 0.0, False).count() == 15
    assert sorted(tuple(r) for r in E.top_k(t, c, "block", 3).select("target", "donor", "rank").collect()) == [(k, 100 + n, n + 1) for k in range(5) for n in range(3)]


def test_flags_and_station_names(spark):
    df = spark.createDataFrame([("b;a", "a;c", "")], "x string, y string, z string")
    assert one(df.select(C.flag_union(F.col("x"), F.col("y"), F.col("z")))) == "a;b;c"
    assert one(df.select(C.normalize_station_name(F.lit(" 人民-广场站（2号口） ")))) == "人民广场"
    assert one(df.select(C.finite_or_null(F.lit("inf")))) is None


def test_annual_dates_keep_no_month(spark):
    df = spark.createDataFrame([("2020-05-01", "year"), ("2020-05-01", "day")], "d string, p string").withColumn("d", F.col("d").cast("date"))
    rows = C.time_fields(df, "d", "p").collect()
    assert rows[0]["observed_month"] is None and rows[0]["observed_quarter"] is None and rows[0]["observed_year"] == 2020
    assert rows[1]["observed_quarter"] == "2020Q2"


def test_radius_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3000, 3000, (80, 2)))]
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3000, 3000, (60, 2)))]
    got = S.within(spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, rx double, ry double"), 500.0)
    want = {(i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 500}
    assert {(r["i"], r["j"]) for r in got.collect()} == want


@pytest.mark.parametrize("most", [1, 3, 16])
def test_nearest_within_equals_all_pairs(spark, most):
    rng = np.random.default_rng(4)
    # Spread and crowded places, two units at one place, ties on a lattice, rows without anything near.
    xy = np.concatenate([rng.uniform(-3000, 3000, (60, 2)), rng.normal(0, 2, (60, 2)), np.round(rng.uniform(-10, 10, (40, 2))) * 100])
    units = [(i, i % 2, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([xy, xy[:5]]))]
    at = np.concatenate([rng.uniform(-4500, 4500, (80, 2)), rng.normal(0, 3, (40, 2)), np.round(rng.uniform(-10, 10, (40, 2))) * 100 + 50])
    points = [(i, i % 2, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(900, 0, None, 1.0), (901, 5, 0.0, 0.0)]
    want = {}
    for i, city, x, y in points:
        near = [(math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, c, u, v in units if c == city] if x is not None else []
        if near and min(near)[0] <= 700.0:
            want[i] = min(near)
    right = spark.createDataFrame(units, "unit long, city int, rx double, ry double")
    got = S.nearest_within(spark.createDataFrame(points, "i long, city int, x double, y double").repartition(3), right, 700.0, "unit", ["city"], most)
    assert {r["i"]: (r["distance"], r["unit"]) for r in got.collect()} == want and 0 < len(want) < len(points)


def test_blocks_of_vectors_give_the_nearest_with_ties_by_id(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(70, 6))
    v = np.concatenate([v, v, v[:30], np.zeros((1, 6))])
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>").select("id", V.unit_norm(F.col("v")).alias("v")).repartition(3).checkpoint()
    unit = [r["v"] for r in rows.orderBy("id").collect()]
    assert np.allclose(unit, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300))
    want = {}
    for a in range(0, len(v), 5):
        exact = []
        for b in range(len(v)):
            total = 0.0
            for x, y in zip(unit[a], unit[b]):
                total += x * y
            exact.append((-total, b))
        want[a] = [(b, -c) for c, b in sorted(x for x in exact if x[1] != a)[:4]]
    pool = rows.select(F.col("id").alias("pid"), F.col("v").alias("pv"))
    for sizes in ({}, {"query_size": 7, "pool_size": 20}, {"query_size": 1, "pool_size": 3}):
        got = {}
        for r in V.nearest(rows.where("id % 5 = 0"), pool, 4, **sizes).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["pid"], r["cosine"]))
        assert got == want


def test_masked_correlations_by_blocks(spark):
    rng = np.random.default_rng(10)
    y = rng.normal(size=(40, 8)) + 1e4
    y[rng.random(y.shape) < 0.4] = np.nan
    y[3], y[4], y[5] = np.nan, 2.5, [1.0, 2.0, *[np.nan] * 6]
    df = spark.createDataFrame([(i, [None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(y)], "unit long, v array<double>")
    left = df.where("unit % 4 = 0").selectExpr("unit AS a", "v AS x")
    rows = V.masked_correlations(left, df.selectExpr("unit AS b", "v AS y"), 3, left_size=3, right_size=9).collect()
    got = {(r["a"], r["b"]): r["r"] for r in rows}
    both = {(a, b): np.isfinite(y[a]) & np.isfinite(y[b]) for a in range(0, 40, 4) for b in range(40)}
    assert len(rows) == len(got) and set(got) == {k for k, m in both.items() if m.any()}
    for (a, b), m in both.items():
        if m.any():
            known = m.sum() >= 3 and np.ptp(y[a][m]) > 0 and np.ptp(y[b][m]) > 0
            assert got[a, b] == pytest.approx(np.corrcoef(y[a][m], y[b][m])[0, 1], abs=1e-7) if known else math.isnan(got[a, b])


def test_rectangle_distance(spark):
    df = spark.createDataFrame([(250.0, 250.0, 250.0, 250.0), (250.0, 250.0, 1400.0, 250.0)], "x double, y double, cx double, cy double")
    got = [r[0] for r in df.select(S.rectangle_distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), 250.0)).collect()]
    assert got == [0.0, 900.0]


def test_quantile_folds_and_auc(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    assert abs(one(df.agg(E.type8(F.collect_list("v"), 0.5))) - 5.5) < 1e-12
    sizes = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 2)], "g string, n long")
    assert dict(A.balanced_folds(sizes, "g", "n", 2)) == {"a": 0, "b": 1, "c": 1, "d": 0}
    auc = V.rank_auc(spark.createDataFrame([(1, 0.1, 0), (1, 0.4, 0), (1, 0.4, 1), (1, 0.8, 1)], "k int, s double, y int"), ["k"], "s", "y")
    assert abs(auc.first()["auc"] - 0.875) < 1e-12


def test_utm_of_a_central_meridian(spark):
    r = C.project_utm(spark.createDataFrame([(117.0, 0.0), (117.0, 40.0)], "lon double, lat double"), "lon", "lat").collect()
    assert r[0]["utm_zone"] == 50 and abs(r[0]["utm_x"] - 500000) < 1e-6 and abs(r[0]["utm_y"]) < 1e-6
    assert abs(r[1]["utm_y"] - 4427757.2187) < 0.01


def gappy(seed=1, t=14, n=40, share=0.15):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, 2)) @ rng.normal(size=(2, t)) * 2 + rng.normal(size=(n, 1)) + rng.normal(size=t) + 0.1 * rng.normal(size=(n, t))
    y[rng.random((n, t)) < share] = np.nan
    y[::2, -1] = np.nan
    return y


def plain_em(y, rank, soft, tol):
    """Additive start, then filling, two-way means and (shrunk) singular vectors in turn."""
    seen, level, effect = np.isfinite(y), 0.0, np.zeros(y.shape[1])
    for _ in range(3000):
        level = np.nanmean(y - effect, 1, keepdims=True)
        effect = np.nanmean(y - level, 0)
        effect -= effect.mean()
    fit, low = level + effect, None
    while True:
        full = np.where(seen, y, fit)
        level = full.mean(1, keepdims=True)
        effect = (full - level).mean(0)
        u, s, v = np.linalg.svd(full - level - effect, full_matrices=False)
        new_low = (u * (np.where(np.arange(len(s)) < rank, s, 0) if soft is None else np.maximum(s - soft, 0))) @ v
        new = level + effect + new_low
        change = np.linalg.norm(new - fit) / np.linalg.norm(fit)
        if rank:
            change = max(change, np.linalg.norm(new_low - low) / np.linalg.norm(low)) if low is not None else 1.0
        fit, low = new, new_low
        if change <= tol:
            return np.where(seen, y, fit), effect


def as_donors(spark, y):
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(y)]
    return spark.createDataFrame(rows, "unit long, y array<double>").repartition(3)


@pytest.mark.parametrize("rank,soft", [(0, None), (1, None), (2, None), (0, 2.0), (0, 6.0)])
def test_low_rank_fits_equal_plain_em(spark, rank, soft):
    y = gappy()
    full, effect = plain_em(y, rank, soft, 1e-10)
    data = L.single(as_donors(spark, y), y.shape[1])
    slow, fast = data.fit({0: ((0, 0), rank, soft)}, tol=1e-10, fast=False)[0], data.fit({0: ((0, 0), rank, soft)}, tol=1e-10)[0]
    assert np.allclose(L.complete(y, slow), full, atol=1e-6) and np.allclose(slow.effect, effect, atol=1e-7)
    assert np.allclose(np.where(np.isnan(y), L.fitted(y, fast), y), full, atol=1e-5) and np.allclose(fast.effect, effect, atol=1e-6)
    # Most patterns left as rows: the same fit, by a job for each pass.
    few = L.panel(as_donors(spark, y).selectExpr("0 AS key", "y", "array(1D) AS w").checkpoint(), y.shape[1], most_bytes=8 * (1 + 14 + 14 * 14) * (len(np.unique(np.isfinite(y), axis=0)) - 3))
    assert few.rest is not None and few.rest.count() >= 3
    if rank == 1:
        got = few.fit({0: ((0, 0), rank, soft)}, tol=1e-3, fast=False)[0]
        assert np.allclose(L.complete(y, got), full, atol=0.1)
    with pytest.raises(RuntimeError):
        L.single(as_donors(spark, y), y.shape[1]).fit({0: ((0, 0), 2, None)}, rounds=3, tol=1e-12)


def test_rows_of_rare_patterns_take_no_jobs_of_their_own(spark, monkeypatch):
    y = gappy(seed=4)
    full, effect = plain_em(y, 1, None, 1e-10)
    source = as_donors(spark, y).selectExpr("0 AS key", "y", "array(1D) AS w").checkpoint()
    plan = {0: ((0, 0), 1, None), 1: ((0, 0), 0, None)}
    asked = L.panel(source, y.shape[1], most_bytes=1, most_row_bytes=0).fit(plan, tol=1e-4, fast=False)
    monkeypatch.setattr(L, "_row_moments", lambda *_: pytest.fail("a job of a pass"))
    got = L.panel(source, y.shape[1], most_bytes=1).fit(plan, tol=1e-10, fast=False)
    assert np.allclose(L.complete(y, got[0]), full, atol=1e-6) and np.allclose(got[0].effect, effect, atol=1e-7)
    assert np.allclose(L.complete(y, asked[0]), full, atol=0.1)


def test_matrices_of_frequent_patterns_equal_their_rows(spark):
    rng = np.random.default_rng(12)
    y = rng.normal(size=(300, 1)) @ rng.normal(size=(1, 6)) + rng.normal(size=(300, 6)) * 0.3
    y[::3, 5] = y[1::3, 0] = np.nan
    y[0, 3] = np.nan
    data = L.single(as_donors(spark, y), 6)
    assert len(data.known[0].patterns) == 3 and len(data.known[0].seen) == 1 and data.rest is None
    fit = data.fit({0: ((0, 0), 1, None)}, tol=1e-10, fast=False)[0]
    full, effect = plain_em(y, 1, None, 1e-10)
    assert np.allclose(L.complete(y, fit), full, atol=1e-6) and np.allclose(fit.effect, effect, atol=1e-7)


def test_passes_complete_the_rows_of_rare_patterns_only():
    rng = np.random.default_rng(21)
    y = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 9)) + rng.normal(size=(200, 9)) * 0.3
    y[::4, 6:] = y[1::4, 0] = np.nan
    y[2, 3] = y[7, 5] = np.nan
    seen = np.isfinite(y)
    run = L._Steady(L.Statistics(seen, np.ones(200), np.nan_to_num(y)), 2, None, 1e-3)
    for _ in range(6):
        run.advance(*run.moments())
    assert len(run.runs) == 3 and len(run.filled) == 2
    full = L.complete(y, run.fit)
    for got, want in zip(run.moments(), (200, full.sum(0), full.T @ full), strict=True):
        assert np.allclose(got, want, rtol=1e-10, atol=1e-9)
    patterns, which = L.distinct(seen)
    assert len(patterns) == len(np.unique(seen, axis=0)) and (patterns[which] == seen).all()
    empty = L._Steady(L.Statistics(np.zeros((0, 9), bool), np.zeros(0), np.zeros((0, 9))), 1, None, 1e-3)
    assert empty.moments()[0] == 0 and not empty.moments()[2].any()


def test_weights_are_repeated_rows(spark):
    y = gappy(seed=3)
    rows = [(0, [None if np.isnan(v) else float(v) for v in r], [1.0, float(i % 3)]) for i, r in enumerate(y)]
    data = L.panel(spark.createDataFrame(rows, "key int, y array<double>, w array<double>"), y.shape[1], 2)
    got = data.fit({0: ((0, 0), 1, None), 1: ((0, 1), 1, None)}, tol=1e-9)
    for name, of in ((0, y), (1, np.repeat(y, [i % 3 for i in range(len(y))], axis=0))):
        assert np.allclose(got[name].effect, plain_em(of, 1, None, 1e-10)[1], atol=1e-6)


def test_counterfactuals_recover_a_planted_effect(spark):
    rng, t = np.random.default_rng(5), 10
    factor = np.sin(np.arange(t))
    donors = [(i, [float(a + b * f + 0.1 * k) for k, f in enumerate(factor)]) for i, (a, b) in enumerate(rng.normal(size=(30, 2)))]
    donors[0][1][3] = None
    fit = L.fit_one(spark.createDataFrame(donors, "unit long, y array<double>"), t, 1)
    y = [float(2 + 1.5 * f + 0.1 * k + (k >= 7)) for k, f in enumerate(factor)]
    units = spark.createDataFrame([(99, y, 7), (98, [None] * t, 7), (97, y, 1), (96, y, 20)], "unit long, y array<double>, start int")
    rows = K.gaps(K.paths(units, {0: fit}, hold=2)).where("unit = 99").collect()
    assert {r["event_time"] for r in rows} == {0, 1, 2} and all(abs(r["gap"] - 1) < 0.05 for r in rows) and rows[0]["pre_rmspe"] < 0.05
    assert {r["unit"] for r in K.paths(units, {0: fit}).select("unit").collect()} == {99, 96}
    shrunk = L.fit_one(spark.createDataFrame(donors, "unit long, y array<double>"), t, 0, soft=0.01)
    assert all(abs(r["gap"] - 1) < 0.05 for r in K.gaps(K.paths(units, {0: shrunk})).where("unit = 99").collect())


def test_each_unit_meets_the_fit_of_its_start_in_one_pass(spark):
    y = gappy(seed=9)
    fits = {b: L.fit_one(as_donors(spark, y[:, :b]), b, 1) for b in (9, 14)}
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], (9, 14, 5)[i % 3]) for i, r in enumerate(y)]
    rows.append((99, [1.0, None, 2.0], 9))
    units = spark.createDataFrame(rows, "unit long, y array<double>, start int").repartition(3)
    by = lambda df: {(r["name"], r["unit"]): (r["observed"], r["path"], r["pre_rmspe"]) for r in df.collect()}
    found = K.paths(units, fits, {9: 2, 14: 3}, by_start=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got, want = by(found), {}
    for b, hold in ((9, 2), (14, 3)):
        want |= by(K.paths(units.where(F.col("start") == b), {b: fits[b]}, hold))
    assert got == want and {n for n, _ in got} == {9, 14} and (9, 99) not in got
    assert all(p[0] == [None if np.isnan(v) else v for v in y[u, :b]] and len(p[1]) == b for (b, u), p in got.items())


def test_rolling_folds_and_rank_choice(spark):
    rng, t = np.random.default_rng(6), 12
    factor = np.cos(np.arange(t))
    paths = [[float(a + b * f + 0.05 * k + e) for k, (f, e) in enumerate(zip(factor, rng.normal(size=t) * 0.02))] for a, b in rng.normal(size=(60, 2))]
    paths[3][5] = paths[9][0] = None
    paths.append([1.0] * 6 + [None] * 6)
    donors = spark.createDataFrame(list(enumerate(paths)), "unit long, y array<double>")
    folded = K.rolling_folds(donors, folds=4, share=0.2)
    rows = folded.collect()
    assert len(rows) == 4 * 61 and all(sum(r["scored"] is not None for r in rows if r["key"] == k) >= 1 for k in range(4))
    for r in rows:
        if r["scored"] is None:
            assert r["y"] == r["truth"]
        else:
            times = [k for k, v in enumerate(r["truth"]) if v is not None]
            at = times.index(r["scored"][0])
            assert r["unit"] != 60 and at >= 5 and r["scored"] == times[at : at + 3]
            assert [k for k, v in enumerate(r["y"]) if v is not None] == times[: at - 1]
    scores = [(r["name"], r["key"], r["sse"] / r["n"]) for r in K.held_out_scores(folded, t, {0: (0, None), 1: (1, None)}).collect()]
    mean = lambda name: np.mean([m for n, _, m in scores if n == name])
    assert mean(1) < 0.05 * mean(0)
    assert K.one_se_choice([(0, [(5.0, 1), (5.2, 1)]), (1, [(1.0, 1), (1.2, 1)]), (2, [(0.95, 1), (1.15, 1)])]) == 1
    drawn = donors.select(K.bootstrap_weights(50).alias("w")).collect()
    assert 0.9 < np.mean([r["w"] for r in drawn]) < 1.1 and all(len(r["w"]) == 50 for r in drawn)
    left = donors.select(K.leave_out_weights(5).alias("w")).collect()
    assert all(sorted(r["w"]) == [0.0, 1.0, 1.0, 1.0, 1.0] for r in left)


def test_replicate_inference(spark):
    effect, se, low, high, p, valid = K.inference(2.0, [1.0, 2.0, 3.0])
    assert (effect, se, valid) == (2.0, 1.0, 1.0) and abs(high - 3.959964) < 1e-6 and abs(p - 0.0455003) < 1e-6
    # Leaving out one of n equal units is the unit jackknife; of a mean it gives the usual standard error.
    x = np.array([1.0, 4.0, 2.0, 7.0, 3.5])
    out = [(x.sum() - v) / 4 for v in x]
    assert K.inference(x.mean(), out, [1.0] * 5)[1] == pytest.approx(x.std(ddof=1) / np.sqrt(5)) and K.inference(1.0, [1.0, None, None])[1] is None
    z = [0.0, 0.5, 1.0, 1.96, 2.4, 2.6, 4.0, 8.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(K.normal_tail(F.col("z"))).collect()
    assert all(r[0] == pytest.approx(math.erfc(v / math.sqrt(2)), rel=1e-6) for r, v in zip(got, z))
    rows = spark.createDataFrame([(1.0, 0.25, 1.0), (0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (1.0, 0.25, 0.5), (None, 1.0, 1.0)], "e double, v double, s double")
    got = [tuple(r) for r in rows.select(*K.normal_inference(F.col("e"), F.col("v"), F.col("s"))).collect()]
    assert got[0][0] == 0.5 and got[1][3] == 1.0 and got[2][3] == 0.0 and got[3][0] is None and got[4][0] is None


def test_the_normal_tail_plans_few_copies_of_its_argument(spark):
    z = F.abs(F.col("id") / 3) / F.sqrt(F.col("id") + 1)
    planned = spark.range(4).select(K.normal_tail(z).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert planned.count("abs(") == 1


def test_placebo_gaps_of_unseen_donors(spark):
    y = gappy(seed=8, share=0.0)[:, :13]
    fit = L.fit_one(as_donors(spark, y), 13, 1)
    rows = [(i, [float(v) for v in r], [float(i % 2)]) for i, r in enumerate(y)]
    got = {(r["start"], r["event_time"]): r for r in K.unseen_gaps(spark.createDataFrame(rows, "unit long, y array<double>, w array<double>").repartition(3), {0: fit}, [9, 9]).collect()}
    gap = (y - L.fitted(np.where(np.arange(13) < 9, y, np.nan), fit))[::2, 9:]
    assert got[9, 2]["s"] == pytest.approx(gap[:, 2].sum()) and got[9, None]["q"] == pytest.approx((gap.mean(1) ** 2).sum()) and got[9, None]["n"] == 20


def test_hulls_trim_widen_and_fall_back_to_discs(spark):
    square = [(1, 30.0 * a, 30.0 * b) for a in range(31) for b in range(31)] * 2 + [(1, 9000.0, 0.0), (1, None, 1.0)]
    few = [(2, 0.0, 0.0), (2, 10.0, 0.0), (3, 5.0, 5.0), (4, 0.0, 0.0), (4, 100.0, 0.0), (4, 200.0, 0.0)]
    points = spark.createDataFrame(square + few + [(None, 1.0, 1.0)], "k int, x double, y double")
    hulls = U.robust_hulls(points, "k").withColumn("city", F.col("k") % 2)
    got = {r["k"]: r for r in U.hulls_or_discs(hulls, "city").withColumn("area", U.ring_area(F.col("ring"))).collect()}
    assert set(got) == {1, 2, 3, 4} and [got[k]["n_points"] for k in (1, 2, 3, 4)] == [961, 2, 1, 3]
    assert got[1]["source"] == "hull" and abs(got[1]["area"] / (900**2 + 4 * 900 * 20 + math.pi * 400) - 1) < 1e-4
    polygon = 32 * math.sin(math.pi / 32)
    assert got[3]["source"] == "calibrated_disc" and abs(got[3]["area"] - polygon * 500**2) < 1
    assert got[2]["source"] == got[4]["source"] == "default_disc" and abs(got[4]["area"] - polygon * 250**2) < 1
    assert U.robust_hulls(points.limit(0), "k").count() == 0


def test_hulls_equal_those_of_all_points(spark):
    rng = np.random.default_rng(3)
    xy = np.round(rng.normal(0, 200, (500, 2)), 0)
    got = U.robust_hulls(spark.createDataFrame([(1, float(x), float(y)) for x, y in xy], "k int, x double, y double"), "k", most=1e9, buffer=0.0)
    middle = np.median(np.unique(xy, axis=0), axis=0)
    near = [tuple(p) for p in xy if np.hypot(*(p - middle)) <= 750]
    assert {(p["x"], p["y"]) for p in got.first()["ring"]} == set(U._hull(near))


def test_unfinished_iterations_raise(spark):
    chain = [(k, k + 1, 1.0) for k in range(8)] + [(k + 1, k, 1.0) for k in range(8)]
    edges = spark.createDataFrame(chain, "src int, dst int, km double")
    with pytest.raises(RuntimeError):
        S.shortest_paths(edges, 100.0, rounds=2)
    assert S.shortest_paths(edges, 100.0).where("src = 0 and dst = 8").first()["km"] == 8.0


def unbalanced(seed=2, units=24, periods=9, effect=lambda cohort, k: 1.0 + 0.5 * k + (cohort == 5)):
    """(unit, period, y, t, cohort): every third unit is a control, others open at 4 or 5; some cells are missing, some doubled."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        cohort = None if u % 3 == 0 else 4 + (u % 3 == 2)
        for k in range(periods):
            for _ in range(int(rng.integers(0, 3)) if u > 6 else 1):
                t = None if cohort is None else k - cohort
                y = float(u % 5 + np.sin(k) + (effect(cohort, t) if t is not None and t >= 0 else 0.0) + 0.01 * rng.normal())
                rows.append((u, k, y, t, cohort))
    return rows


def dense(rows, hits):
    """Coefficients, CRV1 covariance by unit, and residual of y on dummies, unit and period effects."""
    units, periods = (sorted({r[i] for r in rows}) for i in (0, 1))
    x = np.array([[float(h(r)) for h in hits] for r in rows])
    fixed = np.array([[float(r[0] == u) for u in units] + [float(r[1] == p) for p in periods[1:]] for r in rows])
    y = np.array([r[2] for r in rows])
    clean = lambda v: v - fixed @ np.linalg.lstsq(fixed, v, rcond=None)[0]
    xt, yt = clean(x), clean(y)
    inverse = np.linalg.pinv(xt.T @ xt)
    beta = inverse @ xt.T @ yt
    u = yt - xt @ beta
    scores = np.array([sum((xt[i] * u[i] for i, r in enumerate(rows) if r[0] == g), np.zeros(len(hits))) for g in units])
    g, n, p = len(units), len(rows), len(hits)
    return beta, g / (g - 1) * (n - 1) / (n - p) * inverse @ scores.T @ scores @ inverse, yt


STUDY = "unit int, period int, y double, t int, cohort int"


def test_absorption_and_event_studies_equal_dense_least_squares(spark):
    rows = unbalanced()
    df = spark.createDataFrame(rows + [(90, None, 1.0, None, None), (91, 2, None, None, None)], STUDY).repartition(5)
    flat = D.absorb(df.select("unit", "period", "y"), ["y"], "unit", "period")
    got = sorted((r["unit"], r["period"], r["y"]) for r in flat.collect())
    want = sorted((r[0], r[1], v) for r, v in zip(rows, dense(rows, [lambda r: 0.0])[2]))
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9) and [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(r[1]) < 1e-9 for key in ("unit", "period") for r in flat.groupBy(key).agg(F.avg("y")).collect())
    times = sorted({r[3] for r in rows if r[3] is not None and r[3] != -1})
    beta, cov, _ = dense(rows, [lambda r, t=t: r[3] == t for t in times])
    got = {t: (b, se) for t, b, se, _ in E.event_study(df, "y", "unit", "period", "t", "unit")}
    assert set(got) == set(times) and all(got[t] == pytest.approx((beta[k], cov[k, k] ** 0.5), abs=1e-8) for k, t in enumerate(times))
    # Strata are studies of their own rows.
    split = D.event_studies(df.withColumn("half", F.col("unit") % 2), "y", "unit", "period", "t", "unit", by="half")
    for half in (0, 1):
        part = [r for r in rows if r[0] % 2 == half]
        times = sorted({r[3] for r in part if r[3] is not None and r[3] != -1})
        beta, cov, _ = dense(part, [lambda r, t=t: r[3] == t for t in times])
        own = {t: (b, se) for key, t, b, se, _ in split if key == str(half)}
        assert all(own[t] == pytest.approx((beta[k], cov[k, k] ** 0.5), abs=1e-8) for k, t in enumerate(times))


def test_cohort_studies_equal_dense_interactions(spark):
    rows = unbalanced()
    got = {r[0]: r[1:] for r in D.cohort_studies(spark.createDataFrame(rows, STUDY), "y", "unit", "period", "t", "cohort", "unit")}
    pairs = sorted({(r[4], r[3]) for r in rows if r[3] is not None and r[3] != -1})
    beta, cov, _ = dense(rows, [lambda r, p=p: (r[4], r[3]) == p for p in pairs])
    for t in {p[1] for p in pairs}:
        at = [k for k, p in enumerate(pairs) if p[1] == t]
        n = np.array([len({r[0] for r in rows if (r[4], r[3]) == pairs[k]}) for k in at], float)
        w, b = n / n.sum(), beta[at]
        variance = w @ cov[np.ix_(at, at)] @ w + b @ (np.diag(w) - np.outer(w, w)) @ b / n.sum()
        assert got[t] == (pytest.approx(w @ b, abs=1e-8), pytest.approx(variance**0.5, abs=1e-7), len(at))
    # The planted effect differs by cohort: 1 + t / 2, one more in the later one.
    assert got[0][0] == pytest.approx(1.5, abs=0.2)


def test_local_quadratic_fits_equal_plain_least_squares(spark):
    rng = np.random.default_rng(4)
    cells = [(k, r, c, float(np.exp(-((r - 4) ** 2 + (c - 3) ** 2) / 6) * 3 + 0.1 * rng.normal())) for k in (1, 2) for r in range(9) for c in range(8) if (r, c) != (2, 2)]
    df = spark.createDataFrame(cells + [(3, 0, 0, 1.0)], "city int, row int, col int, z double").repartition(4)
    sigmas = [1.0, 1.5]
    own = {k: {(r, c): z for city, r, c, z in cells if city == k} for k in (1, 2)}

    def plain(of, at, sigma, without=False):
        rows = [(r - at[0], c - at[1], z) for (r, c), z in of.items() if max(abs(r - at[0]), abs(c - at[1])) <= 3 * sigma and not (without and (r, c) == at)]
        u, v, y = (np.array(x, float) for x in zip(*rows))
        w = np.exp(-(u * u + v * v) / (2 * sigma**2))
        x = np.column_stack([np.ones(len(u)), u, v, u * u, v * v, u * v])
        hat = np.linalg.pinv((x * w[:, None]).T @ x) @ (x * w[:, None]).T
        return hat[0] @ y, (hat[0] ** 2).sum(), w.sum()

    got = {(r["city"], r["row"], r["col"], r["sigma"]): r for r in U.local_quadratic(df, ["city"], sigmas).collect()}
    assert len(got) == 2 * (len(cells) + 1)
    for k, r, c, _ in cells:
        for sigma in sigmas:
            one = got[k, r, c, sigma]
            assert (one["fit"], one["lever"], one["mass"]) == pytest.approx(plain(own[k], (r, c), sigma), abs=1e-5)
            assert one["loo"] == pytest.approx(plain(own[k], (r, c), sigma, True)[0], abs=1e-4)
    fits = {(r["city"], r["row"], r["col"]): r for r in U.density_fit(df, ["city"], sigmas).collect()}
    for k in (1, 2):
        votes = {s: np.mean([(plain(own[k], at, s, True)[0] - z) ** 2 for at, z in own[k].items() if plain(own[k], at, s)[2] > 7]) if any(plain(own[k], at, s)[2] > 7 for at in own[k]) else np.inf for s in sigmas}
        best = min(votes, key=lambda s: votes[s])
        assert {r["sigma"] for key, r in fits.items() if key[0] == k} == {best}
        near = [(q, np.exp(-((q[0] - 4) ** 2 + (q[1] - 3) ** 2) / (2 * best**2))) for q in own[k] if max(abs(q[0] - 4), abs(q[1] - 3)) <= 3 * best]
        s2 = sum(w * (own[k][q] - plain(own[k], q, best)[0]) ** 2 for q, w in near) / max(sum(w for _, w in near) - 6, 1)
        assert fits[k, 4, 3]["variance"] == pytest.approx(s2 * plain(own[k], (4, 3), best)[1], rel=1e-3)
    peaks = {(r["city"], r["row"], r["col"]): r for r in U.significant_peaks(U.density_fit(df, ["city"], sigmas), ["city"], 1).collect()}
    assert all(any(abs(key[1] - 4) <= 1 and abs(key[2] - 3) <= 1 and r["significant"] for key, r in peaks.items() if key[0] == k) for k in (1, 2)) and (3, 0, 0) not in peaks


def test_benjamini_hochberg_step_up(spark):
    rng = np.random.default_rng(7)
    rows = [(k, float(p)) for k in (1, 2) for p in np.concatenate([rng.uniform(0, 0.02, 12), rng.uniform(0, 1, 30)])] + [(3, 0.9), (1, None)]
    got = U.benjamini_hochberg(spark.createDataFrame(rows, "k int, p double"), ["k"], "p", 0.05).collect()
    for k in (1, 2, 3):
        p = sorted(v for key, v in rows if key == k and v is not None)
        limit = max([v for i, v in enumerate(p) if v <= 0.05 * (i + 1) / len(p)], default=-1.0)
        assert all(r["significant"] == (r["p"] is not None and r["p"] <= limit) for r in got if r["k"] == k)


def test_panel_matches_equal_brute_force(spark):
    from terrapanel.operators import panelmatch as M

    rng, t, lag, last = np.random.default_rng(3), 20, 6, 3
    rows = []
    for u in range(60):
        opening = int(rng.integers(8, 18))
        y = [float(u % 4 + 0.1 * k + rng.normal() * 0.3 + (2.0 if u % 3 == 0 and k >= opening else 0.0)) for k in range(t)]
        for k in rng.integers(0, t, 2):
            if u % 2:
                y[k] = None
        rows.append((u, u % 2, u % 3 == 0, opening, y))
    units = spark.createDataFrame(rows, "unit long, city long, treated boolean, opening int, y array<double>").repartition(3)
    sets = M.matched_sets(units, lag, last).collect()
    # Candidates: one row for each start and unit that may be a treated or a control one there.
    frames = []
    for b in sorted({r[3] for r in rows if r[2]}):
        for u, city, treated, opening, y in rows:
            role = "t" if treated and opening == b else "c" if not treated or opening > b + last else None
            sign = "".join("-" if y[k] is None else "1" if treated and k >= opening else "0" for k in range(b - lag, b))
            parts = [[v for v in y[b - lag + h * 3 : b - lag + h * 3 + 3] if v is not None] for h in (0, 1)]
            if role and y[b - 1] is not None and all(parts):
                frames.append((role, b, u, (city, sign), np.array([np.mean(x) for x in parts])))
    x = np.array([f[4] for f in frames])
    inverse = np.linalg.inv(np.cov(x.T))
    want = {}
    for role, b, u, sign, v in frames:
        if role == "t":
            near = sorted(((v - o[4]) @ inverse @ (v - o[4]), o[2]) for o in frames if o[0] == "c" and o[1] == b and o[3] == sign)
            if near:
                want[u] = (b, near[0][1])
    assert {r["treated"]: (r["start"], r["control"]) for r in sets} == want and len(want) > 5
    got = {r["lead"]: r for r in M.lead_effects(M.matched_sets(units, lag, last), units, last, 100).collect()}
    for f in range(last + 1):
        gap = []
        for u, (b, c) in want.items():
            a, o = rows[u][4], rows[c][4]
            if b + f < t and None not in (a[b + f], a[b - 1], o[b + f], o[b - 1]):
                gap.append(a[b + f] - a[b - 1] - o[b + f] + o[b - 1])
        assert got[f]["att"] == pytest.approx(np.mean(gap)) and got[f]["sets"] == len(gap)
        assert abs(got[f]["att"] - 2) < 0.6 and 0.3 < got[f]["se"] / (np.std(gap, ddof=1) / len(gap) ** 0.5) < 3


def test_permutations_are_bijections_and_correlations_agree(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        got = [V.shuffled_places(np.arange(n), n, key).tolist() for key in range(4)]
        assert all(sorted(x) == list(range(n)) for x in got) and (n < 7 or len({tuple(x) for x in got}) == 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = 0.12 * x + rng.normal(size=300)
    rows = [(int(k), float(a), float(b)) for k, a, b in zip(rng.permutation(300) * 3, x, y)] + [(5000, None, 1.0), (5001, 1.0, None)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(5)
    places = V.numbered(df, ["k"]).select("k", "i").collect()
    assert [r["i"] for r in sorted(places, key=lambda r: r["k"])] == list(range(302))
    r = {row["rep"]: row["r"] for row in V.permuted_correlations(df, "x", "y", ["k"], 200).collect()}
    assert len(r) == 201 and r[0] == pytest.approx(np.corrcoef(x, y)[0, 1])
    null = np.array([r[k] for k in range(1, 201)])
    assert abs(null.mean()) < 0.02 and abs(null.std() * 300**0.5 - 1) < 0.15
    order = np.argsort([row[0] for row in rows[:300]])
    moved = V.shuffled_places(np.arange(300), 300, 7)
    back = np.empty(300)
    back[moved] = y[order]
    assert r[7] == pytest.approx(np.corrcoef(x[order], back)[0, 1])


def test_pairs_by_common_cells_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    masks = [int(m) for m in rng.integers(0, 64, 40)] + [63, 63, 0, 0]
    want = {}
    for i in range(len(masks)):
        for j in range(i):
            want[(masks[i] & masks[j]).bit_count()] = want.get((masks[i] & masks[j]).bit_count(), 0) + 1
    df = spark.createDataFrame([(m,) for m in masks], "m long").groupBy("m").agg(F.count("*").alias("n"))
    assert dict(V.pairs_by_common_cells(df, 6)) == want and V.pairs_by_common_cells(df.limit(0), 6) == []


def test_months_of_the_panel_need_no_panel(spark, monkeypatch):
    from terrapanel.plans import counterfactuals, roles

    d = "/root/testdata/sf0.001"
    at = F.year("period") * 12 + F.month("period") - 1
    low, high = roles.panel(spark, d).agg(F.min(at), F.max(at)).first()
    monkeypatch.setattr(roles, "panel", None)
    assert counterfactuals.months(spark, d) == (low, high - low + 1)
