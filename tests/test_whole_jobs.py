"""Queries that do their whole job: every row has its result."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import counterfactual as K
from terrapanel.operators import evaluation as V
from terrapanel.operators import lowrank as L
from terrapanel.plans import counterfactuals as C
from terrapanel.plans import evaluation as P
from terrapanel.plans import registry

SF = "/root/testdata/sf0.001"


def embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows])


def five_nearest(spark):
    ids, v, label = embeddings(spark)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -np.inf)
    return ids, label, cosine, np.argsort(-cosine, axis=1, kind="stable")[:, :5]


def test_every_vector_gets_a_prediction(spark):
    ids, label, _, at = five_nearest(spark)
    got = {r["id"]: r["predicted"] for r in registry.queries()["knn_predict"](spark, SF).collect()}
    assert sorted(got) == ids
    assert np.allclose([got[i] for i in ids], label[at].mean(1), atol=1e-5)


def test_every_vector_gets_a_score(spark):
    ids, label, cosine, at = five_nearest(spark)
    got = {r["id"]: (r["score"], r["cosine"]) for r in registry.queries()["knn_retrieval_score"](spark, SF).collect()}
    assert sorted(got) == ids
    want = np.column_stack([(label[at] == label[:, None]).mean(1), np.take_along_axis(cosine, at, 1).mean(1)])
    assert np.allclose([got[i] for i in ids], want, atol=6e-5)


def test_copies_of_one_vector_stay_few_and_keep_their_order(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(30, 5))
    v[::3] = v[0]
    at = V._first_copies(v, 4)
    assert at.tolist() == [i for i in range(30) if i % 3 or i < 12]
    rows = spark.createDataFrame([(i, [float(x) for x in r / np.linalg.norm(r)]) for i, r in enumerate(v)], "id long, v array<double>")
    rows = rows.unionByName(spark.createDataFrame([(99, [None, 1.0, 0.0, 0.0, 0.0]), (98, None)], "id long, v array<double>"))
    got = {}
    for r in V.nearest(rows, rows.selectExpr("id AS pid", "v AS pv"), 3, pool_size=8).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["pid"])
    assert sorted(got) == list(range(30))
    assert all(got[i] == [j for j in (0, 3, 6, 9) if j != i][:3] for i in range(0, 30, 3))


def test_every_two_units_are_correlated(spark):
    v = {r["unit"]: np.array(r["v"], float) for r in P.responses(spark, "/root/testdata/sf0.01").collect()}
    got = {(r["a"], r["b"]): r["r"] for r in registry.queries()["masked_response_corr"](spark, "/root/testdata/sf0.01").collect()}
    want = {(a, b) for a in v for b in v if a < b and np.isfinite(v[a] + v[b]).any()}
    assert set(got) == want and any(a % 20 and b % 20 for a, b in want)


@pytest.mark.parametrize("size", [2, 5, 9, 14, 40])
def test_every_two_rows_meet_once(spark, size):
    rng = np.random.default_rng(size)
    y = rng.normal(size=(37, 9))
    y[rng.random(y.shape) < 0.3] = np.nan
    df = spark.createDataFrame([(i, [None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(y)], "a long, x array<double>").repartition(3)
    rows = V.masked_correlations(df, None, 2, size).collect()
    want = {(a, b): np.isfinite(y[a] + y[b]) for a in range(37) for b in range(a + 1, 37)}
    assert sorted((r["a"], r["b"]) for r in rows) == sorted(k for k, m in want.items() if m.any())
    for r in rows:
        m = want[r["a"], r["b"]]
        assert m.sum() < 2 or abs(r["r"] - np.corrcoef(y[r["a"]][m], y[r["b"]][m])[0, 1]) < 1e-7


def passes(ys, soft, tol=1e-13):
    """Plain passes: gaps are filled from the fit before, singular values shrunk by the threshold."""
    seen = np.isfinite(ys)
    full = np.where(seen, ys, np.nanmean(ys, 0))
    for _ in range(50_000):
        effect = full.mean(0) - full.mean()
        level = full.mean(1, keepdims=True)
        u, size, v = np.linalg.svd(full - level - effect, full_matrices=False)
        new = np.where(seen, ys, level + effect + (u * np.maximum(size - soft, 0)) @ v)
        done, full = np.abs(new - full).max() <= tol, new
        if done:
            kept = size > soft
            return L.Fit(effect, v[kept].T, 1 - soft / size[kept])
    raise AssertionError("not settled")


def gap_of(fit, ys, starts):
    """Mean gap of treated rows from their starts on."""
    late = np.isfinite(ys) & (np.arange(ys.shape[1]) >= starts[:, None])
    ok = (np.isfinite(ys) & ~late).any(1)
    gap = ys - L.fitted(np.where(late, np.nan, ys), fit)
    return gap[ok][late[ok]].mean()


def jackknife(whole, out):
    """The reference's unit jackknife."""
    pseudo = len(out) * whole - (len(out) - 1) * np.array(out)
    return math.sqrt(pseudo.var(ddof=1) / len(out))


def test_the_jackknife_refits_without_each_donor(spark):
    d = "/root/testdata/sf0.01"
    got = registry.queries()["mc_jackknife"](spark, d).first()
    units, t = C.arrays(spark, d)
    soft = C.chosen_threshold(units, t)
    rows = units.orderBy("unit").collect()
    donors, treated = (L.matrix([r["y"] for r in rows if r["treated"] == k], t) for k in (False, True))
    starts = np.array([r["start"] for r in rows if r["treated"]])
    effect = gap_of(passes(donors, soft, 1e-11), treated, starts)
    se = jackknife(effect, [gap_of(passes(np.delete(donors, i, 0), soft, 1e-11), treated, starts) for i in range(len(donors))])
    want = [effect, se, effect - 1.959964 * se, effect + 1.959964 * se, math.erfc(abs(effect) / se / math.sqrt(2)), 1.0]
    assert np.allclose(list(got), want, atol=6e-5)


@pytest.mark.parametrize("soft", [100.0, 12.0, 4.0])
def test_refits_without_one_path_settle_where_passes_do(spark, soft):
    rng, t, n = np.random.default_rng(3), 14, 30
    ys = rng.normal(size=(n, 3)) @ rng.normal(size=(3, t)) + rng.normal(size=(n, 1)) + 0.3 * rng.normal(size=(n, t)) + np.arange(t) * 0.1
    ys[rng.random(ys.shape) < 0.08], ys[:8, 3], ys[10:20, -1] = np.nan, np.nan, np.nan
    ys[5] = ys[4]
    some = [2, 5, 11, 19, 25]
    cells = lambda y: [None if np.isnan(v) else float(v) for v in y]
    donors = spark.createDataFrame([(i, cells(y)) for i, y in enumerate(ys)], "unit long, y array<double>").checkpoint()
    # Patterns as matrices, and rows.
    for data in (L.single(donors, t), L.single(spark.createDataFrame([(cells(y),) for y in np.repeat(ys, 300, 0)], "y array<double>").checkpoint(), t)):
        times = 1 if data.known[0].weights.sum() else 300
        each = donors.where(F.col("unit").isin(some)).select("unit", "y", F.lit(1).cast("long").alias("n"))
        fits = L.left_out(each, data, soft * times**0.5).checkpoint()
        rows = {r["unit"]: r for r in fits.collect()}
        assert sorted(rows, key=str) == sorted([*some, None], key=str)
        for i, r in rows.items():
            left = np.repeat(ys, times, 0)
            want = passes(left if i is None else np.delete(left, i * times, 0), soft * times**0.5)
            basis = np.array(r["basis"]).reshape(t, -1)
            assert np.allclose(r["effect"], want.effect, atol=1e-9) and np.allclose((basis * r["weights"]) @ basis.T, want.projection, atol=1e-8)
        starts = rng.integers(-1, t + 2, 12)
        treated = np.where(rng.random((12, t)) < 0.2, np.nan, rng.normal(size=(12, t)) + np.arange(t))
        treated[3] = treated[4] = ys[1]
        starts[3] = starts[4] = 7
        units = spark.createDataFrame([(i, int(s), cells(y)) for i, (s, y) in enumerate(zip(starts, treated))], "unit long, start int, y array<double>")
        for r in K.mean_gaps(fits, units).collect():
            f = rows[r["unit"]]
            fit = L.Fit(np.array(f["effect"]), np.array(f["basis"]).reshape(t, -1), np.array(f["weights"]))
            plain = K.gaps(K.paths(units, {0: fit})).agg(F.avg("gap")).first()[0]
            assert r["gap"] == pytest.approx(plain, abs=1e-9)


def test_unit_jackknife_of_a_mean(spark):
    x = np.array([1.0, 4.0, 2.0, 7.0, 3.5, 3.5])
    out = [(float((x.sum() - v) / 5)) for v in x]
    rows = [(None, 0, float(x.mean())), *[(i, 1, v) for i, v in enumerate(out[:4])], (4, 2, out[4])]
    effect, se, low, high, p, valid = K.unit_jackknife(spark.createDataFrame(rows, "unit long, n long, gap double"))
    assert (effect, valid) == (x.mean(), 1.0) and se == pytest.approx(x.std(ddof=1) / math.sqrt(6)) and high - low == pytest.approx(2 * 1.959964 * se)
    assert se == pytest.approx(K.inference(x.mean(), out, [1.0] * 6)[1]) and p == pytest.approx(K.inference(x.mean(), out, [1.0] * 6)[4])
    few = spark.createDataFrame([(None, 0, 1.0), (1, 3, 1.0), (2, 1, None)], "unit long, n long, gap double")
    assert K.unit_jackknife(few) == (1.0, None, None, None, None, 0.75)
