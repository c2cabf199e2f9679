"""Queries of pooling, weights and evaluation."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluation as V
from ..operators import panels as P
from . import roles as R
from .base import book
from .estimators import effects, ready
from .panels import rel

QUERIES, ORACLE, query = book()
EFF = "units panel pairs paths effects"


def labels(s, d):
    """Effects with their city."""
    return effects(s, d).join(R.units(s, d).select(F.col("unit").alias("treated"), "city"), "treated")


R.SQL["lab"] = "SELECT e.*, u.city FROM effects e JOIN (SELECT unit, city FROM units) u ON u.unit = e.treated"
EFF2 = EFF + " lab"


@query("reference_contrast", """SELECT a.treated, a.event_time, round(a.effect - b.effect, 5) AS contrast FROM effects a JOIN effects b ON a.treated = b.treated AND b.event_time = 1 WHERE a.effect IS NOT NULL AND b.effect IS NOT NULL""", EFF)
def _(s, d):
    e = effects(s, d).where("effect is not null")
    ref = e.where("event_time = 1").select("treated", F.col("effect").alias("r"))
    return e.join(ref, "treated").select("treated", "event_time", F.round(F.col("effect") - F.col("r"), 5).alias("contrast"))


@query("pooled_effect_series", """WITH m AS (SELECT event_time, avg(effect) AS m, count(*) AS n FROM lab WHERE effect IS NOT NULL GROUP BY 1), c AS (SELECT event_time, city, sum(effect - m) AS s FROM lab JOIN m USING (event_time) WHERE effect IS NOT NULL GROUP BY 1, 2)
    SELECT event_time, n, count(*) AS n_cities, round(m, 5) AS mean, round(sqrt(count(*) / (count(*) - 1) * sum(s * s)) / n, 5) AS se FROM c JOIN m USING (event_time) GROUP BY event_time, n, m""", EFF2)
def _(s, d):
    e = labels(s, d).where("effect is not null")
    m = e.groupBy("event_time").agg(F.avg("effect").alias("m"), F.count("*").alias("n"))
    c = e.join(m, "event_time").groupBy("event_time", "city", "m", "n").agg(F.sum(F.col("effect") - F.col("m")).alias("s"))
    g = c.groupBy("event_time", "m", "n").agg(F.count("*").alias("g"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return g.select("event_time", "n", F.col("g").alias("n_cities"), F.round("m", 5).alias("mean"), F.round(F.sqrt(F.try_divide(F.col("g"), F.col("g") - 1) * F.col("q")) / F.col("n"), 5).alias("se"))


R.SQL["pretrend"] = """SELECT event_time, avg(m) AS m, stddev_samp(m) / sqrt(count(*)) AS se, count(*) AS g FROM (SELECT event_time, city, avg(effect) AS m FROM lab WHERE effect IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""


def pretrend(s, d):
    c = labels(s, d).where("effect is not null").groupBy("event_time", "city").agg(F.avg("effect").alias("m"))
    return c.groupBy("event_time").agg(F.avg("m").alias("m"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("g"))


@query("pretrend_cluster_test", "SELECT event_time, g, round(m, 3) AS mean, round(m / se, 3) AS t FROM pretrend", EFF2 + " pretrend")
def _(s, d):
    return pretrend(s, d).select("event_time", "g", F.round("m", 3).alias("mean"), F.round(F.try_divide("m", "se"), 3).alias("t"))


@query("pretrend_attach", """SELECT treated, event_time, CASE WHEN effect IS NULL THEN 'missing' WHEN abs(m / se) > 2 THEN 'pretrend' ELSE 'clean' END AS flag FROM effects LEFT JOIN pretrend USING (event_time)""", EFF2 + " pretrend")
def _(s, d):
    j = effects(s, d).join(pretrend(s, d), "event_time", "left")
    return j.select("treated", "event_time", F.when(F.col("effect").isNull(), "missing").when(F.abs(F.try_divide("m", "se")) > 2, "pretrend").otherwise("clean").alias("flag"))


@query("release_standardize", """SELECT treated::VARCHAR AS id, 'match' AS method, event_time, effect AS estimate FROM effects UNION ALL SELECT 'pooled', 'pooled', event_time, round(m, 3) FROM pretrend""", EFF2 + " pretrend")
def _(s, d):
    a = effects(s, d).select(F.col("treated").cast("string").alias("id"), F.lit("match").alias("method"), "event_time", F.col("effect").alias("estimate"))
    return a.unionByName(pretrend(s, d).select(F.lit("pooled").alias("id"), F.lit("pooled").alias("method"), "event_time", F.round("m", 3).alias("estimate")))


@query("release_availability", """SELECT city, event_time, count(effect) AS n, round(count(effect) / count(*), 6) AS coverage, CASE WHEN count(effect) = 0 THEN 'missing' WHEN count(effect) < count(*) THEN 'partial' ELSE 'full' END AS status FROM lab GROUP BY 1, 2""", EFF2)
def _(s, d):
    n, k = F.count("effect"), F.count("*")
    return labels(s, d).groupBy("city", "event_time").agg(n.alias("n"), F.round(n / k, 6).alias("coverage"), F.when(n == 0, "missing").when(n < k, "partial").otherwise("full").alias("status"))


@query("release_selection", """SELECT city, round(avg(effect), 5) AS post_mean, round(avg((effect > 0)::INT), 6) AS positive_share, count(effect) AS n FROM lab GROUP BY 1""", EFF2)
def _(s, d):
    return labels(s, d).groupBy("city").agg(F.round(F.avg("effect"), 5).alias("post_mean"), F.round(F.avg((F.col("effect") > 0).cast("int")), 6).alias("positive_share"), F.count("effect").alias("n"))


@query("release_validate", """SELECT 'key_unique' AS name, count(*) = count(DISTINCT (treated, event_time)) AS passed FROM effects UNION ALL SELECT 'label_matches_flag', bool_and((effect IS NOT NULL) = label_available) FROM effects UNION ALL SELECT 'has_rows', count(*) > 0 FROM effects""", EFF)
def _(s, d):
    e = effects(s, d)
    checks = [("key_unique", F.count("*") == F.count_distinct("treated", "event_time")), ("label_matches_flag", F.bool_and(F.col("effect").isNotNull() == F.col("label_available"))), ("has_rows", F.count("*") > 0)]
    out = None
    for name, c in checks:
        row = e.agg(c.alias("passed")).select(F.lit(name).alias("name"), "passed")
        out = row if out is None else out.unionByName(row)
    return out


@query("response_frame", """SELECT treated, event_time, effect, CASE WHEN label_available AND abs(effect) < 0.5 THEN 'A' WHEN label_available THEN 'B' ELSE 'C' END AS grade, label_available AND abs(effect) < 2 AS training_mask FROM effects""", EFF)
def _(s, d):
    ok = F.col("label_available")
    return effects(s, d).select("treated", "event_time", "effect", F.when(ok & (F.abs("effect") < 0.5), "A").when(ok, "B").otherwise("C").alias("grade"), (ok & (F.abs("effect") < 2)).alias("training_mask"))


WEIGHTS = """w0 AS (SELECT treated, event_time, city, exp(-0.5::DOUBLE * abs(effect)) / (1 + event_time) AS w FROM lab WHERE effect IS NOT NULL), q AS (SELECT city, quantile_cont(w, 0.01) AS a, quantile_cont(w, 0.99) AS b FROM w0 GROUP BY 1),
    c AS (SELECT treated, event_time, city, least(greatest(w, a), b) AS v FROM w0 JOIN q USING (city)), weights AS (SELECT treated, event_time, v / avg(v) OVER (PARTITION BY city) AS weight FROM c)"""


def weights(s, d):
    e = labels(s, d).where("effect is not null").withColumn("w", F.exp(-0.5 * F.abs("effect")) / (1 + F.col("event_time")))
    return P.winsorize(e, "w", ["city"]).select("treated", "event_time", "weight")


@query("label_weights", f"WITH {WEIGHTS} SELECT treated, event_time, round(weight, 4) AS weight FROM weights", EFF2)
def _(s, d):
    return weights(s, d).withColumn("weight", F.round("weight", 4))


@query("unit_sampling_weight", f"WITH {WEIGHTS} SELECT treated, round(min(weight), 4) AS weight FROM weights GROUP BY 1", EFF2)
def _(s, d):
    return weights(s, d).groupBy("treated").agg(F.round(F.min("weight"), 4).alias("weight"))


@query("train_fit_normalize", """WITH t AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM panel WHERE unit % 10 < 7) SELECT unit, period, round((y - m) / s, 5) AS z FROM panel, t""", "panel")
def _(s, d):
    p = R.panel(s, d)
    fit = p.where("unit % 10 < 7").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"))
    return p.crossJoin(F.broadcast(fit)).select("unit", "period", F.round(F.try_divide(F.col("y") - F.col("m"), F.col("sd")), 5).alias("z"))


@query("model_input_tables", """SELECT treated, count(*) AS cells, count(effect) AS n_available, max(CASE WHEN effect IS NOT NULL THEN 1 ELSE 0 END)::INT AS in_sample FROM effects GROUP BY 1""", EFF)
def _(s, d):
    return effects(s, d).groupBy("treated").agg(F.count("*").alias("cells"), F.count("effect").alias("n_available"), F.max(F.col("effect").isNotNull().cast("int")).alias("in_sample"))


@query("stc_input_tables", """SELECT unit, count(DISTINCT t) = 6 AS complete, bool_and(year(period) * 12 + month(period) = k + t) AS calendar_ok FROM rel JOIN (SELECT unit, year(opening) * 12 + month(opening) AS k FROM units) USING (unit) WHERE treated AND t BETWEEN -6 AND -1 GROUP BY 1""", "units panel rel")
def _(s, d):
    k = R.units(s, d).select("unit", (F.year("opening") * 12 + F.month("opening")).alias("k"))
    r = rel(s, d).where("treated and t between -6 and -1").join(k, "unit")
    return r.groupBy("unit").agg((F.count_distinct("t") == 6).alias("complete"), F.bool_and(F.year("period") * 12 + F.month("period") == F.col("k") + F.col("t")).alias("calendar_ok"))


def vectors(s, d):
    return R.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", V.unit_norm(F.col("embedding")).alias("v"))


def near(s, d, k=5, step=1):
    """Neighbours of every row, or of the stated query set of ids divisible by a step, among all rows."""
    ready(s)
    v = vectors(s, d).select("id", "v").checkpoint()
    return V.nearest(v.where(F.col("id") % step == 0), v.select(F.col("id").alias("pid"), F.col("v").alias("pv")), k)


R.SQL["vecs"] = "SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"
R.SQL["knn"] = """SELECT id, pid, cosine FROM (SELECT a.id, b.id AS pid, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) AS cosine,
    row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.e, b.e) / sqrt(list_inner_product(b.e, b.e)) DESC, b.id) AS r FROM vecs a JOIN vecs b ON a.id <> b.id WHERE a.id % 20 = 0) WHERE r <= 5"""
R.SQL["knn_all"] = R.SQL["knn"].replace(" WHERE a.id % 20 = 0", "")


@query("knn_retrieval_score", """SELECT k.id, round(avg((a.label = b.label)::INT), 5) AS score, round(avg(cosine), 4) AS cosine FROM knn_all k JOIN vecs a ON a.id = k.id JOIN vecs b ON b.id = k.pid GROUP BY 1""", "vecs knn_all")
def _(s, d):
    lab = vectors(s, d).select("id", "label")
    j = near(s, d).join(lab, "id").join(lab.select(F.col("id").alias("pid"), F.col("label").alias("pl")), "pid")
    return j.groupBy("id").agg(F.round(F.avg((F.col("label") == F.col("pl")).cast("int")), 5).alias("score"), F.round(F.avg("cosine"), 4).alias("cosine"))


@query("retrieval_by_city", """SELECT k.id % 5 AS city, round(avg((a.label = b.label)::INT), 5) AS score, count(*) AS n FROM knn k JOIN vecs a ON a.id = k.id JOIN vecs b ON b.id = k.pid GROUP BY 1""", "vecs knn")
def _(s, d):
    lab = vectors(s, d).select("id", "label")
    j = near(s, d, step=20).join(lab, "id").join(lab.select(F.col("id").alias("pid"), F.col("label").alias("pl")), "pid")
    return j.groupBy((F.col("id") % 5).alias("city")).agg(F.round(F.avg((F.col("label") == F.col("pl")).cast("int")), 5).alias("score"), F.count("*").alias("n"))


@query("knn_predict", "SELECT k.id, round(avg(b.label), 5) AS predicted FROM knn_all k JOIN vecs b ON b.id = k.pid GROUP BY 1", "vecs knn_all")
def _(s, d):
    lab = vectors(s, d).select(F.col("id").alias("pid"), "label")
    return near(s, d).join(lab, "pid").groupBy("id").agg(F.round(F.avg("label"), 5).alias("predicted"))


R.SQL["resp"] = """SELECT unit, list(y ORDER BY k) AS v FROM (SELECT u.unit, k, y FROM units u CROSS JOIN (SELECT unnest(range(0, 24)) AS k) LEFT JOIN rel r ON r.unit = u.unit AND r.t = k) GROUP BY unit"""


def responses(s, d):
    full = R.units(s, d).select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("t"))
    j = full.join(rel(s, d).select("unit", "t", "y"), ["unit", "t"], "left").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("l"))
    return j.select("unit", F.transform("l", lambda x: x["y"]).alias("v"))


@query("masked_response_corr", """WITH p AS (SELECT a.unit AS a, b.unit AS b, unnest(a.v) AS x, unnest(b.v) AS y FROM resp a JOIN resp b ON a.unit < b.unit) SELECT a, b, round(corr(x, y), 4) AS r FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""", "units panel rel resp")
def _(s, d):
    ready(s)
    return V.masked_correlations(responses(s, d).checkpoint(), None, 2, 2048, digits=4)


@query("label_support_diagnostics", """SELECT n::INT AS common_cells, count(*) AS pairs FROM (SELECT a.unit, b.unit, len(list_filter(list_zip(a.v, b.v), lambda p: p[1] IS NOT NULL AND p[2] IS NOT NULL)) AS n FROM resp a JOIN resp b ON a.unit < b.unit) GROUP BY 1""", "units panel rel resp")
def _(s, d):
    bits = F.aggregate(F.transform("v", lambda x, i: F.when(x.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    masks = responses(s, d).select(bits.alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    return s.createDataFrame(V.pairs_by_common_cells(masks, 24), "common_cells int, pairs long")


@query("direction_auc", """WITH r AS (SELECT city, quality, rank() OVER (PARTITION BY city ORDER BY s) + (count(*) OVER (PARTITION BY city, s) - 1) / 2 AS m FROM (SELECT doc_id % 3 AS city, quality, doc_id * 7919 % 101 AS s FROM labels))
    SELECT city, count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0, round((sum(m) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 6) AS auc FROM r GROUP BY 1""")
def _(s, d):
    l = R.table(s, d, "labels").select((F.col("doc_id") % 3).alias("city"), "quality", (F.col("doc_id") * 7919 % 101).alias("s"))
    return V.rank_auc(l, ["city"], "s", "quality").withColumn("auc", F.round("auc", 6))


@query("trajectory_metrics", """SELECT event_time, round(avg(CASE WHEN abs(effect - 0.05) <= 0.1 THEN 0.5 * power(effect - 0.05, 2) ELSE 0.1 * (abs(effect - 0.05) - 0.05) END), 6) AS huber, round(avg(power(effect - 0.05, 2)), 6) AS mse, round(avg(abs(effect - 0.05)), 6) AS mae, round(avg((effect > 0)::INT), 6) AS sign_accuracy FROM effects WHERE effect IS NOT NULL GROUP BY 1""", EFF)
def _(s, d):
    e = F.col("effect") - 0.05
    return effects(s, d).where("effect is not null").groupBy("event_time").agg(
        F.round(F.avg(V.huber(e, 0.1)), 6).alias("huber"), F.round(F.avg(e * e), 6).alias("mse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg((F.col("effect") > 0).cast("int")), 6).alias("sign_accuracy")
    )


CONF = """conf AS (SELECT a, b, count(*) AS n FROM (SELECT CASE WHEN effect > 0.1 THEN 1 WHEN effect < -0.1 THEN -1 ELSE 0 END AS a, CASE WHEN treated % 3 = 0 THEN 1 WHEN treated % 3 = 1 THEN -1 ELSE 0 END AS b FROM effects WHERE effect IS NOT NULL) GROUP BY 1, 2)"""


@query("three_class_metrics", f"""WITH {CONF}, t AS (SELECT sum(n) AS t, sum(CASE WHEN a = b THEN n ELSE 0 END) AS hit FROM conf), x AS (SELECT a AS c, sum(n) AS na, sum(CASE WHEN a = b THEN n ELSE 0 END) AS h FROM conf GROUP BY 1), y AS (SELECT b AS c, sum(n) AS nb FROM conf GROUP BY 1),
    g AS (SELECT avg(2 * h / (na + coalesce(nb, 0))) AS f1, sum(na * coalesce(nb, 0)) AS ab FROM x LEFT JOIN y USING (c)) SELECT round(hit / t, 6) AS accuracy, round(f1, 6) AS macro_f1, round((hit / t - ab / (t * t)) / (1 - ab / (t * t)), 6) AS kappa FROM t, g""", EFF)
def _(s, d):
    pred = F.when(F.col("treated") % 3 == 0, 1).when(F.col("treated") % 3 == 1, -1).otherwise(0)
    conf = effects(s, d).where("effect is not null").groupBy(V.three_class(F.col("effect"), 0.1).alias("a"), pred.alias("b")).agg(F.count("*").alias("n"))
    return V.macro_f1(conf, "a", "b", "n").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "kappa")])


@query("direction_baseline", """SELECT city, round(avg((effect > 0)::INT), 6) AS positive, round(greatest(avg((effect > 0)::INT), 1 - avg((effect > 0)::INT)), 6) AS majority FROM lab WHERE effect IS NOT NULL GROUP BY 1""", EFF2)
def _(s, d):
    p = F.avg((F.col("effect") > 0).cast("int"))
    return labels(s, d).where("effect is not null").groupBy("city").agg(F.round(p, 6).alias("positive"), F.round(F.greatest(p, 1 - p), 6).alias("majority"))


@query("paired_city_delta", """SELECT a.city, round(avg(abs(a.effect) - abs(b.effect)), 5) AS delta, count(*) AS n FROM lab a JOIN lab b ON a.treated = b.treated AND a.event_time = 6 AND b.event_time = 3 WHERE a.effect IS NOT NULL AND b.effect IS NOT NULL GROUP BY 1""", EFF2)
def _(s, d):
    e = labels(s, d).where("effect is not null")
    j = e.where("event_time = 6").select("treated", "city", F.abs("effect").alias("a")).join(e.where("event_time = 3").select("treated", F.abs("effect").alias("b")), "treated")
    return j.groupBy("city").agg(F.round(F.avg(F.col("a") - F.col("b")), 5).alias("delta"), F.count("*").alias("n"))


@query("amplitude_direction", """SELECT round(sqrt(avg(power(effect, 2))), 5) AS pooled, round(avg(r), 5) AS macro FROM (SELECT event_time, effect, sqrt(avg(power(effect, 2)) OVER (PARTITION BY event_time)) AS r FROM effects WHERE effect IS NOT NULL)""", EFF)
def _(s, d):
    e = effects(s, d).where("effect is not null")
    r = F.sqrt(F.avg(F.col("effect") * F.col("effect")).over(Window.partitionBy("event_time")))
    return e.withColumn("r", r).agg(F.round(F.sqrt(F.avg(F.col("effect") * F.col("effect"))), 5).alias("pooled"), F.round(F.avg("r"), 5).alias("macro"))


X = [f"x{k}" for k in range(8)]


def probe_rows(s, d):
    e = R.table(s, d, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[k].cast("double").alias(x) for k, x in enumerate(X)])


@query("ridge_probe")
def _(s, d):
    e = probe_rows(s, d)
    beta = V.ridge(e.where("vec_id % 5 > 0"), "label", X, 1.0)
    err = F.col("label") - V.predict(X, beta)
    return e.where("vec_id % 5 = 0").agg(F.round(F.sqrt(F.avg(err * err)), 5).alias("rmse"), F.count("*").alias("n"))


@query("ridge_select")
def _(s, d):
    e, rows = probe_rows(s, d), []
    for penalty in (0.1, 1.0, 10.0):
        err = F.col("label") - V.predict(X, V.ridge(e.where("vec_id % 5 > 1"), "label", X, penalty))
        rows.append((penalty, float(e.where("vec_id % 5 = 1").agg(F.sqrt(F.avg(err * err))).first()[0])))
    best = min(rows, key=lambda r: (r[1], r[0]))[0]
    return s.createDataFrame([(p, round(r, 5), p == best) for p, r in rows], "penalty double, rmse double, chosen boolean")


@query("cv_probe")
def _(s, d):
    e, rows = probe_rows(s, d), []
    for fold in range(4):
        err = F.col("label") - V.predict(X, V.ridge(e.where(f"vec_id % 4 <> {fold}"), "label", X, 1.0))
        r = e.where(f"vec_id % 4 = {fold}").agg(F.sqrt(F.avg(err * err)), F.count("*")).first()
        rows.append((fold, round(float(r[0]), 5), r[1]))
    return s.createDataFrame(rows, "fold int, rmse double, n long")


@query("bootstrap_mean_ci")
def _(s, d):
    e = effects(s, d).where("effect is not null").groupBy("treated").agg(F.avg("effect").alias("m"))
    b = V.resampled(e, "treated", 200, 11).groupBy("rep").agg(F.try_divide(F.sum(F.col("m") * F.col("weight")), F.sum("weight")).alias("m"))
    return b.agg(*[F.round(F.percentile("m", p), 6).alias(n) for p, n in ((0.025, "low"), (0.975, "high"))], F.count("*").alias("reps"))


@query("permutation_test")
def _(s, d):
    ready(s)
    t = V.permuted_correlations(R.table(s, d, "labels"), "quality", "toxic", ["doc_id"], 50).withColumn("r", F.abs("r"))
    seen = F.max(F.when(F.col("rep") == 0, F.col("r")))
    g = t.agg(seen.alias("seen"), F.collect_list(F.when(F.col("rep") > 0, F.col("r"))).alias("null"))
    return g.select(F.round("seen", 6).alias("seen"), F.round((F.size(F.filter("null", lambda x: x >= F.col("seen"))) + 1) / (F.size("null") + 1), 6).alias("p"))


@query("kmeans_embedding")
def _(s, d):
    v = R.table(s, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=5, seed=1, maxIter=10).fit(v)
    return model.transform(v).groupBy("prediction").agg(F.count("*").alias("n"))


@query("linear_projection")
def _(s, d):
    v = R.table(s, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="p").fit(v.where("vec_id % 5 > 0"))
    out = model.transform(v).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.round(F.abs(F.col("p")[0]), 4).alias("p1"), F.round(F.abs(F.col("p")[1]), 4).alias("p2"))


@query("block_fusion", """WITH f AS (SELECT vec_id, e[1] AS a, e[2] AS b FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f WHERE vec_id % 5 > 0)
    SELECT vec_id, round(za / sqrt(za * za + zb * zb), 4) AS a, round(zb / sqrt(za * za + zb * zb), 4) AS b FROM (SELECT vec_id, (a - ma) / sa AS za, (b - mb) / sb AS zb FROM f, m)""")
def _(s, d):
    e = R.table(s, d, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("ab")])
    m = e.where("vec_id % 5 > 0").agg(*[f(c).alias(n + c) for c in "ab" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = e.crossJoin(F.broadcast(m)).select("vec_id", V.unit_norm(F.array(*[(F.col(c) - F.col("m" + c)) / F.col("s" + c) for c in "ab"])).alias("z"))
    return z.select("vec_id", F.round(F.col("z")[0], 4).alias("a"), F.round(F.col("z")[1], 4).alias("b"))


