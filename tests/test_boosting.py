"""Boosted trees against trees grown by plain sums, and models against closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bandseries.operators import boosting, models
from bandseries.operators.boosting import BoostedTrees


def data(n=300, features=4, classes=2, seed=3, holes=True):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, 1, (n, features)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, -1] > 0.2).astype(int) if classes == 2 else np.digitize(x[:, 0] + 0.3 * x[:, 1], [-0.5, 0.5])
    if holes:
        x[r.random(x.shape) < 0.1] = np.nan
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([(k, [float(v) for v in row], int(c)) for k, (row, c) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label int")


def plain(x, y, keys, classes, rounds, depth, eta, lam, alpha, gamma, least, rows_share, columns_share, bins, seed):
    """Probabilities after the rounds, by recursion over rows and all cuts."""
    n, width = x.shape
    cuts = []
    for column in x.T:
        known = sorted(v for v in column if not math.isnan(v))
        cuts.append(sorted({known[math.ceil(k / bins * len(known)) - 1] for k in range(1, bins)}))
    shrunk = lambda g: math.copysign(max(abs(g) - alpha, 0), g)
    worth = lambda g, h: shrunk(g) ** 2 / (h + lam)
    margins = np.zeros((n, classes))
    for turn in range(rounds):
        if classes == 1:
            p = 1 / (1 + np.exp(-margins))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(margins)
            p /= p.sum(1, keepdims=True)
            g, h = p - np.eye(classes)[y], 2 * p * (1 - p)
        columns = sorted(random.Random(f"{seed}/{turn}").sample(range(width), max(1, round(columns_share * width))))
        into = boosting.drawn(keys, seed, turn, rows_share)
        step = np.zeros_like(margins)
        for k in range(classes):

            def tree(rows, level, k=k, g=g, h=h, into=into, columns=columns):
                """(splits below, where each row ends) of the node of these rows."""
                own = [r for r in rows if into[r]]
                gs, hs = sum(g[r, k] for r in own), sum(h[r, k] for r in own)
                leaf = {r: eta * -shrunk(gs) / (hs + lam) for r in rows}
                best = (boosting.LEAST, None)
                if level < depth:
                    for f in columns:
                        for c in cuts[f]:
                            for missing in (False, True):
                                low = [r for r in own if (missing if math.isnan(x[r, f]) else x[r, f] < c)]
                                gl, hl = sum(g[r, k] for r in low), sum(h[r, k] for r in low)
                                if hl >= least and hs - hl >= least:
                                    got = round(worth(gl, hl) + worth(gs - gl, hs - hl) - worth(gs, hs), 9)
                                    if got > best[0]:
                                        best = (got, (f, c, missing))
                if best[1] is None:
                    return False, leaf
                f, c, missing = best[1]
                goes = {r: (missing if math.isnan(x[r, f]) else x[r, f] < c) for r in rows}
                below = [tree([r for r in rows if goes[r] == side], level + 1) for side in (True, False)]
                if not (below[0][0] or below[1][0]) and best[0] < gamma:
                    return False, leaf
                return True, below[0][1] | below[1][1]

            for r, v in tree(list(range(n)), 0)[1].items():
                step[r, k] = v
        margins += step
    if classes == 1:
        p = 1 / (1 + np.exp(-margins))
        return np.concatenate((1 - p, p), 1)
    p = np.exp(margins)
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize(
    ("classes", "settings"),
    [
        (2, {"maxIter": 3, "maxDepth": 3, "stepSize": 0.4, "regLambda": 0.5, "regAlpha": 0.3, "gamma": 0.5, "minChildWeight": 2.0, "subsamplingRate": 0.7, "columnRate": 0.5}),
        (2, {"maxIter": 2, "maxDepth": 2, "stepSize": 0.3}),
        (3, {"maxIter": 2, "maxDepth": 2, "stepSize": 0.5, "regAlpha": 0.2, "gamma": 0.2, "subsamplingRate": 0.8, "columnRate": 0.75}),
    ],
)
def test_equal_to_plain_trees(spark, classes, settings):
    x, y = data(classes=classes)
    rows = table(spark, x, y).repartition(3)
    keys = dict(rows.select("id", F.xxhash64(F.col("features"), F.col("label"))).collect())
    keys = np.asarray([keys[k] for k in range(len(y))], np.int64).view(np.uint64)
    model = BoostedTrees(maxBins=6, seed=7, **settings).fit(rows)
    got = dict(model.transform(rows).select("id", vector_to_array("probability")).collect())
    s = {"stepSize": 0.3, "regLambda": 1.0, "regAlpha": 0.0, "gamma": 0.0, "minChildWeight": 1.0, "subsamplingRate": 1.0, "columnRate": 1.0} | settings
    want = plain(x, y, keys, 1 if classes == 2 else classes, s["maxIter"], s["maxDepth"], s["stepSize"], s["regLambda"], s["regAlpha"], s["gamma"], s["minChildWeight"], s["subsamplingRate"], s["columnRate"], 6, 7)
    assert np.allclose(np.asarray([got[k] for k in range(len(y))]), want, atol=1e-9)


def test_margins_are_kept_over_many_rounds(spark):
    x, y = data(n=60, features=2)
    rows = table(spark, x, y)
    model = BoostedTrees(maxIter=boosting.KEEP + 3, maxDepth=1, maxBins=4).fit(rows)
    keys = np.zeros(60, np.uint64)
    want = plain(x, y, keys, 1, boosting.KEEP + 3, 1, 0.3, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 4, 42)
    got = dict(model.transform(rows).select("id", vector_to_array("probability")).collect())
    assert np.allclose(np.asarray([got[k] for k in range(60)]), want, atol=1e-9)


def test_saved_model_scores_alike(spark, tmp_path):
    x, y = data(n=80, features=2, holes=False)
    rows = models.with_vector(table(spark, x, y).withColumn("label", F.col("label").cast("double")), "features")
    for kind, how in {"boosted": {"maxIter": 2, "maxDepth": 2}, "linear": {"maxIter": 5}, "forest": {"numTrees": 3, "seed": 1}}.items():
        model = models.fit(rows, kind, **how)
        model.write().overwrite().save(f"{tmp_path}/{kind}")
        again = PipelineModel.load(f"{tmp_path}/{kind}")
        one, two = (sorted(map(tuple, models.score(m, rows, "m").collect())) for m in (model, again))
        assert one == two
        assert all(r[4] == int(r[3] >= 0.5) for r in one)


def test_odd_rows(spark):
    rows = spark.createDataFrame([([1.0], 0), ([2.0], 1), (None, 1), ([3.0], None), ([4.0], -1), ([5.0], 9), ([math.nan], 1)] * 4, "features array<double>, label int")
    model = BoostedTrees(maxIter=1, numClasses=2, minChildWeight=0.0).fit(rows)
    assert len(model.rounds()) == 1
    none = BoostedTrees(maxIter=1).fit(rows.limit(0)).transform(rows.filter("features IS NOT NULL"))
    assert {tuple(r[0]) for r in none.select(vector_to_array("probability")).collect()} == {(0.5, 0.5)}


def test_every_parameter_of_the_search_is_used():
    for draw in models.trials("boosted", 5):
        made = models.classifier("boosted", **draw)
        assert {k: made.getOrDefault(made.getParam(k)) for k in draw} == draw


def test_search_balances_once_for_each_fold_and_agrees_with_plain_validation(spark, monkeypatch):
    x, y = data(n=120, features=3, holes=False)
    rows = models.with_vector(table(spark, x, y).withColumn("label", F.col("label").cast("double")), "features")
    calls = []
    monkeypatch.setattr(models, "balanced", lambda *a, real=models.balanced, **k: calls.append(1) or real(*a, **k))
    model, table_ = models.search(rows, "linear", 2, folds=3, balance=True, maxIter=5)
    assert len(calls) == 3 + 1
    placed = models.stratified_folds(rows, "label", "id", 3, 42).persist()
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    judge, draws = MulticlassClassificationEvaluator(metricName="f1"), models.trials("linear", 2)
    for r in table_.collect():
        each = [judge.evaluate(models.fit(placed.filter(F.col("fold") != k), "linear", True, maxIter=5, **draws[r["trial"]]).transform(placed.filter(F.col("fold") == k))) for k in range(3)]
        assert r["f1"] == pytest.approx(sum(each) / 3, abs=1e-6)
    assert {"probability", "prediction"} <= set(model.transform(rows).columns)


def test_weak_trials_stop_early(spark):
    x, y = data(n=120, features=3, holes=False)
    rows = models.with_vector(table(spark, x, y).withColumn("label", F.col("label").cast("double")), "features")
    space = {"regParam": [0.001, 1000.0], "elasticNetParam": [0.0]}
    got = models.search(rows, "linear", 6, folds=3, space=space, margin=0.05, maxIter=10)[1].collect()
    weak = {r["trial"] for r in got if r["params"]["regParam"] == "1000.0"}
    assert weak
    assert all((r["f1"] is None, r["folds"]) == ((True, 1) if r["trial"] in weak else (False, 3)) for r in got)


def test_logistic_weights_are_those_of_newtons_method(spark):
    x, y = data(n=200, features=3, holes=False)
    rows = models.with_vector(table(spark, x, y).withColumn("label", F.col("label").cast("double")), "features")
    made = models.fit(rows, "linear", maxIter=200, tol=1e-12, regParam=0.05, standardization=False).stages[-1]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    a = np.concatenate((z, np.ones((len(z), 1))), 1)
    w, penalty = np.zeros(4), np.diag([0.05] * 3 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + penalty, a.T @ (p - y) / len(y) + penalty @ w)
    assert np.allclose([*made.coefficients.toArray(), made.intercept], w, atol=1e-5)


def test_one_split_of_a_forest_is_the_purest(spark):
    x, y = data(n=200, features=3, holes=False)
    rows = models.with_vector(table(spark, x, y).withColumn("label", F.col("label").cast("double")), "features")
    made = models.fit(rows, "forest", numTrees=1, maxDepth=1, maxBins=200, featureSubsetStrategy="all", bootstrap=False, seed=1)
    got = models.score(made, rows, "m").groupBy("score").count().collect()
    gini = lambda c: len(c) * (1 - c.mean() ** 2 - (1 - c.mean()) ** 2) if len(c) else 0.0
    best = min((gini(y[x[:, f] <= c]) + gini(y[x[:, f] > c]), f, c) for f in range(3) for c in np.unique(x[:, f])[:-1])
    low = y[x[:, best[1]] <= best[2]]
    assert sorted((round(r["score"], 9), r["count"]) for r in got) == sorted([(round(low.mean(), 9), len(low)), (round((y.sum() - low.sum()) / (len(y) - len(low)), 9), len(y) - len(low))])


def test_a_separable_line_is_ranked_in_order(spark):
    rows = models.with_vector(spark.createDataFrame([(k, [k / 10], float(k >= 30)) for k in range(60)], "id long, features array<double>, label double"), "features")
    for kind in ("linear", "boosted"):
        got = [r["score"] for r in models.score(models.fit(rows, kind, maxIter=10), rows, "m").orderBy("object_id").collect()]
        assert got == sorted(got)
        assert got[0] < 0.5 < got[-1]


def test_cuts_of_many_rows_are_exact(spark):
    from bandseries.operators.boosting import bin_cuts

    x = np.random.default_rng(5).normal(size=(60_000, 2)).round(6)
    x[::7, 1] = 0.25
    x[::11, 0] = np.nan
    rows = spark.createDataFrame([(r,) for r in x.tolist()], "x array<double>")
    got = bin_cuts(rows, 2, 8)
    for f in (0, 1):
        v = np.sort(x[~np.isnan(x[:, f]), f])
        assert got[f] == sorted({float(v[-(-len(v) * k // 8) - 1]) for k in range(1, 8)})
