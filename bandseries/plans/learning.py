"""Queries of balance, metrics, curves, bootstrap, models and sinks over embeddings, labels and documents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import balance, bootstrap, curves, fill, metrics, models, report, sequences, splits
from ..operators.boosting import BoostedTrees
from ..schemas import RESULTS
from ..sources import tables as T
from . import series
from .boosted_sql import boosted_sql
from .tables import SCORED, features, scored, table, uniform_sql

NAMES = {0: "poor", 1: "good"}
THRESHOLDS = [0.1 + k * 0.8 / 49 for k in range(50)]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def onehot_argmax(spark: SparkSession, d: str) -> DataFrame:
    hot = features(spark, d).select("vec_id", "label", S.one_hot(F.col("label"), 10).alias("hot"))
    return hot.select("vec_id", S.argmax(F.col("hot")).alias("back"), F.aggregate("hot", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("hot", F.col("label") + 1).alias("at"))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").withColumn("split", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train"))
    return rounded(balance.class_counts(rows, "split", "quality"), "share")


def imbalance_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(balance.imbalance_ratio(table(spark, d, "labels"), ["toxic"], "quality"), "ratio")


def standardise(spark: SparkSession, d: str) -> DataFrame:
    rows = models.with_vector(features(spark, d), "embedding")
    z = models.standardise(rows, rows)
    return rounded(z.select("vec_id", F.posexplode(vector_to_array("scaled")).alias("dim", "z")), "z")


def minority(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as an unbalanced two-class problem: label 1 against the rest."""
    return features(spark, d).select("vec_id", "embedding", (F.col("label") == 1).cast("int").alias("label"))


def class_knn(spark: SparkSession, d: str) -> DataFrame:
    out = balance.class_neighbours(features(spark, d), "vec_id", "label", "embedding")
    return rounded(out, "distance")


def smote(spark: SparkSession, d: str) -> DataFrame:
    made = balance.smote(minority(spark, d), "vec_id", "label", "embedding")
    return rounded(made.select("draw", "base", "neighbour", "step", F.posexplode("embedding").alias("dim", "x")), "step", "x")


def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_folds(features(spark, d), "label", "vec_id").select("vec_id", "label", "fold")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(scored(spark, d), [0, 1])


def class_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.class_report(metrics.confusion(scored(spark, d), [0, 1]), NAMES), "precision", "recall", "f1")


def weighted_prf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.weighted_prf(metrics.confusion(scored(spark, d), [0, 1])), "precision", "recall", "f1", "accuracy")


def fp_fn(spark: SparkSession, d: str) -> DataFrame:
    return metrics.binary_counts(scored(spark, d), 1).select("fp", "fn")


def spcc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.figure_of_merit(metrics.binary_counts(scored(spark, d), 1)), "fom")


def totals(spark: SparkSession, d: str) -> DataFrame:
    return curves.score_totals(scored(spark, d))


def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.roc_curve(totals(spark, d)), "fpr", "tpr")


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.roc_auc(totals(spark, d)), "roc_auc")


def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.pr_curve(totals(spark, d)), "precision", "recall")


def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.pr_auc(totals(spark, d)), "pr_auc")


def gain_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.gain_curve(totals(spark, d)), "ranked", "gain")


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.threshold_sweep(scored(spark, d), THRESHOLDS), "threshold", "precision", "recall", "f1")


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.score_histogram(scored(spark, d)), "lower", "density")


def score_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.score_density(scored(spark, d)).drop("x"), "density")


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    each = bootstrap.iteration_metrics(bootstrap.resampled(rows, "doc_id", 1000))
    point = report.model_metrics(rows.withColumn("model", F.lit("all"))).select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in bootstrap.MEASURES))))
    return rounded(bootstrap.against_point(bootstrap.intervals(each), point), "mean", "lower", "upper", "point", "below", "above")


def stacked(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of three scores: the length's, its opposite, and toxicity's."""
    rows = scored(spark, d)
    ways = {"length": F.col("score"), "short": F.round(1 - F.col("score"), 3), "clean": (1 - F.col("toxic")).cast("double")}
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("model"), v.alias("score")) for k, v in ways.items())))
    out = rows.select("doc_id", "label", each)
    return out.withColumn("pred", S.predicted(F.col("score"))).withColumn("dataset", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))


PARAMS = {"length": {"max_depth": "38", "learning_rate": "0.1039612345", "max_features": "None"}, "short": {"n_estimators": "600"}}


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    results = spark.createDataFrame([(m, None, None, None, None, p) for m, p in PARAMS.items()], RESULTS)
    return rounded(report.comparison(stacked(spark, d), results), "precision", "recall", "f1", "roc_auc", "pr_auc")


def dataset_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.by_dataset(stacked(spark, d), ["even", "odd"]), "even", "odd")


def params_text(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d)
    made = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("first"), F.col("embedding")[0].cast("double").cast("decimal(20,10)").cast("string"))
    shown = rows.select("vec_id", S.params_text(made, 3).alias("text"))
    return shown.select("vec_id", F.regexp_extract("text", "label: (.*)$", 1).alias("label"), F.regexp_extract("text", "^first: ([^,]*)", 1).cast("double").alias("first"))


def binary_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = minority(spark, d).select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("double").alias("label"))
    return models.with_vector(rows, "embedding").drop("embedding")


def train_test(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = binary_rows(spark, d)
    return splits.route(rows, splits.split_objects(splits.object_ids(rows, "id"), key="id"), "id")


def linear_model(spark: SparkSession, d: str) -> DataFrame:
    """Ten classes at once."""
    rows = models.with_vector(features(spark, d), "embedding").select(F.col("vec_id").alias("id"), "features", F.col("label").cast("double").alias("label"))
    train, test = splits.route(rows, splits.split_objects(splits.object_ids(rows, "id"), key="id"), "id")
    return models.fit(train, "linear", maxIter=30, family="multinomial").transform(test).select("id", "label", "prediction")


def forest_model(spark: SparkSession, d: str) -> DataFrame:
    train, test = train_test(spark, d)
    return models.score(models.fit(train, "forest", numTrees=20, maxDepth=38, seed=42), test, "forest")


def gbt_model(spark: SparkSession, d: str) -> DataFrame:
    train, test = train_test(spark, d)
    return models.score(models.fit(train, "boosted", balance=True, maxIter=5, maxDepth=3, seed=42), test, "boosted")


BOOSTED = {"maxDepth": 2, "stepSize": 0.4, "regLambda": 0.5, "regAlpha": 0.2, "gamma": 0.3, "maxBins": 8}


def boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """Two classes, three rounds, with both penalties on leaves and a floor on gains."""
    rows = binary_rows(spark, d)
    made = BoostedTrees(maxIter=3, **BOOSTED).fit(rows).transform(rows)
    return rounded(made.select("id", vector_to_array("probability")[1].alias("score"), "prediction"), "score")


def boosted_classes(spark: SparkSession, d: str) -> DataFrame:
    """Ten classes, a tree for each in every round."""
    rows = features(spark, d).select(F.col("vec_id").alias("id"), "embedding", "label")
    made = BoostedTrees(featuresCol="embedding", numClasses=10, maxIter=2, **BOOSTED).fit(rows).transform(rows)
    return rounded(made.select("id", F.posexplode(vector_to_array("probability")).alias("label", "p")), "p")


def cv_objective(spark: SparkSession, d: str) -> DataFrame:
    return models.search(binary_rows(spark, d), "linear", 2, folds=3, balance=True, maxIter=10)[1].select("trial", "f1")


def batch_scoring(spark: SparkSession, d: str) -> DataFrame:
    """A saved pipeline, loaded again, scores with the scaler it was fitted with."""
    train, test = train_test(spark, d)
    path = T.scratch(spark, "model")
    T.save_model(models.fit(train, "linear", maxIter=10), path)
    predictions = models.score_all({"linear": T.load_model(path)}, test)
    return report.model_metrics(predictions)


def flat_io(spark: SparkSession, d: str) -> DataFrame:
    """Two passes with the host's redshift, written apart and read together."""
    rows = fill.passes(series.aligned(spark, d), 2).withColumns({"hostz": (F.col("object_id") % 9) / 10, "ra": F.lit(52.5), "decl": F.lit(-27.5), "mwebv": F.lit(0.0096), "sim_z": F.lit(0.49), "class_code": (F.col("object_id") % 3 + 1).cast("int")})
    path = T.scratch(spark, "flat")
    T.write_flat(rows, path, with_host=True, fmt="csv")
    return T.read_flat(spark, path, with_host=True, fmt="csv").select("pass", "object_id", F.round("t", 6).alias("t"), F.round("hostz", 6).alias("hostz"), "g", "r", "i", "z", "class_code")


def gather(spark: SparkSession, d: str) -> DataFrame:
    """Rows taken by position, some of them often and some never."""
    rows = features(spark, d).select(F.col("vec_id").alias("position"), "label")
    return splits.gather(rows, rows.select((F.col("position") * F.col("position") % 500).alias("position")), "position")


def fold_means(spark: SparkSession, d: str) -> DataFrame:
    """Two thresholds as trials, their weighted F1 in five folds, and the means over these."""
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("trial"), F.lit(t).alias("least")) for k, t in enumerate((0.3, 0.5)))))
    rows = scored(spark, d).select("label", "score", (F.col("doc_id") % 5).alias("fold"), each)
    counts = metrics.confusion(rows.withColumn("pred", (F.col("score") >= F.col("least")).cast("int")), [0, 1], ["trial", "fold"])
    return rounded(report.mean_over_folds(metrics.weighted_prf(counts, ["trial", "fold"])), "f1")


def all_models(spark: SparkSession, d: str) -> DataFrame:
    """Every family plain and balanced, and one after a search, scored on one test split: what must hold of any model, and learnt: its area on the rows it was fitted on is above that of random scores, by more than chance gives.

    The labels here follow no rule that holds for other rows, so nothing can be asked of the area on the test split.
    """
    train, test = train_test(spark, d)
    small = {"linear": {"maxIter": 10}, "forest": {"numTrees": 10, "maxDepth": 5, "seed": 42}, "boosted": {"maxIter": 3, "maxDepth": 3, "seed": 42}}
    tried = {"boosted": {"n": 2, "folds": 2, "space": {"maxIter": [3], "maxDepth": [3]}}}
    fitted = models.train_all(train, small, searches=tried)
    rows, known = models.score_all(fitted, test), T.stored(models.score_all(fitted, train), "predictions")
    sure = F.bool_and((F.col("score") >= 0) & (F.col("score") <= 1) & (F.col("pred") == (F.col("score") >= 0.5).cast("int")))
    held = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object_id").alias("n_objects"), F.sum("label").alias("positives"), sure.alias("sure"))
    areas = curves.learnt(curves.score_totals(known, 1, ["model"]), ["model"])
    return held.join(areas.select("model", "learnt"), "model")


def dataset_io(spark: SparkSession, d: str) -> DataFrame:
    data = series.sequence(spark, d).join(splits.split_objects(splits.object_ids(series.observations(spark, d))), "object_id")
    path = T.scratch(spark, "dataset")
    T.save_dataset(data, path)
    back = T.load_dataset(spark, path, data.schema)
    return sequences.exploded(back, ["t", "g", "r", "i", "z"]).join(back.select("object_id", "split"), "object_id")


def results_io(spark: SparkSession, d: str) -> DataFrame:
    made = report.model_metrics(stacked(spark, d)).select("model", "precision", "recall", F.col("f1").alias("f1_score"), "roc_auc", F.create_map(F.lit("from"), F.lit("labels")).alias("best_params"))
    path = T.scratch(spark, "results")
    T.save_results(made, path)
    back = T.load_results(spark, [path, f"{path}-missing"])
    return rounded(T.with_results(back.drop("best_params"), back).withColumn("best_params", S.params_text(F.col("best_params"))), "precision", "recall", "f1_score", "roc_auc")


QUERIES = {
    f.__name__: f
    for f in (
        onehot_argmax, class_counts, imbalance_ratio, standardise, class_knn, smote, stratified_folds, confusion, class_report, weighted_prf, fp_fn, spcc,
        roc_curve, roc_auc, pr_curve, pr_auc, gain_curve, threshold_sweep, score_histogram, score_density, bootstrap_ci, model_comparison, dataset_comparison,
        params_text, linear_model, forest_model, gbt_model, cv_objective, batch_scoring, flat_io, dataset_io, results_io,
        gather, fold_means, all_models, boosted_trees, boosted_classes,
    )
}

# --- SQL ---------------------------------------------------------------------------------------------------------------


def _prf(source: str, keys: str, weight: str = "1") -> str:
    """Weighted precision, recall, F1 and accuracy of binary rows of `source`, per keys, as a query."""
    g = f"GROUP BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""
        SELECT {k}n0, n1, tp, fp, fn, tn, p0, r0, p1, r1, f0, f1_, n0 + n1 AS support, (n0 * p0 + n1 * p1) / (n0 + n1) AS precision, (n0 * r0 + n1 * r1) / (n0 + n1) AS recall, (n0 * f0 + n1 * f1_) / (n0 + n1) AS f1, (tp + tn) / (n0 + n1) AS accuracy
        FROM (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1_
              FROM (SELECT *, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(n0, 0), 0) AS r0, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(n1, 0), 0) AS r1
                    FROM (SELECT {k}sum(CASE WHEN label = 0 THEN {weight} ELSE 0 END)::DOUBLE AS n0, sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END)::DOUBLE AS n1,
                                 sum(CASE WHEN label = 1 AND pred = 1 THEN {weight} ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN label = 0 AND pred = 1 THEN {weight} ELSE 0 END)::DOUBLE AS fp,
                                 sum(CASE WHEN label = 1 AND pred = 0 THEN {weight} ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN label = 0 AND pred = 0 THEN {weight} ELSE 0 END)::DOUBLE AS tn
                          FROM {source} {g})))"""


def _totals(source: str, keys: str = "", weight: str = "1") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
        SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n
        FROM (SELECT {k}score, sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE {weight} END)::DOUBLE AS neg FROM {source} GROUP BY {k}score)"""


_ROC = "sum(neg * (2 * tp - pos)) / (2 * any_value(p) * any_value(n))"
_PR = "sum(pos * (coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), 1) + tp / (tp + fp))) / (2 * any_value(p))"
_TOT = f"WITH {SCORED}, tot AS ({_totals('scored')})"
_STACK = f"""{SCORED}, stacked AS (
    SELECT doc_id, label, model, s AS score, CAST(s >= 0.5 AS INTEGER) AS pred, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset
    FROM (SELECT doc_id, label, unnest(['length', 'short', 'clean']) AS model, unnest([score, round(1 - score, 3), (1 - toxic)::DOUBLE]) AS s FROM scored))"""
_MODELS = f"""WITH {_STACK}, prf AS ({_prf('stacked', 'model')}), tot AS ({_totals('stacked', 'model')}),
    area AS (SELECT model, {_ROC} AS roc_auc, {_PR} AS pr_auc FROM tot GROUP BY model)"""
_STEPS = ", ".join(f"{c!r}" for c in bootstrap.poisson_steps())
_THR = ", ".join(f"{t!r}::DOUBLE" for t in THRESHOLDS)
_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))))"
_U = lambda what: uniform_sql("'42'", "label", "draw", f"'{what}'")
_KNN = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM (SELECT a.vec_id, a.label, b.vec_id AS neighbour, {_DIST} AS distance FROM src a JOIN src b ON a.label = b.label AND a.vec_id <> b.vec_id)) WHERE rank <= 5"

ORACLE = {
    "onehot_argmax": "SELECT vec_id, label AS back, 1.0::DOUBLE AS total, 1.0::DOUBLE AS at FROM embeddings",
    "class_counts": """
        WITH r AS (SELECT quality, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM labels),
        c AS (SELECT quality, split, count(*) AS n FROM r GROUP BY quality, split UNION ALL SELECT quality, NULL, count(*) FROM r GROUP BY quality)
        SELECT quality, split, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM c""",
    "imbalance_ratio": "SELECT toxic, max(n) AS majority, min(n) AS minority, round(max(n) / min(n), 6) AS ratio FROM (SELECT toxic, quality, count(*) AS n FROM labels GROUP BY toxic, quality) GROUP BY toxic",
    "standardise": """
        WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
        s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY dim)
        SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END, 6) AS z FROM x JOIN s USING (dim)""",
    "class_knn": f"WITH src AS (SELECT vec_id, label, embedding FROM embeddings) SELECT vec_id, label, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) AS distance FROM ({_KNN})",
    "smote": f"""
        WITH src AS (SELECT vec_id, embedding, 1 AS label FROM embeddings WHERE label = 1),
        sizes AS (SELECT (SELECT count(*) FROM src) AS n, (SELECT count(*) FROM embeddings) - (SELECT count(*) FROM src) AS most),
        placed AS (SELECT vec_id AS base, embedding AS x, row_number() OVER (ORDER BY {uniform_sql("'42'", 'vec_id')}, vec_id) - 1 AS place FROM src),
        draws AS (SELECT 1 AS label, n, unnest(range(0, most - n)) AS draw FROM sizes),
        knn AS ({_KNN}), held AS (SELECT vec_id, count(*) AS k FROM knn GROUP BY vec_id),
        picked AS (
            SELECT draw, base, x, {_U('step')} AS step, CAST(floor({_U('neighbour')} * k) + 1 AS BIGINT) AS rank
            FROM draws JOIN placed ON place = CAST(floor({_U('row')} * n) AS BIGINT) JOIN held ON held.vec_id = base)
        SELECT draw, base, neighbour, round(step, 6) AS step, CAST(d.dim AS INTEGER) AS dim, round(x[d.dim + 1]::DOUBLE + step * (y.embedding[d.dim + 1]::DOUBLE - x[d.dim + 1]::DOUBLE), 6) AS x
        FROM picked p JOIN knn k ON k.vec_id = p.base AND k.rank = p.rank JOIN embeddings y ON y.vec_id = neighbour, (SELECT unnest(range(0, 64)) AS dim) d""",
    "stratified_folds": f"SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {uniform_sql(chr(39) + '42' + chr(39), 'vec_id')}, vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings",
    "confusion": f"WITH {SCORED} SELECT CAST(a.c AS INTEGER) AS label, CAST(b.c AS INTEGER) AS pred, (SELECT count(*) FROM scored s WHERE s.label = a.c AND s.pred = b.c) AS n FROM (SELECT unnest([0, 1]) AS c) a, (SELECT unnest([0, 1]) AS c) b",
    "class_report": f"""
        WITH {SCORED}, m AS ({_prf('scored', '')}), r AS (
            SELECT 'poor' AS name, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM m UNION ALL SELECT 'good', p1, r1, f1_, n1 FROM m
            UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, support FROM m UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1_) / 2, support FROM m
            UNION ALL SELECT 'weighted avg', precision, recall, f1, support FROM m)
        SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r""",
    "weighted_prf": f"WITH {SCORED} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM ({_prf('scored', '')})",
    "fp_fn": f"WITH {SCORED} SELECT CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM ({_prf('scored', '')})",
    "spcc": f"WITH {SCORED} SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(coalesce(tp * tp / nullif((tp + fn) * (tp + 3 * fp), 0), 0), 6) AS fom FROM ({_prf('scored', '')})",
    "roc_curve": f"{_TOT} SELECT score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM tot UNION ALL SELECT NULL, 0.0, 0.0",
    "roc_auc": f"{_TOT} SELECT round({_ROC}, 6) AS roc_auc FROM tot",
    "pr_curve": f"{_TOT} SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM tot UNION ALL SELECT NULL, 1.0, 0.0",
    "pr_auc": f"{_TOT} SELECT round({_PR}, 6) AS pr_auc FROM tot",
    "gain_curve": f"{_TOT} SELECT score AS threshold, round((tp + fp) / (p + n), 6) AS ranked, round(tp / p, 6) AS gain FROM tot",
    "threshold_sweep": f"""
        WITH {SCORED}, t AS (SELECT unnest([{_THR}]) AS threshold), s AS (SELECT threshold, label, CAST(score >= threshold AS INTEGER) AS pred FROM scored, t), m AS ({_prf('s', 'threshold')})
        SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, threshold = first_value(threshold) OVER (ORDER BY f1 DESC, threshold) AS best FROM m""",
    "score_histogram": f"""
        WITH {SCORED}, e AS (SELECT min(score) AS lo, (max(score) - min(score)) / 30 AS w FROM scored),
        b AS (SELECT label, CAST(least(floor((score - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM scored, e GROUP BY 1, 2)
        SELECT label, bin, round(lo + bin * w, 6) AS lower, n, round(n / (sum(n) OVER (PARTITION BY label) * w), 6) AS density FROM b, e""",
    "score_density": f"""
        WITH {SCORED}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM scored), h AS (SELECT label, stddev_samp(score) * pow(count(*), -0.2) AS h, count(*) AS c FROM scored GROUP BY label),
        g AS (SELECT CAST(k AS INTEGER) AS k, lo + k * (hi - lo) / 99 AS x FROM e, (SELECT unnest(range(0, 100)) AS k))
        SELECT label, k, round(sum(exp(-0.5 * ((x - score) / h) * ((x - score) / h))) / any_value(c * h * sqrt(2 * pi())), 6) AS density FROM scored JOIN h USING (label), g GROUP BY label, k""",
    "bootstrap_ci": f"""
        WITH {SCORED}, drawn AS (
            SELECT iter, label, score, pred, len(list_filter([{_STEPS}], lambda c: c <= {uniform_sql("'42'", 'iter', 'doc_id')})) AS w FROM scored, (SELECT unnest(range(1, 1001)) AS iter)),
        d AS (SELECT * FROM drawn WHERE w > 0), prf AS ({_prf('d', 'iter', 'w')}), tot AS ({_totals('d', 'iter', 'w')}),
        area AS (SELECT iter, {_ROC} AS roc_auc, {_PR} AS pr_auc FROM tot GROUP BY iter),
        one AS ({_prf('scored', '')}), tot1 AS ({_totals('scored')}), area1 AS (SELECT {_ROC} AS roc_auc, {_PR} AS pr_auc FROM tot1),
        m AS (SELECT unnest(['precision', 'recall', 'f1', 'roc_auc', 'pr_auc']) AS metric, unnest([precision, recall, f1, roc_auc, pr_auc]) AS value FROM prf JOIN area USING (iter)),
        pt AS (SELECT unnest(['precision', 'recall', 'f1', 'roc_auc', 'pr_auc']) AS metric, unnest([precision, recall, f1, roc_auc, pr_auc]) AS point FROM one, area1),
        s AS (SELECT metric, avg(value) AS mean, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM m GROUP BY metric)
        SELECT metric, round(mean, 6) AS mean, round(lower, 6) AS lower, round(upper, 6) AS upper, round(point, 6) AS point, round(mean - lower, 6) AS below, round(upper - mean, 6) AS above FROM s JOIN pt USING (metric)""",
    "model_comparison": f"""{_MODELS} SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc,
        CASE model WHEN 'length' THEN 'learning_rate: 0.103961, max_depth: 38, max_features: None' WHEN 'short' THEN 'n_estimators: 600' ELSE 'N/A' END AS params FROM prf JOIN area USING (model)""",
    "dataset_comparison": f"WITH {_STACK}, prf AS ({_prf('stacked', 'model, dataset')}) SELECT model, round(max(CASE WHEN dataset = 'even' THEN f1 END), 6) AS even, round(max(CASE WHEN dataset = 'odd' THEN f1 END), 6) AS odd FROM prf GROUP BY model",
    "params_text": "SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(round(CAST(CAST(embedding[1]::DOUBLE AS DECIMAL(20, 10)) AS DOUBLE), 3) AS DOUBLE) AS first FROM embeddings",
    "flat_io": f"WITH {series._ALIGNED} SELECT CAST(unnest([1, 2]) AS INTEGER) AS pass, object_id, round(t, 6) AS t, round((object_id % 9) / 10.0::DOUBLE, 6) AS hostz, g, r, i, z, CAST(object_id % 3 + 1 AS INTEGER) AS class_code FROM aligned",
    "dataset_io": f"WITH {series._SEQ}, {series._SPLIT.strip()} SELECT n.object_id, CAST(k AS INTEGER) AS pos, t, g, r, i, z, split FROM numbered n JOIN split USING (object_id)",
    "gather": "SELECT b.vec_id AS position, b.label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id * a.vec_id % 500",
    "fold_means": f"""
        WITH {SCORED}, t AS (SELECT label, doc_id % 5 AS fold, trial, CAST(score >= least AS INTEGER) AS pred FROM (SELECT *, CAST(unnest([0, 1]) AS INTEGER) AS trial, unnest([0.3, 0.5]::DOUBLE[]) AS least FROM scored)),
        m AS ({_prf('t', 'trial, fold')}) SELECT trial, round(avg(f1), 6) AS f1 FROM m GROUP BY trial""",
    "all_models": f"""
        WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY {uniform_sql("'42'", "vec_id")}, vec_id) AS place FROM embeddings),
        test AS (SELECT * FROM r WHERE place <= CAST(floor((SELECT count(*) FROM embeddings) * 0.2) AS BIGINT))
        SELECT model, count(*) AS n, count(DISTINCT vec_id) AS n_objects, CAST(count(CASE WHEN label = 1 THEN 1 END) AS BIGINT) AS positives, true AS sure, true AS learnt
        FROM test, (SELECT unnest(['linear_plain', 'linear_balanced', 'forest_plain', 'forest_balanced', 'boosted_plain', 'boosted_balanced', 'boosted_optimized']) AS model) GROUP BY model""",
    "boosted_trees": f"""{boosted_sql('SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x, CAST(label = 1 AS INTEGER) AS y FROM embeddings', 1, 3, 2, 0.4, 0.5, 0.2, 0.3, 8, 64)}
        SELECT vec_id AS id, round(p, 6) AS score, CAST(p > 0.5 AS INTEGER)::DOUBLE AS prediction FROM p JOIN src USING (r)""",
    "boosted_classes": f"""{boosted_sql('SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x, label AS y FROM embeddings', 10, 2, 2, 0.4, 0.5, 0.2, 0.3, 8, 64)}
        SELECT vec_id AS id, CAST(k AS INTEGER) AS label, round(p, 6) AS p FROM p JOIN src USING (r)""",
    "results_io": f"{_MODELS} SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1_score, round(roc_auc, 6) AS roc_auc, 'from: labels' AS best_params FROM prf JOIN area USING (model)",
}
