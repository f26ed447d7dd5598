"""Feature scaling, the three model families, parameter search without leaks, and batch scoring, on Spark ML."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .balance import oversampled
from .boosting import BoostedTrees
from .splits import stratified_folds


def with_vector(rows: DataFrame, array: str, out: str = "features") -> DataFrame:
    return rows.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def standardise(train: DataFrame, rows: DataFrame, column: str = "features", out: str = "scaled") -> DataFrame:
    """rows with z-scores by the mean and population deviation of train; a constant column gives 0."""
    n = train.count()
    model = StandardScaler(inputCol=column, outputCol=out, withMean=True, withStd=True).fit(train)
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0  # the library divides by n - 1
    return model.transform(rows).withColumn(out, array_to_vector(F.transform(vector_to_array(out), lambda z: z * F.lit(factor))))


def classifier(kind: str, /, **params) -> Estimator:
    """linear, forest or boosted; parameters the family lacks are dropped, and a forest's depth is clamped to what Spark allows (30)."""
    family = {"linear": LogisticRegression, "forest": RandomForestClassifier, "boosted": BoostedTrees}[kind]
    if kind == "forest" and "maxDepth" in params:
        params["maxDepth"] = min(int(params["maxDepth"]), 30)
    made = family(featuresCol="scaled", labelCol="label")
    known = {p.name for p in made.params}
    if kind == "forest":
        params = {"cacheNodeIds": True} | params  # deep trees: rows keep their nodes, and trees aren't sent to all tasks in every step
    return made.setParams(**{k: v for k, v in params.items() if k in known})


def balanced(rows: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """(label, features) of all rows (key, features, label) and of the synthetic ones that bring each class up to the largest."""
    plain = rows.withColumn("_x", vector_to_array("features"))
    return with_vector(oversampled(plain, key, "label", "_x", seed=seed), "_x")


class BalancedClassifier(Estimator):
    """Balances the rows it is fitted on (by synthetic minority rows), scales, and fits; its model only scales and scores."""

    def __init__(self, inner: Estimator, balance: bool = True, key: str = "id", seed: int = 42) -> None:
        super().__init__()
        self.inner, self.balance, self.key, self.seed = inner, balance, key, seed

    def copy(self, extra=None) -> BalancedClassifier:
        return BalancedClassifier(self.inner.copy(extra), self.balance, self.key, self.seed)

    def _fit(self, dataset: DataFrame) -> Model:
        if self.balance:
            dataset = balanced(dataset, self.key, self.seed)
        if isinstance(self.inner, RandomForestClassifier):
            # Each partition makes the sums of all open nodes in every step, and nodes grow with the rows: no more partitions than cores.
            dataset = dataset.coalesce(dataset.sparkSession.sparkContext.defaultParallelism)
        dataset = dataset.persist()
        try:
            scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
            return Pipeline(stages=[scaler, self.inner]).fit(dataset)
        finally:
            dataset.unpersist()


#: Ranges of the search, by Spark's names: (kind, least, largest) or a list.
SPACES = {
    "boosted": {
        "maxIter": ("step", 100, 1000), "maxDepth": ("int", 3, 15), "stepSize": ("log", 0.01, 0.3), "subsamplingRate": ("real", 0.5, 1.0), "columnRate": ("real", 0.5, 1.0),
        "regLambda": ("log", 1e-3, 10.0), "regAlpha": ("log", 1e-3, 10.0), "gamma": ("log", 1e-3, 10.0),
    },
    "forest": {"numTrees": ("step", 100, 1000), "maxDepth": ("int", 5, 50), "minInstancesPerNode": ("int", 1, 5), "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "linear": {"regParam": ("log", 1e-4, 1.0), "elasticNetParam": ("real", 0.0, 1.0)},
}


def trials(family: str, n: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """n seeded random draws of the family's space, with the ranges of `space` in place of its own; trial k is the same for every n."""
    out = []
    for k in range(n):
        r = random.Random(f"{seed}/{family}/{k}")
        draw = {}
        for name, range_ in (SPACES[family] | (space or {})).items():
            if isinstance(range_, list):
                draw[name] = r.choice(range_)
            elif range_[0] == "step":
                draw[name] = 100 * r.randint(range_[1] // 100, range_[2] // 100)
            elif range_[0] == "int":
                draw[name] = r.randint(range_[1], range_[2])
            elif range_[0] == "real":
                draw[name] = r.uniform(range_[1], range_[2])
            else:
                draw[name] = range_[1] * (range_[2] / range_[1]) ** r.random()
        out.append(draw)
    return out


def fold_tables(rows: DataFrame, folds: int = 5, balance: bool = False, key: str = "id", seed: int = 42) -> list[tuple[DataFrame, DataFrame]]:
    """The training and the validation table (label, scaled) of each stratified fold of rows (key, features, label).

    A fold's training rows are balanced among themselves, and both tables are scaled by the training rows alone.  The
    tables are written once, so that whatever is tried on them neither balances nor scales again.
    """
    placed = stored(stratified_folds(rows, "label", key, folds, seed).select(key, "features", "label", "fold"), "folds")
    out = []
    for k in range(folds):
        train, valid = placed.filter(F.col("fold") != k), placed.filter(F.col("fold") == k)
        if balance:
            train = stored(balanced(train, key, seed), "fold")
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
        out.append(tuple(stored(scaler.transform(t).select("label", "scaled"), "fold") for t in (train, valid)))
    return out


def search(
    rows: DataFrame, family: str, n: int, folds: int = 5, balance: bool = False, key: str = "id", seed: int = 42, parallelism: int = 4, space: dict | None = None, margin: float | None = None, **fixed
) -> tuple[PipelineModel, DataFrame]:
    """The best trial's model, fitted on all rows, and (trial, f1, folds, params): each trial's mean weighted F1 over the folds it was given.

    rows: key, features (vector), label (double); `fixed` are parameters that all trials share.  Folds are made once
    (`fold_tables`); `parallelism` fits run at a time.  With a margin, folds are taken one after the other, and a trial whose mean so
    far is more than the margin below the best is given no more; its f1 is null.  Without one, every trial sees every fold.
    """
    tables, draws = fold_tables(rows, folds, balance, key, seed), trials(family, n, seed, space)
    judge = MulticlassClassificationEvaluator(metricName="f1")
    got: list[list[float]] = [[] for _ in draws]

    def one(job: tuple[int, int]) -> float:
        train, valid = tables[job[1]]
        return judge.evaluate(classifier(family, **fixed | draws[job[0]]).fit(train).transform(valid))

    going, mean = list(range(n)), lambda v: sum(v) / len(v)
    with ThreadPoolExecutor(parallelism) as pool:
        for some in [range(folds)] if margin is None else [[f] for f in range(folds)]:
            jobs = [(t, f) for t in going for f in some]
            for (t, _), f1 in zip(jobs, pool.map(one, jobs), strict=True):
                got[t].append(f1)
            if margin is not None:
                best = max(mean(got[t]) for t in going)
                going = [t for t in going if mean(got[t]) >= best - margin]
    best = max((t for t in range(n) if len(got[t]) == folds), key=lambda t: (mean(got[t]), -t))
    model = fit(rows, family, balance, key, **fixed | draws[best])
    table = [(t, float(mean(got[t])) if len(got[t]) == folds else None, len(got[t]), {a: str(b) for a, b in draws[t].items()}) for t in range(n)]
    return model, rows.sparkSession.createDataFrame(table, "trial int, f1 double, folds int, params map<string,string>")


def fit(rows: DataFrame, kind: str, /, balance: bool = False, key: str = "id", **params) -> PipelineModel:
    """Scaler and classifier fitted on rows (key, features, label)."""
    return BalancedClassifier(classifier(kind, **params), balance, key).fit(rows)


def score(model: Model, rows: DataFrame, name: str, key: str = "id", positive: int = 1, threshold: float = 0.5) -> DataFrame:
    """Predictions (model, object_id, label, score, pred): score is the probability of the positive class."""
    p = vector_to_array("probability")[positive]
    out = model.transform(rows)
    return out.select(F.lit(name).alias("model"), F.col(key).alias("object_id"), F.col("label").cast("int").alias("label"), p.alias("score"), (p >= threshold).cast("int").alias("pred"))


def score_all(models: dict[str, Model], rows: DataFrame, key: str = "id") -> DataFrame:
    """The predictions of all models, stacked."""
    out = None
    for name, model in models.items():
        one = score(model, rows, name, key)
        out = one if out is None else out.unionByName(one)
    return out


def train_all(rows: DataFrame, families: dict[str, dict] | None = None, key: str = "id", searches: dict[str, dict] | None = None) -> dict[str, PipelineModel]:
    """Each family plain and balanced, and each family of `searches` with the best parameters of a search, from one feature table.

    Unless told otherwise: linear, forest and boosted, and boosted once more after a search of 150 trials.
    """
    families = families or {"linear": {}, "forest": {}, "boosted": {}}
    searches = {"boosted": {"n": 150}} if searches is None else searches
    out = {f"{f}_{'balanced' if b else 'plain'}": fit(rows, f, b, key, **p) for f, p in families.items() for b in (False, True)}
    return out | {f"{f}_optimized": search(rows, f, key=key, **how)[0] for f, how in searches.items()}
