"""Model comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import params_text
from . import curves, metrics


def model_metrics(predictions: DataFrame, keys: list[str] | None = None, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """A row per key (default model): weighted precision, recall, F1, ROC and PR areas, of stacked predictions.

    Rows whose label or prediction is none of `classes` count in no precision, recall or F1 (metrics.left_out says how
    many they are); the areas take label 1 against all others.
    """
    keys = keys or ["model"]
    counts = metrics.confusion(predictions, list(classes), keys)
    totals = curves.score_totals(predictions, 1, keys)
    out = metrics.weighted_prf(counts, keys).drop("accuracy")
    return out.join(curves.roc_auc(totals, keys), keys).join(curves.pr_auc(totals, keys), keys)


def comparison(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """model_metrics with the parameters' text of saved results, N/A where there are none."""
    params = results.select("model", params_text(F.col("best_params")).alias("params"))
    return model_metrics(predictions).join(params, "model", "left").withColumn("params", F.coalesce("params", F.lit("N/A")))


def by_dataset(predictions: DataFrame, datasets: list[str], measure: str = "f1") -> DataFrame:
    """One row per model and a column per data set (balanced training rows, untouched test rows, ...)."""
    return model_metrics(predictions, ["model", "dataset"]).groupBy("model").pivot("dataset", datasets).agg(F.first(measure))


def mean_over_folds(scores: DataFrame) -> DataFrame:
    """(trial, f1) from (trial, fold, f1)."""
    return scores.groupBy("trial").agg(F.avg("f1").alias("f1"))
