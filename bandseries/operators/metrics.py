"""Classification metrics from predictions (keys, label, score or pred), each from one small table of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(predictions: DataFrame, classes: list[int], keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, label, pred, n) on the full grid of classes; pairs that don't occur have 0.

    Rows whose label or prediction is null or none of `classes` are in no cell; left_out counts them.
    """
    keys = keys or []
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    n = predictions.groupBy(*keys, "label", "pred").agg(amount.alias("n"))
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred")) for a in classes for b in classes)))
    grid = (n.select(*keys).distinct() if keys else n.sparkSession.range(1)).select(*keys, cells.alias("c")).select(*keys, "c.label", "c.pred")
    return grid.join(n, [*keys, "label", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def left_out(predictions: DataFrame, classes: list[int]) -> int:
    """Rows that no cell of `confusion` counts."""
    inside = F.col("label").isin(classes) & F.col("pred").isin(classes)
    return predictions.filter(~F.coalesce(inside, F.lit(False))).count()


def per_class(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, label, precision, recall, f1, support) from confusion counts."""
    keys = keys or []
    over = lambda c: F.sum("n").over(Window.partitionBy(*keys, c))
    hit = counts.withColumn("_pred", over("pred")).withColumn("_true", over("label")).filter("label = pred")
    precision, recall = _ratio(F.col("n"), F.col("_pred")), _ratio(F.col("n"), F.col("_true"))
    out = hit.select(*keys, "label", "n", precision.alias("precision"), recall.alias("recall"), F.col("_true").alias("support"))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def weighted_prf(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, precision, recall, f1), each class weighted by its support, and accuracy."""
    keys = keys or []
    each = per_class(counts, keys)
    mean = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
    return each.groupBy(*keys).agg(mean("precision"), mean("recall"), mean("f1"), _ratio(F.sum("n"), F.sum("support")).alias("accuracy"))


def class_report(counts: DataFrame, names: dict[int, str]) -> DataFrame:
    """A row per class, and the rows accuracy, macro avg and weighted avg."""
    each = per_class(counts)
    name = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    rows = each.select(name[F.col("label")].alias("name"), "precision", "recall", "f1", "support")
    total = F.sum("support").alias("support")
    macro = each.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), total).select(F.lit("macro avg").alias("name"), "*")
    both = weighted_prf(counts).select("precision", "recall", "f1", "accuracy").join(each.agg(total), how="full")
    weighted = both.select(F.lit("weighted avg").alias("name"), "precision", "recall", "f1", "support")
    accuracy = both.select(F.lit("accuracy").alias("name"), *(F.col("accuracy").alias(c) for c in ("precision", "recall", "f1")), "support")
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def binary_counts(predictions: DataFrame, positive: int = 1, keys: list[str] | None = None) -> DataFrame:
    """(keys, tp, fp, fn, tn) with an explicit positive class."""
    is_, says = F.col("label") == positive, F.col("pred") == positive
    return predictions.groupBy(*(keys or [])).agg(F.count_if(is_ & says).alias("tp"), F.count_if(~is_ & says).alias("fp"), F.count_if(is_ & ~says).alias("fn"), F.count_if(~is_ & ~says).alias("tn"))


def weighted_binary(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, each class weighted by its support, and accuracy, to counts (tp, fp, fn, tn)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sides = [(tn, tn + fn, tn + fp), (tp, tp + fp, tp + fn)]  # hits, predicted, support of classes 0 and 1
    harmonic = lambda h, said, true: _ratio(2 * h, said + true)
    of = lambda f: _ratio(sum(f(*s) * s[2] for s in sides), tp + fp + fn + tn)
    return counts.withColumns({"precision": of(lambda h, said, _: _ratio(h, said)), "recall": of(lambda h, _, true: _ratio(h, true)), "f1": of(harmonic), "accuracy": _ratio(tp + tn, tp + fp + fn + tn)})


def figure_of_merit(counts: DataFrame, penalty: float = 3.0) -> DataFrame:
    """Adds fom = tp^2 / ((tp + fn) (tp + penalty fp)); 0 where undefined."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.withColumn("fom", _ratio(tp * tp, (tp + fn) * (tp + penalty * fp)))


def threshold_sweep(predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, precision, recall, f1, best) of binary labels for each threshold (ascending); best: first with the largest weighted F1.

    A row counts at the thresholds up to its score, so rows are reduced to (label, thresholds reached) at once.
    """
    reached = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("score")))
    bins = predictions.groupBy("label", reached.alias("reached")).agg(F.count(F.lit(1)).alias("n"))
    each = F.transform(F.array(*map(F.lit, thresholds)), lambda t, i: F.struct(t.alias("threshold"), i.alias("i")))
    rows = bins.select("label", "n", "reached", F.inline(each))
    said = rows.select("threshold", "label", F.when(F.col("reached") > F.col("i"), 1).otherwise(0).alias("pred"), "n")
    scores = weighted_prf(confusion(said, [0, 1], ["threshold"], "n"), ["threshold"]).drop("accuracy")
    best = F.max_by("threshold", F.struct("f1", -F.col("threshold"))).over(Window.partitionBy(F.lit(0)))
    return scores.withColumn("best", F.col("threshold") == best)
