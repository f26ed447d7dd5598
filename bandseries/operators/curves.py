"""ROC, precision-recall and gain curves, areas, histograms and densities of scores.

Curves work on one row per distinct score; running totals are taken in two levels (functions.ranks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import running_totals

#: Most labels whose widths are broadcast.
LABELS = 10_000


def score_totals(predictions: DataFrame, positive: int = 1, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, score, pos, neg, tp, fp, p, n): counts at each score, running counts from the top, and totals; ties are one row."""
    keys = keys or []
    w = F.col(weight) if weight else F.lit(1).cast("long")
    is_ = F.col("label") == positive
    zero = F.lit(0).cast("long")
    each = predictions.groupBy(*keys, "score").agg(F.sum(F.when(is_, w).otherwise(zero)).alias("pos"), F.sum(F.when(is_, zero).otherwise(w)).alias("neg"))
    each = each.filter("pos + neg > 0")
    run = running_totals(each, keys, "score", {"tp": "pos", "fp": "neg"})
    if not keys:
        total = each.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
        return run.withColumn("p", F.lit(total["p"]).cast("long")).withColumn("n", F.lit(total["n"]).cast("long"))
    return run.join(each.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")), keys)


def roc_curve(totals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, threshold, fpr, tpr); the start (0, 0) has a null threshold."""
    keys = keys or []
    points = totals.select(*keys, F.col("score").alias("threshold"), F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))
    start = totals.select(*keys).distinct() if keys else totals.sparkSession.range(1)
    return points.unionByName(start.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def roc_auc(totals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, roc_auc): pairs in the right order, ties half; counts are whole numbers until the last division."""
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")))
    return totals.groupBy(*(keys or [])).agg(F.try_divide(area.cast("double"), 2.0 * F.first("p") * F.first("n")).alias("roc_auc"))


def learnt(totals: DataFrame, keys: list[str] | None = None, errors: float = 3.0) -> DataFrame:
    """(keys, roc_auc, learnt): whether the area is more than `errors` standard errors above that of random scores, 0.5.

    That error is the rank sum's, sqrt((p + n + 1) / (12 p n)), so the same excess counts the same for few rows and for many.
    """
    keys = keys or []
    sizes = totals.groupBy(*keys).agg(F.first("p").alias("_p"), F.first("n").alias("_n"))
    areas = roc_auc(totals, keys)
    error = F.sqrt(F.try_divide(F.col("_p") + F.col("_n") + 1, 12.0 * F.col("_p") * F.col("_n")))
    joined = areas.join(sizes, keys) if keys else areas.crossJoin(sizes)
    return joined.withColumn("learnt", F.col("roc_auc") > 0.5 + errors * error).drop("_p", "_n")


def pr_curve(totals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, threshold, precision, recall); the end (recall 0, precision 1) has a null threshold."""
    keys = keys or []
    points = totals.select(*keys, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "p").alias("recall"))
    start = totals.select(*keys).distinct() if keys else totals.sparkSession.range(1)
    return points.unionByName(start.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def pr_auc(totals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pr_auc): trapezoids over recall, from precision 1 at recall 0.

    The row before has tp - pos and fp - neg, so no window is needed.
    """
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.coalesce(F.try_divide(tp0.cast("double"), tp0 + fp0), F.lit(1.0))
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    return totals.groupBy(*(keys or [])).agg(F.try_divide(F.sum(F.col("pos") * (before + here)), 2.0 * F.first("p")).alias("pr_auc"))


def gain_curve(totals: DataFrame) -> DataFrame:
    """(threshold, ranked, gain): share of rows ranked at least so high, and of positives among them."""
    return totals.select(F.col("score").alias("threshold"), ((F.col("tp") + F.col("fp")) / (F.col("p") + F.col("n"))).alias("ranked"), F.try_divide("tp", "p").alias("gain"))


def score_histogram(predictions: DataFrame, bins: int = 30) -> DataFrame:
    """(label, bin, lower, n, density): equal bins from the least to the largest score, the last one closed."""
    ends = predictions.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    lo, hi = float(ends["lo"] or 0.0), float(ends["hi"] or 0.0)
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col("score") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    n = predictions.filter("score IS NOT NULL").groupBy("label", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    share = F.sum("n").over(Window.partitionBy("label"))
    return n.select("label", "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"), "n", (F.col("n") / (share * F.lit(width))).alias("density"))


def score_density(predictions: DataFrame, grid: int = 100) -> DataFrame:
    """(label, k, x, density): Gaussian kernels about each distinct score, Scott's bandwidth, on a grid over the scores' range.

    A label whose scores are all equal, or that has one, has kernels one step of the grid wide (1 where all scores of
    all labels are equal).  Null scores are left out.  Each distinct score meets each grid point once, after rows are
    counted by score; sums combine before the shuffle, and widths, a row for each label, are broadcast where a count finds them few.
    """
    known = predictions.filter("score IS NOT NULL")
    ends = known.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    lo, hi = float(ends["lo"] or 0.0), float(ends["hi"] or 0.0)
    xs = [lo + k * (hi - lo) / (grid - 1) for k in range(grid)]
    step = (hi - lo) / (grid - 1) or 1.0
    each = known.groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"))
    width = known.groupBy("label").agg((F.stddev_samp("score") * F.pow(F.count("score").cast("double"), -0.2)).alias("h"), F.count("score").alias("all"))
    width = width.select(F.col("label").alias("_label"), F.when(F.col("h") > 0, F.col("h")).otherwise(F.lit(step)).alias("h"), "all")
    if width.limit(LABELS + 1).count() <= LABELS:
        width = F.broadcast(width)
    spread = each.join(width, F.col("label").eqNullSafe(F.col("_label"))).select("label", "score", "n", "h", "all", F.posexplode(F.array(*map(F.lit, xs))).alias("k", "x"))
    z = (F.col("x") - F.col("score")) / F.col("h")
    kernel = F.col("n") * F.exp(-0.5 * z * z) / (F.col("all") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
    return spread.groupBy("label", "k", "x").agg(F.sum(kernel).alias("density"))
