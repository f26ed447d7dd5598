"""Bootstrap of metrics: weights for each cell of label and score or for each row, metrics per iteration, intervals."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import ranged
from ..functions.scalars import hash_uniform, predicted
from ..sources.tables import stored
from . import curves, metrics

MEASURES = ["precision", "recall", "f1", "roc_auc", "pr_auc"]

#: Rows of a cell that one Poisson draw stands for, at most: exp(-64) is well inside what a double holds.
PART = 64
#: Draws of (cell part, iteration) that are made at once.
BLOCK = 1 << 20


def poisson_steps(most: int = 12) -> list[float]:
    """Chances of at most 0, 1, ... of a Poisson draw with mean 1."""
    out, p, total = [], math.exp(-1), 0.0
    for k in range(most):
        total += p
        out.append(total)
        p /= k + 1
    return out


def resampled(predictions: DataFrame, key: str, iterations: int, seed: int = 42) -> DataFrame:
    """Each row with a weight in each iteration it is drawn in: Poisson(1), by a hash of seed, iteration and key.

    As n grows this is a draw of n rows with replacement, and needs no row numbers and no shuffle.
    """
    drawn = predictions.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("_u", hash_uniform(seed, "iter", key))
    weight = sum(((F.col("_u") >= c).cast("long") for c in poisson_steps()), F.lit(0).cast("long"))  # named many times, so made once
    return drawn.withColumn("weight", weight).filter("weight > 0").drop("_u")


def resampled_exactly(predictions: DataFrame, key: str, iterations: int, seed: int = 42) -> DataFrame:
    """As `resampled`, with exactly n draws in each iteration, by positions; for tables whose rows may be numbered."""
    from ..functions.ranks import rank_by_uniform

    n = predictions.count()
    placed = rank_by_uniform(predictions.withColumn("_u", hash_uniform(seed, key)).withColumn("_all", F.lit(0)), ["_all"], "_u", [key], "_at").drop("_u", "_all")
    draws = predictions.sparkSession.range(iterations * n).select((F.expr(f"id div {max(n, 1)}") + 1).cast("int").alias("iter"), F.floor(hash_uniform(seed, "id") * n).cast("long").alias("_at"))
    weights = draws.groupBy("iter", "_at").agg(F.count(F.lit(1)).alias("weight"))
    return weights.join(placed, "_at").drop("_at")


def iteration_metrics(drawn: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(iter, MEASURES) from weighted rows (iter, label, score, weight).

    Draws are summed by score once and written; all measures start from these sums.
    """
    sums = stored(drawn.groupBy("iter", "label", "score").agg(F.sum("weight").alias("weight")), "bootstrap")
    counts = metrics.confusion(sums.withColumn("pred", predicted(F.col("score"), threshold)), [0, 1], ["iter"], "weight")
    totals = curves.score_totals(sums, 1, ["iter"], "weight")
    out = metrics.weighted_prf(counts, ["iter"]).drop("accuracy")
    return out.join(curves.roc_auc(totals, ["iter"]), "iter").join(curves.pr_auc(totals, ["iter"]), "iter")


def score_cells(predictions: DataFrame, seed: int, threshold: float) -> DataFrame:
    """(score, positive, pred, mean, a, b): the rows counted by label and score, in parts of PART rows at most, each with its own two hashes of 32 bits."""
    cells = predictions.filter(F.col("label").isin(0, 1) & F.col("score").isNotNull()).groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"))
    parts = cells.select("label", "score", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PART}"))).alias("part"))
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ("label", "score", "part"))))
    half = lambda at: F.conv(F.substring(hashed, at, 8), 16, 10).cast("long")
    mean = F.least(F.lit(PART), F.col("n") - F.col("part") * PART).cast("int")
    return parts.select("score", (F.col("label") == 1).alias("positive"), (predicted(F.col("score"), threshold) == 1).alias("pred"), mean.alias("mean"), half(1).alias("a"), half(9).alias("b"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def cell_weights(mean: np.ndarray, a: np.ndarray, b: np.ndarray, iterations: int) -> np.ndarray:
    """Poisson(mean) of each part in each iteration 1, 2, ...: the number of steps of the distribution that a hash of part and iteration reaches."""
    turn = np.arange(1, iterations + 1).astype(np.uint32) * np.uint32(0x9E3779B1)
    u = _mixed(_mixed(a.astype(np.uint32)[:, None] + turn) ^ b.astype(np.uint32)[:, None]) / 4294967296.0
    out = np.empty(u.shape, np.int64)
    for m in np.unique(mean).tolist():
        steps = np.cumsum([math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in range(m + int(12 * math.sqrt(m)) + 20)])
        out[mean == m] = np.searchsorted(steps, u[mean == m], "right")
    return out


def _by_score(cells: pd.DataFrame, iterations: int):
    """Blocks of (positive and negative weights by score and iteration, whether a score is predicted positive), from the highest score down."""
    cells = cells.sort_values("score", ascending=False, kind="stable")
    score = cells["score"].to_numpy()
    starts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    rows = max(1, BLOCK // iterations)
    lo = 0
    while lo < len(starts):  # whole scores, one at least
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + rows, "right")) - 1) if starts[-1] > starts[lo] + rows else len(starts)
        some = slice(starts[lo], starts[hi] if hi < len(starts) else len(score))
        part = cells.iloc[some]
        w = cell_weights(part["mean"].to_numpy(), part["a"].to_numpy(), part["b"].to_numpy(), iterations)
        positive, at = part["positive"].to_numpy()[:, None], starts[lo:hi] - starts[lo]
        yield np.add.reduceat(w * positive, at), np.add.reduceat(w * ~positive, at), part["pred"].to_numpy()[at]
        lo = hi


def _totals(iterations: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        pos, neg = np.zeros(iterations, np.int64), np.zeros(iterations, np.int64)
        for p, n, _ in _by_score(cells, iterations):
            pos, neg = pos + p.sum(0), neg + n.sum(0)
        return pd.DataFrame({"_piece": cells["_piece"].iloc[0], "iter": np.arange(1, iterations + 1), "pos": pos, "neg": neg})

    return run


def _sums(iterations: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The sums of a range of scores in each iteration, given the totals of the ranges above."""

    def run(cells: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        names = ["iter", "tp", "fp", "fn", "tn", "roc", "pr"]
        if not len(cells):
            return pd.DataFrame({c: [] for c in names})
        above = above.sort_values("iter")
        tp0, fp0 = (above[c].to_numpy() if len(above) else np.zeros(iterations, np.int64) for c in ("tp0", "fp0"))
        out = {c: np.zeros(iterations) for c in names[1:]}
        for pos, neg, pred in _by_score(cells, iterations):
            tp, fp = tp0 + pos.cumsum(0), fp0 + neg.cumsum(0)
            before = np.where(tp - pos + fp - neg > 0, (tp - pos) / np.maximum(tp - pos + fp - neg, 1), 1.0)
            out["roc"] += (neg * (2 * tp - pos)).sum(0)
            out["pr"] += (pos * (before + tp / np.maximum(tp + fp, 1))).sum(0)
            for name, w, said in (("tp", pos, pred), ("fp", neg, pred), ("fn", pos, ~pred), ("tn", neg, ~pred)):
                out[name] += w[said].sum(0)
            tp0, fp0 = tp[-1], fp[-1]
        return pd.DataFrame({"iter": np.arange(1, iterations + 1)} | out)

    return run


def bootstrap_metrics(predictions: DataFrame, iterations: int = 1000, seed: int = 42, threshold: float = 0.5, rows: int = 8192) -> DataFrame:
    """(iter, MEASURES) of `iterations` Poisson resamples of predictions (label 0 or 1, score).

    Rows are counted by label and score first, and a cell of n rows is drawn as a whole: its weight is Poisson(n), as of n
    rows with Poisson(1) each, by hashes of seed, label, score and iteration, so partitioning changes nothing.  Scores
    are dealt into ranges of about `rows` cells; a range makes the weights of its cells for all iterations as arrays,
    from the highest score down, and starts from the totals of the ranges above it.  What is shuffled is cells, and an
    iteration's sums for each range; no row is repeated by iterations.  Rows with another label or no score are left out;
    an area that needs both classes is null where a resample has one.  No rows: an empty result.
    """
    cells, pieces = ranged(score_cells(predictions, seed, threshold), [F.desc("score")], "bootstrap", rows)
    grouped = cells.groupBy("_piece")
    if pieces > 1:
        totals = stored(grouped.applyInPandas(_totals(iterations), "_piece int, iter int, pos long, neg long"), "bootstrap-totals")
        by = Window.partitionBy("iter").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        above = totals.select("_piece", "iter", *(F.coalesce(F.sum(c).over(by), F.lit(0)).alias(n) for n, c in (("tp0", "pos"), ("fp0", "neg"))))
    else:
        above = cells.sparkSession.createDataFrame([], "_piece int, iter int, tp0 long, fp0 long")
    kind = "iter int, tp double, fp double, fn double, tn double, roc double, pr double"
    sums = grouped.cogroup(above.groupBy("_piece")).applyInPandas(_sums(iterations), kind)
    sums = sums.groupBy("iter").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "roc", "pr")))
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return metrics.weighted_binary(sums).select("iter", "precision", "recall", "f1", F.try_divide("roc", 2 * p * n).alias("roc_auc"), F.try_divide("pr", 2 * p).alias("pr_auc"))


def intervals(per_iteration: DataFrame, level: float = 0.95) -> DataFrame:
    """(metric, mean, lower, upper) by percentiles, linear between ranks."""
    long = per_iteration.select("iter", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in MEASURES))))
    at = [(1 - level) / 2, 1 - (1 - level) / 2]
    p = F.percentile("value", F.array(*map(F.lit, at)))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), p[0].alias("lower"), p[1].alias("upper"))


def against_point(summary: DataFrame, point: DataFrame) -> DataFrame:
    """summary with the point estimate (metric, point) and the error bars' halves."""
    return summary.join(point, "metric").withColumn("below", F.col("mean") - F.col("lower")).withColumn("above", F.col("upper") - F.col("mean"))
