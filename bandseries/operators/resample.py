"""Resampling of each band at given times: piecewise linear by windows, cubic splines by grouped solves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Observations whose splines are solved in one call, about.
PIECE = 8192


def points(obs: DataFrame, bands: list[str]) -> DataFrame:
    """(object_id, band, t, y): observations of the bands, those of one time averaged."""
    return obs.filter(F.col("band").isin(bands)).groupBy("object_id", "band", "t").agg(F.avg("flux").alias("y"))


def linear_resample(obs: DataFrame, times: DataFrame, bands: list[str]) -> DataFrame:
    """(object_id, band, bin, t, value) at each of times (object_id, bin, t).

    Linear between neighbours and beyond the ends; a band with one point is constant, one with none is 0.
    """
    w = Window.partitionBy("object_id", "band").orderBy("t")
    p = points(obs, bands)
    p = p.withColumn("_next", F.lead(F.struct("t", "y")).over(w)).withColumn("_last", F.lag(F.struct("t", "y")).over(w))
    # The line that holds from a point on: to the next one, or from the one before at the end.
    here = F.struct("t", "y")
    line = F.struct(F.when(F.col("_next").isNull(), F.coalesce("_last", here)).otherwise(here).alias("a"), F.coalesce("_next", here).alias("b"))
    p = p.select("object_id", "band", "t", F.lit(None).cast("long").alias("bin"), line.alias("_line"))
    asked = times.select("object_id", F.explode(F.array(*map(F.lit, bands))).alias("band"), "t", "bin", F.lit(None).cast(p.schema["_line"].dataType).alias("_line"))
    both = p.unionByName(asked)
    past = w.rangeBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy("object_id", "band").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_use", F.coalesce(F.last("_line", ignorenulls=True).over(past), F.last("_line", ignorenulls=True).over(future))).filter("bin IS NOT NULL")
    a, b = F.col("_use.a"), F.col("_use.b")
    slope = F.when(a["t"] == b["t"], F.lit(0.0)).otherwise((b["y"] - a["y"]) / (b["t"] - a["t"]))
    return both.select("object_id", "band", "bin", "t", F.coalesce(a["y"] + slope * (F.col("t") - a["t"]), F.lit(0.0)).alias("value"))


def _three_diagonals(low: list, mid: list, up: list, right: list) -> list:
    """x of low[i] x[i-1] + mid[i] x[i] + up[i] x[i+1] = right[i], in one sweep down and one up."""
    for i in range(1, len(mid)):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        right[i] -= f * right[i - 1]
    x = right[-1:]
    x[0] /= mid[-1]
    for i in range(len(mid) - 2, -1, -1):
        x.append((right[i] - up[i] * x[-1]) / mid[i])
    return x[::-1]


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through (x, y), x increasing, whose first and last two pieces are one polynomial each.

    Fewer than four points give the line or constant through them, piecewise.
    """
    n = len(x)
    if n == 0:
        return np.zeros(len(at))
    if n == 1:
        return np.full(len(at), y[0])
    h = np.diff(x)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    if n < 4:
        return y[k] + (y[k + 1] - y[k]) / h[k] * (at - x[k])
    # The ends' conditions give the first and last second derivative by the next two, which leaves three diagonals inside.
    low, mid, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    mid[0] += h[0] * (h[0] + h[1]) / h[1]
    up[0] -= h[0] ** 2 / h[1]
    mid[-1] += h[-1] * (h[-2] + h[-1]) / h[-2]
    low[-1] -= h[-1] ** 2 / h[-2]
    inner = _three_diagonals(low.tolist(), mid.tolist(), up.tolist(), (6 * np.diff(np.diff(y) / h)).tolist())
    m = np.concatenate(([((h[0] + h[1]) * inner[0] - h[0] * inner[1]) / h[1]], inner, [((h[-2] + h[-1]) * inner[-1] - h[-1] * inner[-2]) / h[-2]]))
    d = at - x[k]
    slope = (y[k + 1] - y[k]) / h[k] - h[k] * (2 * m[k] + m[k + 1]) / 6
    return y[k] + d * (slope + d * (m[k] / 2 + d * (m[k + 1] - m[k]) / (6 * h[k])))


def cubic_resample(obs: DataFrame, times: DataFrame, bands: list[str], clamp: bool = False) -> DataFrame:
    """As linear_resample, by a not-a-knot cubic for bands of four points or more; `clamp` keeps the end values beyond the ends.

    Objects and bands are dealt by a hash into pieces of about PIECE observations; one of them is not parted.
    """
    p = points(obs, bands).select("object_id", "band", "t", "y", F.lit(None).cast("long").alias("bin"))
    asked = times.select("object_id", F.explode(F.array(*map(F.lit, bands))).alias("band"), "t", F.lit(None).cast("double").alias("y"), "bin")

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        series = f.groupby(["object_id", "band"], sort=False, dropna=False).ngroup().to_numpy()
        asks, t, y = f["bin"].notna().to_numpy(), f["t"].to_numpy(float), f["y"].to_numpy(float)
        order = np.lexsort((t, asks, series))
        series, asks, t, y = series[order], asks[order], t[order], y[order]
        begin = np.flatnonzero(np.append(True, series[1:] != series[:-1])) if len(f) else np.zeros(0, int)
        known, value = np.add.reduceat(~asks, begin, dtype=int) if len(f) else begin, np.zeros(len(f))
        for lo, hi, mid in zip(begin.tolist(), [*begin[1:].tolist(), len(f)], (begin + known).tolist(), strict=True):
            if mid < hi:
                x, at = t[lo:mid], t[mid:hi]
                value[mid:hi] = not_a_knot(x, y[lo:mid], np.clip(at, x[0], x[-1]) if clamp and len(x) else at)
        q = f.iloc[order[asks]]
        return pd.DataFrame({"object_id": q["object_id"], "band": q["band"], "bin": q["bin"].astype("int64"), "t": q["t"], "value": value[asks]})

    # Many objects to a call: a call of its own for each costs more than its spline.
    pieces = max(1, -(-obs.count() // PIECE))
    both = p.unionByName(asked).withColumn("_piece", F.pmod(F.xxhash64("object_id", "band"), F.lit(pieces)))
    return both.groupBy("_piece").applyInPandas(solve, "object_id long, band string, bin long, t double, value double")
