"""The ways to turn observations into aligned epochs, chosen by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import BANDS
from . import align, fill, resample

METHODS = ("augment", "spline", "last")


def augment(obs: DataFrame, bands: list[str], n_passes: int, seed: int) -> DataFrame:
    """Adaptive bins, one value per band, gaps filled at random in each pass."""
    return fill.fill_gaps(align.align_bands(align.adaptive_bins(obs, bands), bands), bands, seed, n_passes=n_passes)


def spline(obs: DataFrame, bands: list[str]) -> DataFrame:
    """Each band's cubic at the mean times of whole bins, and the errors of the nearest observations; one pass."""
    times = align.cluster_times(align.fixed_bins(obs)).select("object_id", "bin", "t")
    values = resample.cubic_resample(obs, times, bands).select("object_id", "bin", "t", "band", "value")
    errors = align.nearest_values(obs, times, bands).withColumn("band", F.concat("band", F.lit("_err")))
    names = [*bands, *(f"{b}_err" for b in bands)]
    wide = values.unionByName(errors).groupBy("object_id", "bin", "t").agg(*(F.max(F.when(F.col("band") == n, F.col("value"))).alias(n) for n in names))
    return wide.withColumn("pass", F.lit(1))


def last(obs: DataFrame, bands: list[str]) -> DataFrame:
    """Each observation with every band's latest value; one pass."""
    return align.carry_forward(obs, bands).withColumnRenamed("seq", "bin").withColumn("pass", F.lit(1))


def epochs(obs: DataFrame, method: str | None = None, n_passes: int = 5, bands: list[str] = BANDS, seed: int = 42) -> DataFrame:
    """(pass, object_id, bin, t, bands, errors) by `augment`, `spline` or `last`; any other name, or none, is `augment`.

    Only `augment` draws at random, so only it has more than one pass.
    """
    if method == "spline":
        out = spline(obs, bands)
    elif method == "last":
        out = last(obs, bands)
    else:
        out = augment(obs, bands, n_passes, seed)
    return out.select("pass", "object_id", "bin", "t", *bands, *(f"{b}_err" for b in bands))
