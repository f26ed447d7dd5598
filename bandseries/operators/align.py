"""Observations to aligned epochs: relative time, carry-forward, fixed and adaptive bins, band columns.

Long tables have one row per observation: object_id, seq (order in the object), t, band, flux, flux_err.  Every step
shuffles by object at most, and the steps of one chain share that partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import bin_of
from ..functions.scans import last_and_next
from ..schemas import BANDS
from .steps import Grid, first_free

#: Steps in one mask of the bin search: as many bits as a long safely holds.
MASK = 60


def relative_time(obs: DataFrame, time: str = "time", norm: float = 1.0) -> DataFrame:
    """Adds t: time since the object's first observation in its own order, over `norm`."""
    first = F.first(time).over(Window.partitionBy("object_id").orderBy("seq"))
    return obs.withColumn("t", (F.col(time) - first) / F.lit(norm))


def band_columns(bands: list[str] = BANDS) -> dict[str, Column]:
    """A flux and an error column for each band; a row of another band has nulls only."""
    return {b: F.when(F.col("band") == b, F.col("flux")) for b in bands} | {f"{b}_err": F.when(F.col("band") == b, F.col("flux_err")) for b in bands}


def carry_forward(obs: DataFrame, bands: list[str] = BANDS, initial: float | None = 0.0, rows: int | None = None) -> DataFrame:
    """One row per observation with each band's latest value; `initial` before a band's first (None: null).

    With `rows`, objects are cut into ranges of about so many rows, for objects that are larger than a task.
    """
    wide = band_columns(bands)
    held = last_and_next(obs.select("object_id", "seq", "t", *(c.alias(n) for n, c in wide.items())), ["object_id"], ["seq"], list(wide), rows, following=False)
    last = {n: F.col(f"_last_{n}") for n in wide}
    return held.select("object_id", "seq", "t", *((F.coalesce(c, F.lit(initial)) if initial is not None else c).alias(n) for n, c in last.items()))


def fixed_bins(obs: DataFrame, frac: float | Column = 1.0) -> DataFrame:
    """Adds bin: whole steps of 1 / frac."""
    return obs.withColumn("bin", bin_of(F.col("t"), F.lit(frac) if isinstance(frac, (int, float)) else frac))


def cluster_times(binned: DataFrame) -> DataFrame:
    """One row per object and bin: mean time, number of members, and their seqs."""
    return binned.groupBy("object_id", "bin").agg(F.avg("t").alias("t"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("seq")).alias("members"))


def runs(obs: DataFrame, frac: float = 1.0) -> DataFrame:
    """Bins of unsorted times: consecutive rows of one bin number are a run, and a run is a cluster."""
    w = Window.partitionBy("object_id").orderBy("seq")
    stepped = fixed_bins(obs, frac).withColumn("_new", F.when(F.col("bin") == F.lag("bin").over(w), 0).otherwise(1))
    return stepped.withColumn("bin", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def frac_grid(steps: int = 200, start: float = 1.0, step: float = 0.1) -> list[float]:
    """start, start + step, ... by repeated addition, so that rounding is the same everywhere."""
    out = [start]
    while len(out) < steps:
        out.append(out[-1] + step)
    return out


def adaptive_frac(obs: DataFrame, bands: list[str] = BANDS, max_per_bin: int = 4, steps: int = 200) -> DataFrame:
    """(object_id, frac, unresolved): the least frac of the grid whose bins have one observation per band at most.

    Bins also hold at most `max_per_bin` observations of all bands.  Only neighbours can clash: two observations in a row of one
    band, or max_per_bin apart in all.  Each pair marks the grid steps at which it shares a bin in bit masks, which are
    or-ed per object before the shuffle; pairs at least a bin apart mark nothing.  Objects with no free step among the
    first `steps` go on from the last one, without those of their pairs that have equal times, which no step parts; such objects are
    unresolved.  There the step is found by arithmetic (`steps.first_free`), however far it is; an object whose times
    are so close that the grid ends before is unresolved too.  One pass over the observations.
    """
    grid = frac_grid(steps)
    order = Window.partitionBy("object_id").orderBy("t", "seq")
    known = F.col("band").isin(bands)
    same = F.when(known, F.lag("t").over(Window.partitionBy("object_id", "band").orderBy("t", "seq")))
    back = F.lag("t", max_per_bin).over(order)
    pairs = obs.select("object_id", "t", F.array(same, back).alias("p")).select("object_id", "t", F.explode("p").alias("p"))
    masks = []
    for lo in range(0, steps, MASK):
        some = F.array(*map(F.lit, grid[lo : lo + MASK]))
        bit = lambda f, i: F.when(bin_of(F.col("p"), f) == bin_of(F.col("t"), f), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
        mask = F.aggregate(F.transform(some, lambda f, i: F.struct(f.alias("f"), i.alias("i"))), F.lit(0).cast("long"), lambda m, s: m.bitwiseOR(bit(s["f"], s["i"])))
        close = F.col("p").isNotNull() & (F.col("t") - F.col("p") < 1.0 / grid[0] + 1e-9)
        masks.append(F.bit_or(F.when(close, mask).otherwise(F.lit(0).cast("long"))))
    tight = F.col("p").isNotNull() & (F.col("t") - F.col("p") < 1.0 / grid[-1] + 1e-9)
    found = pairs.groupBy("object_id").agg(*(m.alias(f"m{k}") for k, m in enumerate(masks)), F.collect_list(F.when(tight, F.struct("p", "t"))).alias("_close"))
    free = F.array(*(F.when(F.getbit(f"m{s // MASK}", F.lit(s % MASK)) == 0, F.lit(g)) for s, g in enumerate(grid)))
    first = found.select("object_id", F.get(F.filter(free, lambda f: f.isNotNull()), F.lit(0)).alias("_first"), "_close")
    first = first.withColumn("_close", F.when(F.col("_first").isNull(), F.col("_close")))
    kind = obs.schema["object_id"].dataType.simpleString()
    return first.mapInPandas(_further(steps - 1), f"object_id {kind}, frac double, unresolved boolean")


def _further(last: int):
    """Objects without a free step among the first get the least one from index `last` on that parts all pairs with different times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = Grid()
        for b in batches:
            frac, unresolved = b["_first"].to_numpy(float).copy(), np.zeros(len(b), bool)
            for i in np.flatnonzero(np.isnan(frac)):
                p, t = (np.asarray([x[n] for x in b["_close"].iloc[i]], float) for n in ("p", "t"))
                apart = p != t
                frac[i], free = first_free(grid, p[apart], t[apart], last)
                unresolved[i] = not (free and apart.all())
            yield pd.DataFrame({"object_id": b["object_id"], "frac": frac, "unresolved": unresolved})

    return run


def adaptive_bins(obs: DataFrame, bands: list[str] = BANDS, max_per_bin: int = 4, steps: int = 200) -> DataFrame:
    """Adds frac, unresolved and bin."""
    found = adaptive_frac(obs, bands, max_per_bin, steps)
    return obs.join(found, "object_id").withColumn("bin", bin_of(F.col("t"), F.col("frac")))


def align_bands(binned: DataFrame, bands: list[str] = BANDS) -> DataFrame:
    """One row per object and bin: mean t, each band's flux and error (null: none), and ok: no band occurs twice.

    Unknown bands count in n and t but add no value.
    """
    wide = band_columns(bands)
    counts = [F.count(F.when(F.col("band") == b, 1)) <= 1 for b in bands]
    ok = counts[0]
    for c in counts[1:]:
        ok = ok & c
    return binned.groupBy("object_id", "bin").agg(F.avg("t").alias("t"), F.count(F.lit(1)).alias("n"), *(F.max(c).alias(n) for n, c in wide.items()), ok.alias("ok"))


def nearest_values(obs: DataFrame, times: DataFrame, bands: list[str], value: str = "flux_err", rows: int | None = None) -> DataFrame:
    """times (object_id, bin, t) for each band, with `value` of the nearest observation of the band: the first of equals, 0 for none.

    All bands in one pass: observations and times of an object and band are sorted together, not joined pair by pair.
    With `rows`, they are cut into ranges of about so many rows, for objects that are larger than a task.
    """
    one = obs.filter(F.col("band").isin(bands)).groupBy("object_id", "band", "t").agg(F.min(F.struct("seq", value)).alias("_p"))
    both = one.select("object_id", "band", "t", F.lit(-1).cast("long").alias("bin"), F.lit(0).alias("_asks"), F.struct("t", F.col(f"_p.{value}").alias("v")).alias("_p"))
    kind = both.schema["_p"].dataType
    asked = times.select("object_id", F.explode(F.array(*map(F.lit, bands))).alias("band"), "t", "bin", F.lit(1).alias("_asks"), F.lit(None).cast(kind).alias("_p"))
    near = last_and_next(both.unionByName(asked), ["object_id", "band"], ["t", "_asks", "bin"], ["_p"], rows).filter("_asks = 1")
    a, b = F.col("_last__p"), F.col("_next__p")
    closer = b["t"] - F.col("t") < F.col("t") - a["t"]
    got = F.when(a.isNull() | closer, b["v"]).otherwise(a["v"])
    return near.select("object_id", "bin", "t", "band", F.coalesce(got, F.lit(0.0)).alias("value"))


def nearest_value(obs: DataFrame, times: DataFrame, band: str, value: str = "flux_err") -> DataFrame:
    """nearest_values of one band."""
    return nearest_values(obs, times, [band], value)
