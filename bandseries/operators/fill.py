"""Gaps of aligned epochs: random values between neighbours, nearest values at the edges, augmentation passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from ..functions.scans import last_and_next
from ..schemas import BANDS


def passes(aligned: DataFrame, n: int = 5) -> DataFrame:
    """Each row once for each augmentation pass 1 .. n."""
    return aligned.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(n))))


def fill_gaps(aligned: DataFrame, bands: list[str] = BANDS, seed: int = 42, interior: bool = True, rows: int | None = None, n_passes: int | None = None) -> DataFrame:
    """Every missing band value of aligned epochs (object_id, bin, t, bands; perhaps pass).

    Between two known values: uniform between them, by a hash of seed, pass, object, bin and column (with `interior`
    off: the earlier value).  Before the first or after the last: that value.  No value at all: 0.  Errors likewise.
    With `rows`, objects are cut into ranges of about so many rows, for objects that are larger than a task.  `n_passes` gives what
    `passes(aligned, n_passes)` would: neighbours are the same in each pass, so they are found before rows are repeated.
    """
    key = ["pass", "object_id"] if "pass" in aligned.columns else ["object_id"]
    columns = [*bands, *(f"{b}_err" for b in bands)]
    near = last_and_next(aligned, key, ["bin"], columns, rows)
    if n_passes is not None:
        key, near = ["pass", *key], passes(near, n_passes)
    out = {}
    for c in columns:
        before, after = F.col(f"_last_{c}"), F.col(f"_next_{c}")
        inner = before + hash_uniform(seed, *key, "bin", F.lit(c)) * (after - before) if interior else before
        out[c] = F.coalesce(F.col(c), inner, before, after, F.lit(0.0))
    return near.withColumns(out).drop(*(f"_{w}_{c}" for w in ("last", "next") for c in columns))
