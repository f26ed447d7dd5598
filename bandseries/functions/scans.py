"""Scans along a group's order: the last and the next known values of each row, also where a group is larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import ranged


def last_and_next(df: DataFrame, group: list[str], order: list[str], columns: list[str], rows: int | None = None, following: bool = True) -> DataFrame:
    """Adds `_last_c` and (with `following`) `_next_c` for each column c: its last value that isn't null up to the row, and its next one from the row on.

    `order` leaves no ties in a group.  Without `rows` a group is sorted in one task.  With it, the table is cut into
    ranges of (group, order) of about so many rows, whatever the groups: each range's first and last known values are
    carried along its group, one row for a range, and ranges are scanned apart.  So one group of all rows is spread over all tasks.
    """
    pieces = 1
    if rows is not None:
        df, pieces = ranged(df, [F.col(c) for c in [*group, *order]], "scan", rows)
    own = [*group, "_piece"] if pieces > 1 else group
    past = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Two running scans: a frame that ends with the partition would be read to its end for every row.
    future = Window.partitionBy(*own).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0)
    if pieces > 1:
        known = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v")))
        ends = df.groupBy(*own).agg(*(F.max(known(c)).alias(f"_l_{c}") for c in columns), *(F.min(known(c)).alias(f"_f_{c}") for c in columns))
        way = lambda by: Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        carry = lambda name, by: F.last(name, ignorenulls=True).over(way(by))["_v"]
        ends = ends.select(
            *(F.col(c).alias(f"_k{i}") for i, c in enumerate(own)), *(carry(f"_l_{c}", "_piece").alias(f"_l_{c}") for c in columns), *(carry(f"_f_{c}", F.desc("_piece")).alias(f"_f_{c}") for c in columns)
        )
        on = F.lit(True)
        for i, c in enumerate(own):
            on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        df = df.join(ends, on).drop(*(f"_k{i}" for i in range(len(own))))
    scan = lambda c, w, carried: F.coalesce(F.last(c, ignorenulls=True).over(w), *([F.col(carried)] if pieces > 1 else []))
    out = {f"_last_{c}": scan(c, past, f"_l_{c}") for c in columns}
    if following:
        out |= {f"_next_{c}": scan(c, future, f"_f_{c}") for c in columns}
    return df.withColumns(out).drop("_piece", *(f"_{k}_{c}" for k in "lf" for c in columns))
