"""Ranks and running totals in two levels, so that no group and no whole table is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stored

#: Rows of a bucket or range, about: as many of these are made as the rows need.
PIECE = 8192


def rank_by_uniform(df: DataFrame, group: list[str], u: str, tie: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """Adds `out`, the 0-based rank by (u, tie) in the group; u is uniform in [0, 1).

    Equal steps of u are buckets of like size, of about PIECE rows over all groups; bucket counts give each bucket's first
    rank, and rows are ranked inside their bucket.  A group with a third of all rows is spread over all buckets.
    """
    buckets = buckets or max(1, -(-df.count() // PIECE))
    df = df.withColumn("_bucket", F.floor(F.col(u) * buckets).cast("int"))
    counts = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(u, *tie)
    joined = df.join(first, [*group, "_bucket"])
    return joined.withColumn(out, (F.col("_first") + F.row_number().over(inside) - 1).cast("long")).drop("_bucket", "_first")


def ranged(df: DataFrame, order: list[Column], name: str = "ranges", rows: int = PIECE) -> tuple[DataFrame, int]:
    """df with `_piece`, the number of the range of `order` that a row is in, and how many ranges there are.

    Ranges are sampled by Spark's range partitioner and hold about `rows` rows each, however many there are, as long as `order`
    has few equal rows; they are written once, as a later sample may cut elsewhere.  A table of `rows` rows or fewer is one range and isn't written.
    """
    pieces = -(-df.count() // rows)
    if pieces <= 1:
        return df.withColumn("_piece", F.lit(0)), 1
    return stored(df.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()), name), pieces


def running_totals(df: DataFrame, group: list[str], score: str, sums: dict[str, str], rows: int = PIECE) -> DataFrame:
    """Adds for each item of sums (new name: column) the column's sum over the rows of the group with a higher or equal score.

    df has one row for each group and score.  Ranges of (group, score) take about `rows` rows each; range totals and sums
    inside the ranges add up to the exact running totals, whatever the cuts.
    """
    df, pieces = ranged(df, [*map(F.col, group), F.desc(score)], rows=rows)
    inside = Window.partitionBy(*group, "_piece").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    if pieces == 1:
        return df.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).drop("_piece")
    totals = df.groupBy(*group, "_piece").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    above = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_piece", *(F.coalesce(F.sum(f"_t_{n}").over(above), F.lit(0)).alias(f"_a_{n}") for n in sums))
    joined = df.join(totals, [*group, "_piece"])
    return joined.withColumns({n: F.col(f"_a_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop("_piece", *(f"_a_{n}" for n in sums))
