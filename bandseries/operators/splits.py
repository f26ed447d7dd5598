"""Splits: objects into train and test, rows into folds, gathering by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import rank_by_uniform
from ..functions.scalars import hash_uniform


def object_ids(rows: DataFrame, key: str = "object_id") -> DataFrame:
    return rows.select(key).distinct()


def split_objects(ids: DataFrame, test_fraction: float = 0.2, seed: int = 42, key: str = "object_id") -> DataFrame:
    """(key, split): floor(n x fraction) of the ids, by a hash of seed and id, are `test`, the rest `train`.  Exact at any size."""
    n = ids.count()
    placed = rank_by_uniform(ids.withColumn("_u", hash_uniform(seed, key)).withColumn("_all", F.lit(0)), ["_all"], "_u", [key], "_rank")
    return placed.select(key, F.when(F.col("_rank") < int(n * test_fraction), "test").otherwise("train").alias("split"))


def route(rows: DataFrame, split: DataFrame, key: str = "object_id") -> tuple[DataFrame, DataFrame]:
    """(train, test): rows of any pass follow their own object's split."""
    test = split.filter("split = 'test'").select(key)
    return rows.join(test, key, "left_anti"), rows.join(test, key, "left_semi")


def gather(rows: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """The rows at the positions, as often as each is asked for; a position that no row has gives none."""
    return positions.select(key).join(rows, key)


def stratified_folds(rows: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to k - 1: each class is dealt out in the order of a hash, so folds differ by one per class at most."""
    ranked = rank_by_uniform(rows.withColumn("_u", hash_uniform(seed, key)), [label], "_u", [key], "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_u", "_rank")
