"""Sequences: an object's rows as one array, padded, cut, reversed and flattened."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(rows: DataFrame, features: list[str], order: str = "t", keys: list[str] | None = None, label: str | None = None) -> DataFrame:
    """One row per key (default object_id): length, and seq, the feature rows in order; with `label` its first value."""
    keys = keys or ["object_id"]
    got = F.sort_array(F.collect_list(F.struct(order, F.array(*(F.col(f).cast("double") for f in features)).alias("row"))))
    extra = [F.first(label).alias(label)] if label else []
    packed = rows.groupBy(*keys).agg(got.alias("_s"), *extra)
    return packed.select(*keys, *([label] if label else []), F.size("_s").alias("length"), F.transform("_s", lambda s: s["row"]).alias("seq"))


def check_width(sequences: DataFrame, width: int) -> DataFrame:
    """The sequences with a row of another width."""
    return sequences.filter(F.exists("seq", lambda r: F.size(r) != width))


def padded(seq: Column, length: Column | int, width: int, padding: str = "pre", truncating: str = "pre", value: float = -1.0) -> Column:
    """seq cut or padded to `length` rows of `width`; each end `pre` or `post`."""
    for name, side in (("padding", padding), ("truncating", truncating)):
        if side not in ("pre", "post"):
            raise ValueError(f"{name} {side!r}: use pre or post")
    length = F.lit(length) if isinstance(length, int) else length
    cut = F.slice(seq, F.greatest(F.size(seq) - length + 1, F.lit(1)) if truncating == "pre" else F.lit(1), length)
    pads = F.array_repeat(F.array(*[F.lit(float(value))] * width), F.greatest(length - F.size(seq), F.lit(0)))
    return F.concat(pads, cut) if padding == "pre" else F.concat(cut, pads)


def pad_sequences(sequences: DataFrame, width: int, maxlen: int | None = None, padding: str = "pre", truncating: str = "pre", value: float = -1.0) -> DataFrame:
    """seq of one length for all: maxlen, or the longest (one number, aggregated first)."""
    if maxlen is None:
        maxlen = sequences.agg(F.max(F.size("seq"))).first()[0] or 0
    return sequences.withColumn("seq", padded(F.col("seq"), maxlen, width, padding, truncating, value))


def reversed_view(sequences: DataFrame, width: int, maxlen: int | None = None, value: float = -1.0) -> DataFrame:
    """Padded at the end, then in reverse order."""
    return pad_sequences(sequences, width, maxlen, "post", "post", value).withColumn("seq", F.reverse("seq"))


def flat_vector(sequences: DataFrame, out: str = "features") -> DataFrame:
    """All rows of seq one after the other, as a vector for ML."""
    return sequences.withColumn(out, array_to_vector(F.flatten("seq")))


def exploded(sequences: DataFrame, names: list[str]) -> DataFrame:
    """One row per position: object_id, pos and the features."""
    rows = sequences.select("object_id", F.posexplode("seq").alias("pos", "row"))
    return rows.select("object_id", "pos", *(F.col("row")[k].alias(n) for k, n in enumerate(names)))


def profile(sequences: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Per key: objects, longest and total length, row width, number of classes."""
    return sequences.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_objects"), F.max("length").cast("long").alias("max_length"), F.sum("length").cast("long").alias("n_rows"),
        F.max(F.size(F.get("seq", F.lit(0)))).cast("long").alias("width"), F.count_distinct(label).alias("n_classes"),
    )
