"""What the operators of this subpackage share: tables, scratch space, sized broadcasts, salted lookups, ranks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words as runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows of a side that is broadcast; every such side is counted first, and a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Pieces into which one hot key is dealt.
SALTS = 32

_OWN: dict[str, str] = {}
_STEP = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; a folder of our own only on a local master (tests) that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _OWN[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if getattr(_STEP, "paths", None) is not None:
        _STEP.paths.append(path)
    return path


@contextmanager
def scratch_of_a_step() -> Iterator[list[str]]:
    """The scratch paths that this thread asks for inside, so that they can be discarded once the step's result is written."""
    before, _STEP.paths = getattr(_STEP, "paths", None), []
    try:
        yield _STEP.paths
    finally:
        _STEP.paths = before


def discard(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows at most `rows` rows, else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def joined_by(docs: DataFrame, keys: list[Column], other: DataFrame, how: str) -> DataFrame:
    """docs as a struct `_row` joined with `other`, whose first columns are the keys (nulls are equal); no names clash."""
    packed = docs.select(F.struct("*").alias("_row"), *(k.alias(f"_key{i}") for i, k in enumerate(keys)))
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_key{i}").eqNullSafe(F.col(other.columns[i]))
    return packed.join(small(other), on, how)


def without(docs: DataFrame, keys: list[Column], bad: DataFrame) -> DataFrame:
    """The rows of docs whose keys aren't rows of `bad`, with the columns of docs."""
    return joined_by(docs, keys, bad, "left_anti").select("_row.*")


def salt(*columns: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salts_seen(column: str = "salt") -> Column:
    """An aggregate: the salts of a group, as a bit mask (combined before the shuffle, whatever the group's size)."""
    return F.bit_or(F.expr(f"shiftleft(1L, {column})"))


def each_salt(mask: str = "salts") -> Column:
    """A row for each salt of such a mask."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col(mask), i) == 1))


def looked_up(rows: DataFrame, key: str, other: DataFrame, keys: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows (key, salt, ...) joined with the one row that `other` (key, ...) has for each key.

    The rows of a hot key stay dealt out by their salts; a row of `other` is repeated for the salts that its key has.
    `keys` are the (key, salt) of rows, where these are cheaper to come by.
    """
    seen = (rows if keys is None else keys).groupBy(key).agg(salts_seen().alias("_salts"))
    each = other.join(seen, key).withColumn("salt", each_salt("_salts")).drop("_salts")
    return rows.join(each, [key, "salt"], how)


def word_count(text: Column) -> Column:
    """Number of WORDs; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """16 bytes that are equal for equal texts; null has the key of the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def met(rows: DataFrame, key: str, other: DataFrame, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows (key, salt, ...) joined with the one row of `other` (key, ...): broadcast if a count allows it, else by salts."""
    if other.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(other), key, how)
    return looked_up(rows, key, other, how=how)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, tie: list[str] | None = None, weight: str | None = None, rows: int | None = None) -> DataFrame:
    """Adds `out`: the 0-based rank of each row in its group, or, with `weight`, the sum of the weights before it.

    Rows are dealt into buckets by a hash of `order`, so the order is a fixed shuffle, whatever the rows' places; `tie` orders rows
    that are equal in `order`.  Groups must have no nulls.  Buckets hold about the square root of all rows, 4,000 at
    most, however large a group is: a group's rows never meet in one task, only its bucket totals do.
    """
    n = df.count() if rows is None else rows
    buckets = max(1, -(-n // min(4_000, max(64, isqrt(max(n, 1))))))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("bucket"), *order), F.lit(buckets)).cast("int"))
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    sums = df.groupBy(*group, "_bucket").agg(amount.alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long")).drop("_sum")
    inside = Window.partitionBy(*group, "_bucket").orderBy(F.xxhash64(F.lit("order"), *order), *order, *(tie or []))
    within = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(inside) - 1
    return df.join(sums, [*group, "_bucket"]).withColumn(out, (F.col("_base") + within).cast("long")).drop("_bucket", "_base")


def chi2_quantile(p: float, dims: int) -> float:
    """Quantile of the chi-square distribution, by the Wilson-Hilferty cube."""
    from statistics import NormalDist

    a = 2 / (9 * dims)
    return dims * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3
