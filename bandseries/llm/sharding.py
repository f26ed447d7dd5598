"""Sharding: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_salt, numbered, salt, salts_seen, small, stored, table, text_key

#: Size classes per doubling of a group's size: a class spans about 0.1 % of size, and there are under 1024 x 64 in all.
STEPS = 1024


def schedule(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, int, int, int]]:
    """Longest first onto the least-loaded shard: (class, shard, first rank, last rank + 1).

    classes: (class, groups in it, bytes in it), at most a few ten thousand.  While a class has more groups than
    shards, all shards are first filled to one level, as single turns of the heap would; the rest goes one by one.
    """
    heap = [(0.0, k) for k in range(shards)]
    plan = []
    for name, n, size in sorted(classes, reverse=True):
        each, rank, takes = size / n, 0, {}
        if n > 4 * shards:
            loads = sorted(heap)
            level, below = 0.0, 0.0
            for used, (load, _) in enumerate(loads, 1):
                below += load
                level = (n * each + below) / used
                if used == shards or level <= loads[used][0]:
                    break
            for load, k in loads:
                if (turns := int((level - load) / each)) > 0:
                    takes[k] = turns
            heap = [(load + takes.get(k, 0) * each, k) for load, k in heap]
            heapq.heapify(heap)
        for _ in range(n - sum(takes.values())):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + each, k))
            takes[k] = takes.get(k, 0) + 1
        for k, turns in sorted(takes.items()):
            plan.append((name, k, rank, rank + turns))
            rank += turns
    return plan


def lpt_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs (doc_id, text; other columns are not read).

    A row's size is its text's UTF-8 bytes plus 1; a null text is an empty one.  Rows of equal texts are one group and
    share a shard.  Groups are ordered by size class (0.1 % wide), the largest first, and by a fixed shuffle within a
    class; the heap works on the class table alone, whose length depends on the precision and not on the rows, and takes a
    class's mean for its groups' sizes: loads differ by a shard's share of that rounding and one group of the smallest classes.
    slot numbers the rows of a shard from 0.  Partitioning changes nothing: only equal rows may swap slots.  Null or repeated doc_ids are ordinary rows.  No rows: an empty result.
    """
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            text_key(F.col("text")).alias("key"),
        ).withColumn("row", F.monotonically_increasing_id()).withColumn("salt", salt("row")),
        "sizes",
    )
    groups = stored(
        rows.groupBy("key").agg(F.sum("size").alias("bytes"), salts_seen().alias("salts"))
        .withColumn("class", F.floor(F.log2(F.col("bytes").cast("double")) * STEPS).cast("int")),
        "groups",
    )
    classes = [tuple(r) for r in groups.groupBy("class").agg(F.count(F.lit(1)), F.sum("bytes").cast("double")).collect()]
    plan = spark.createDataFrame(schedule(classes, shards), "class int, shard int, first long, last long")
    spans = plan.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("last", "shard"))).alias("spans"))  # one per shard at most
    ranked = numbered(groups, ["class"], ["key"], "rank", rows=max(1, sum(n for _, n, _ in classes)))
    placed = ranked.join(small(spans), "class").select(
        "key", each_salt().alias("salt"), F.filter("spans", lambda s: s["last"] > F.col("rank"))[0]["shard"].alias("shard")
    )
    out = rows.join(placed, ["key", "salt"]).select("doc_id", "size", "text_crc32", "shard", "key", "row")
    return numbered(stored(out, "placed"), ["shard"], ["doc_id", "key"], "slot", ["row"]).drop("row", "key")


def op9_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lpt_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op9_lpt_sharding": op9_lpt_sharding}
ORACLE: dict[str, str] = {}
