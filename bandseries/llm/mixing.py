"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined_by, met, numbered, salt, stored, table, word_count

#: Words in a block, about; each source has blocks of one length near it.
BLOCK = 64
#: Turns that one row stands for before it is spread out.
CHUNK = 1 << 16


def source_targets(sizes: DataFrame, weights: list[int], most: float = 3.0) -> DataFrame:
    """(source, rank, n, source_size, target) of each source of sizes (source, size), one row per document.

    Sources by code point, null last, have the weights in turn.  All sizes are shared out by weight; no target exceeds
    `most` times its source's size, and what is over goes to the others by weight, until none is above.  That end is a
    water level: target = min(most x size, level x weight), so it is found in one pass over the sources in the order in
    which they reach their limit.
    """
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1).cast("double"))
    ranked = ranked.withColumn("limit", most * F.col("source_size")).withColumn("full_at", F.col("limit") / F.col("weight"))
    by = Window.orderBy("full_at", "rank")
    filled = F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(0))
    level = (F.sum(F.col("source_size").cast("double")).over(every) - filled) / open_
    ranked = ranked.withColumn("level", level).withColumn("order", F.row_number().over(by))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("order", "level"))).over(every)
    target = F.least("limit", first["level"] * F.col("weight"))
    return ranked.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "rank", "n", "source_size", "target")


def slot_of(bits: int, first: Column, end: Column, turn: Column) -> Column:
    """The slot at which a source has its turn, counted from 0: the turn-th smallest van der Corput point of its steps first .. end - 1.

    The point of a step has its `bits` bits in reverse order, so a slot's leading bits are a step's last ones.  Bit by
    bit, the steps of the run with the bits so far and a 0 next are counted; their slots come before those with a 1.
    """
    power = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)
    turn, first, end = (c.cast("long") for c in (turn, first, end))

    def next_bit(held: Column, j: Column) -> Column:
        m = power(j + 1)
        below = lambda n: F.call_function("div", n + m - 1 - held["low"], m)
        zeros = below(end) - below(first)
        one = (held["turn"] >= zeros).cast("long")
        return F.struct((held["turn"] - one * zeros).alias("turn"), (held["low"] + one * power(j)).alias("low"), (held["slot"] * 2 + one).alias("slot"))

    zero = F.lit(0).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.struct(turn.alias("turn"), zero.alias("low"), zero.alias("slot")), next_bit)["slot"]


def schedule(targets: DataFrame, bits: int) -> DataFrame:
    """(slot, rank, turn, block): which source each slot of the mix takes from, and which of its blocks.

    targets: (rank, first, slots, blocks).  Slot i has the i-th van der Corput point, one of 2**bits equal steps.  Sources own
    runs of steps as long as their slots, one after the other, so every stretch of the mix has each source in its
    share.  A source's slots in order are its turns; turn t takes block t modulo its number of blocks.
    """
    chunks = targets.filter("slots > 0").select("*", F.explode(F.expr(f"sequence(0L, slots - 1, {CHUNK}L)")).alias("from"))
    turns = chunks.repartition("rank", "from").select("*", F.explode(F.expr(f"sequence(from, least(from + {CHUNK}L, slots) - 1)")).alias("turn"))
    slot = slot_of(bits, F.col("first"), F.expr("first + slots"), F.col("turn"))
    return turns.select(slot.alias("slot"), "rank", "turn", F.expr("turn % blocks").alias("block"))


def _placed(docs: DataFrame, weights: list[int] | None, most: float, block: int) -> tuple[DataFrame, int]:
    """doc_id, hash, source, size, source_size, target, taken, and the place in the schedule (turn, blocks, first, slots) of each row; the schedule's bits."""
    read = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("hash"), word_count(F.col("text")).alias("size"))
    sizes = stored(read.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", salt("row")), "sizes")
    targets = source_targets(sizes, weights or [1, 2, 3], most)
    wanted = F.greatest(F.round(F.col("source_size") / block), F.lit(1)).cast("long")
    length = F.ceil(F.col("source_size") / wanted).cast("long")
    targets = targets.withColumn("length", F.greatest(length, F.lit(1)))
    targets = targets.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    slots = F.least(F.round(F.col("target") / F.col("length")).cast("long"), F.floor(most * F.col("blocks")).cast("long"))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    targets = stored(targets.withColumn("slots", slots).withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0)).cast("long")), "targets")
    total = targets.agg(F.sum("slots").alias("slots"), F.sum("n").alias("n")).first()
    bits = max(1, (int(total["slots"] or 1) - 1).bit_length())

    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("?"))
    few = targets.select(named(F.col("source")).alias("_name"), "rank", "source_size", "target", "length", "blocks", "first", "slots")
    rows = met(sizes.withColumn("_name", named(F.col("source"))), "_name", few).drop("_name", "salt")
    lined = numbered(rows.filter("size > 0"), ["rank"], ["hash"], "offset", ["row"], "size", int(total["n"] or 0))
    # Turn t takes block t modulo blocks: all blocks slots div blocks times, and the first slots % blocks once more.
    more = F.greatest(F.lit(0), F.expr("least(offset + size, slots % blocks * length) - offset"))
    lined = lined.withColumn("taken", (F.expr("slots div blocks * size") + more).cast("long")).withColumn("turn", F.expr("offset div length"))
    none = rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("turn", F.lit(None).cast("long"))
    columns = ["doc_id", "hash", "source", "size", "source_size", "target", "taken", "turn", "blocks", "first", "slots"]
    return lined.select(*columns).unionByName(none.select(*columns)), bits


def mix(docs: DataFrame, weights: list[int] | None = None, most: float = 3.0, block: int = BLOCK) -> DataFrame:
    """doc_id, hash, source, size, source_size, target, taken and first_slot of each row of docs (doc_id, text, source).

    size is the number of words (runs without ASCII white space; null: 0), targets are source_targets.  A source's documents
    stand in a fixed shuffled order (a hash of doc_id and text) on a line of words, cut into blocks of equal length
    (the last may be shorter).  The schedule says which block each slot of the mix takes: taken counts a document's words
    in the taken blocks, and first_slot is the slot that takes its first block first (null: nothing is taken).  A
    source takes its target to within about a block, and no block, so no word, more than `most` times.  Reruns agree,
    however the rows are partitioned: only equal rows (doc_id and text) may swap what they take.  Documents without words
    take part in ranking the sources and take nothing; null doc_ids and repeated rows are ordinary rows; other columns
    are not read.  No rows: an empty result.
    """
    placed, bits = _placed(docs, weights, most, block)
    slot = F.when(F.col("taken") > 0, slot_of(bits, F.col("first"), F.expr("first + slots"), F.col("turn")))
    return placed.select("doc_id", "hash", "source", "size", "source_size", "target", "taken", slot.alias("first_slot"))


def mixed(docs: DataFrame) -> DataFrame:
    """(_row, slot): each row of docs as often as the mix takes it (taken / size, rounded), at the slots that take its first block."""
    placed, bits = _placed(docs, None, 3.0, BLOCK)
    place = F.min(F.struct("turn", "blocks", "first", "slots")).alias("_place")
    taken = placed.groupBy("doc_id", "hash").agg(F.max("size").alias("_size"), F.avg("taken").alias("_taken"), place).filter("_taken > 0")
    times = F.round(F.col("_taken") / F.col("_size")).cast("int").alias("_times")
    taken = stored(taken.select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"), times, "_place").filter("_times > 0"), "times")
    found = joined_by(docs, [F.col("doc_id"), F.xxhash64("doc_id", "text")], taken, "inner")
    each = found.select("_row", "_place", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("_copy"))
    turn = F.expr("least(_place.turn + _copy * _place.blocks, _place.slots - 1)")
    return each.select("_row", slot_of(bits, F.col("_place.first"), F.expr("_place.first + _place.slots"), turn).alias("slot"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each row as many times as the mix takes it (0 to 3), in the order of the mix, with the columns of docs.

    Null doc_ids and repeated rows are ordinary rows; rows that are equal in doc_id and text are taken equally often.  No rows: none.
    """
    return mixed(docs).repartitionByRange("slot").sortWithinPartitions("slot").select("_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLE: dict[str, str] = {}
