"""Near-duplicates: DartMinHash signatures, banded joining, exact checks, and classes of linked texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, each_salt, looked_up, met, salt, salts_seen, small, stored, table, text_key, without
from .graph import components
from .textnum import BASE, Hasher, U, blocks, mix, shingles, trim, words

COORDINATES = 96
SIMILARITY = 0.8
#: Bytes of text, and cells of the dart board, that a worker has in memory at a time.
TEXT_BYTES, CELLS = 1 << 19, 1 << 18
#: Most rounds of pivots in split buckets, before all pairs that are left are compared, and about how many of these at a time.
ROUNDS = 4
PAIRS = 200_000
#: Buckets of more members than this have their pairs narrowed by what members share with other labels at all.
FEW = 8
#: Longs in a text's sketch of parities.
SKETCH = 16

# Poisson(1): the chance of at most k darts in a region of area 1, as 64-bit thresholds.
_P = np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 12.0))))
DARTS = np.minimum(np.cumsum(_P) * 2.0**64, 2.0**64 - 4096).astype(U)


def dart_signatures(element: np.ndarray, weight: np.ndarray | None, begin: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash: k values for each set; set i has the elements [begin[i], begin[i + 1]), hashed, with weights (None: 1).

    The plane of weight x rank above each element is cut into regions of area 1.  A region's hash says how many darts
    (Poisson, mean 1) fall into it; each dart's hash says at which weight, rank and coordinate.  A dart under the
    element's weight counts, and each coordinate keeps its earliest dart (least rank).  Two sets agree at a coordinate with the
    probability of their weighted Jaccard similarity.  Regions are opened by rank, as many as a set needs for all its
    coordinates to be hit, which is about k ln k darts a set, however large k or few its elements; repeated elements
    throw the same darts and so change nothing.  A set without elements keeps the value 2**64 - 1.
    """
    n = np.diff(begin)
    out = np.full((len(n), k), np.iinfo(U).max, U)
    owner = np.repeat(np.arange(len(n)), n)
    weight = np.ones(len(element)) if weight is None else np.asarray(weight, float)
    total = np.bincount(owner, weight, len(n))
    step = np.where(total > 0, np.ceil(k * (np.log(k) + 4) / np.maximum(total, 1e-9)), 0).astype(np.int64)
    done = np.zeros(len(n), np.int64)
    open_ = total > 0
    while open_.any():
        use = np.flatnonzero(open_[owner] & (weight > 0))
        per = step[owner[use]] * np.ceil(weight[use]).astype(np.int64)
        for lo, hi in _runs(per, CELLS):
            own, p = use[lo:hi], per[lo:hi]
            cell = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
            of = np.repeat(own, p)
            high = step[owner[of]]
            column, row = cell // high, cell % high + done[owner[of]]
            region = mix(element[of] ^ mix(row.astype(U) * U(BASE) + column.astype(U) * U(0xD1342543DE82EF95) + U(1)))
            darts = np.searchsorted(DARTS, region, "right")
            hit = np.repeat(np.arange(len(of)), darts)
            nth = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(region[hit] + (nth + 1).astype(U) * U(BASE))
            at = of[hit]
            under = column[hit] + (mix(dart ^ U(0x5851F42D4C957F2D)) >> U(40)).astype(float) * 2.0**-24 <= weight[at]
            dart, at, rank = dart[under], at[under], row[hit][under]
            where = owner[at] * k + (dart % U(k)).astype(np.int64)
            # Rank is the row and then a fraction of 32 bits; the low bits tell darts of one rank apart.
            value = (np.minimum(rank, 0xFFFE).astype(U) << U(48)) | (mix(dart) >> U(16))
            np.minimum.at(out.reshape(-1), where, value)
        done += np.where(open_, step, 0)
        open_ &= (out == np.iinfo(U).max).any(axis=1)
        step = np.where(open_, np.maximum(step, 1), step)
    return out


def _runs(amount: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose amounts sum to about `most`."""
    if not len(amount):
        return
    ends = np.cumsum(amount)
    lo = 0
    while lo < len(amount):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def band_width(similarity: float, k: int = COORDINATES) -> int:
    """The widest bands of k coordinates that miss a pair of that similarity with a probability of at most 1e-5."""
    return max((w for w in range(1, k + 1) if k % w == 0 and (1 - similarity**w) ** (k // w) <= 1e-5), default=1)


def bands(signature: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit value for each run of `width` coordinates."""
    out = np.zeros((len(signature), signature.shape[1] // width), U)
    for j in range(out.shape[1]):
        for c in range(width):
            out[:, j] = mix(out[:, j] * U(BASE) + signature[:, j * width + c] + U(j + 1))
    return out


def _hashed(block) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(block)
    return shingles(Hasher(block.data)(start, end), first)


def weighted(element: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set's distinct elements and how often each occurs."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((element, owner))
    e, o = element[order], owner[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return e[at], np.diff(np.append(at, len(e))).astype(float), np.searchsorted(o[at], np.arange(len(begin)))


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b["text"], TEXT_BYTES):
                element, weight, begin = weighted(*_hashed(block))
                got = bands(dart_signatures(element, weight, begin), width).view(np.int64)
                some = np.diff(begin) > 0
                at = np.concatenate(([0], np.cumsum(np.where(some, got.shape[1], 0)))).astype(np.int32)
                total = np.diff(np.concatenate(([0.0], np.cumsum(weight)))[begin]).astype(np.int64)
                part = b.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part["doc_id"], "key": part["key"], "n": pa.array(total), "bands": pa.ListArray.from_arrays(pa.array(at), pa.array(got[some].ravel()))}
                )
        trim()

    return run


def shared_weight(element: np.ndarray, weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For m pairs of sets, as weighted() gives them (the m first ones, then their m partners): the sum of lesser weights."""
    m = (len(begin) - 1) // 2
    pair = np.repeat(np.arange(2 * m) % m if m else np.arange(0), np.diff(begin))
    order = np.lexsort((element, pair))
    e, o, w = element[order], pair[order], weight[order]
    same = np.flatnonzero((e[1:] == e[:-1]) & (o[1:] == o[:-1]))  # elements of a set are distinct, so two at most are equal
    return np.bincount(o[same], np.minimum(w[same], w[same + 1]), m)


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.add(pc.binary_length(b["text"]), pc.binary_length(b["theirs"])).to_numpy(zero_copy_only=False)
            for lo, hi in _runs(size, TEXT_BYTES):
                both = pa.concat_arrays([b[c].slice(lo, hi - lo).cast(pa.large_string()) for c in ("text", "theirs")])
                (block,) = blocks(both, int(size[lo:hi].sum()) + 1)
                element, weight, begin = weighted(*_hashed(block))
                total = np.diff(np.concatenate(([0.0], np.cumsum(weight)))[begin])
                shared = shared_weight(element, weight, begin)
                yes = pa.array(shared >= similarity * (total[: hi - lo] + total[hi - lo :] - shared) - 1e-9)
                yield pa.RecordBatch.from_pydict({c: b[c].slice(lo, hi - lo).filter(yes) for c in ("a", "b")})
        trim()

    return run


def _split(active: DataFrame, turn: int) -> DataFrame:
    """active (node, buckets, ...) once for each of its buckets, narrowed by one other of them: what shares both is more alike.

    The other one is the least by a hash of the round and both, so nodes that share most of their buckets mostly choose
    the same, and other ones in each round: as many rows as buckets.
    """
    partner = lambda x: F.array_min(F.transform(F.filter("buckets", lambda y: y != x), lambda y: F.xxhash64(F.lit(turn), x, y)))
    chosen = F.transform("buckets", lambda x: F.coalesce(partner(x), x))
    return active.select(*(c for c in active.columns if c != "buckets"), F.explode(chosen).alias("bucket"))


def _against_pivots(placed: DataFrame, order: Column, similarity: float) -> DataFrame:
    """(a, b, pivot): each bucket's members with its pivot, the member of the highest `order`, where labels differ and sizes allow the similarity.

    One pair for each member at most, however large a bucket is.
    """
    placed = placed.withColumn("_order", order)
    top = lambda c: F.max_by(c, "_order")
    turn = placed.groupBy("bucket").agg(
        top("node").alias("pivot"), top("label").alias("pivot_label"), top("n").alias("pivot_n"), F.min("label").alias("lo"), F.max("label").alias("hi"), salts_seen().alias("salts")
    ).filter("lo <> hi")
    turn = turn.select("bucket", "pivot", "pivot_label", "pivot_n", each_salt().alias("salt"))
    met = placed.join(turn, ["bucket", "salt"]).filter((F.col("label") != F.col("pivot_label")) & (F.least("n", "pivot_n") >= similarity * F.greatest("n", "pivot_n") - 1e-9))
    return met.groupBy(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).agg(F.max("pivot").alias("pivot"))


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, pivot) whose texts have at least the similarity; a pivot of many pairs is dealt out by salts.

    Texts go through the joins, and their shingles are made where they are compared: these take several times the bytes.
    """
    both = pairs.withColumn("node", F.col("a") + F.col("b") - F.col("pivot")).withColumn("salt", salt("node")).join(texts, "node")
    both = looked_up(both, "pivot", texts.select(F.col("node").alias("pivot"), F.col("text").alias("theirs")), pairs.select("pivot", salt(F.col("a") + F.col("b") - F.col("pivot")).alias("salt")))
    return both.select("a", "b", "text", "theirs").mapInArrow(_alike(similarity), "a long, b long")


def _merged(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """labels (node, salt, label) after links (a, b), and whether there were any."""
    if not links.limit(1).count():
        return labels, False
    ends = links
    for end in ("a", "b"):
        ends = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")).join(small(ends), end)
    merged = components(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).filter("a <> b"))
    moved = met(labels, "label", merged.select(F.col("node").alias("label"), F.col("label").alias("root")), how="left")
    return stored(moved.select("node", "salt", F.coalesce("root", "label").alias("label")), "labelled"), True


def _apart(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of buckets that hold several labels, with these and how many they are, and these buckets (bucket, salts)."""
    now = members.drop("label").join(labels.select("node", "label"), "node")
    mixed = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), salts_seen().alias("salts"), F.count(F.lit(1)).alias("held")).filter("lo <> hi")
    return now.join(mixed.select("bucket", "held", each_salt().alias("salt")), ["bucket", "salt"]), mixed.select("bucket", "salts")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label, salt) with 32 bits of each distinct shingle of the text, how often it occurs, and the parities of all weights by 64 * SKETCH bins."""
    for b in batches:
        for block in blocks(b["text"], TEXT_BYTES):
            element, weight, begin = weighted(*_hashed(block))
            part, at = b.slice(block.first, block.last - block.first), pa.array(begin.astype(np.int32))
            owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            odd = np.bincount(owner * (64 * SKETCH) + (element >> U(32)).astype(np.int64) % (64 * SKETCH), weight, len(part) * 64 * SKETCH).astype(np.int64) & 1
            sketch = pa.array(np.packbits(odd.astype(bool)).view(np.int64))
            lists = {"slots": element.astype(np.uint32).view(np.int32), "times": weight.astype(np.int32)}
            yield pa.RecordBatch.from_pydict({c: part[c] for c in ("node", "label", "salt")} | {c: pa.ListArray.from_arrays(at, pa.array(x)) for c, x in lists.items()} | {"sketch": pa.ListArray.from_arrays(pa.array(np.arange(0, len(sketch) + 1, SKETCH, dtype=np.int32)), sketch)})
    trim()


def _reach(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, reach, sketch) of the members of buckets with more than FEW: the weight of the shingles that such members of other labels have as well, and parities.

    No text of another label there shares more with the node's than that.  Shingles that only seem to be equal, by their 32 bits, make it larger.
    """
    crowd = stored(apart.filter(F.col("held") > FEW).select("node", "label", salt("node").alias("salt")).distinct(), "crowd")
    slots = stored(small(crowd).join(texts, "node").select("node", "label", "salt", "text").mapInArrow(_slots, "node long, label long, salt int, slots array<int>, times array<int>, sketch array<long>"), "slots")
    each = slots.select("node", "label", "salt", F.explode(F.arrays_zip("slots", "times")).alias("x")).select("node", "label", "salt", F.col("x.slots").alias("slot"), F.col("x.times").alias("times"))
    met_by = each.groupBy("slot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), salts_seen().alias("salts")).filter("lo <> hi")
    common = each.select("node", "salt", "slot", "times").join(met_by.select("slot", each_salt().alias("salt")), ["slot", "salt"])
    return slots.select("node", "sketch").join(common.groupBy("node").agg(F.sum("times").alias("reach")), "node", "left").select("node", F.coalesce("reach", F.lit(0)).alias("reach"), "sketch")


def _rest(members: DataFrame, labels: DataFrame, tested: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """labels after all pairs that share a bucket, have different labels and weren't compared yet are compared.

    Pairs in crowded buckets are left out where the texts' shingles alone rule the similarity out: two of weights n and m
    must share similarity / (1 + similarity) of n + m, and a text can share no more than its `_reach`; they may differ in (1 - similarity) / (1 + similarity)
    of n + m, and differ in no less than the bins whose parities differ.  About PAIRS of the others at a time: what these link takes most
    of the others away, as their labels are one then.
    """
    apart, mixed = _apart(members, labels)
    apart = stored(apart.select("bucket", "salt", "node", "label", "n", "held"), "apart")
    apart = apart.join(small(stored(_reach(apart, texts), "reach"), 50_000), "node", "left")
    # With itself as the best partner that there may be: else it has none in this bucket.
    apart = stored(apart.filter((F.col("held") <= FEW) | (F.col("reach") >= similarity * F.col("n") - 1e-9)).drop("held"), "apart")
    theirs = apart.select("bucket", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("reach").alias("reach_b"), F.col("sketch").alias("sketch_b"))
    theirs = theirs.join(mixed, "bucket").withColumn("salt", each_salt()).drop("salts")
    sizes = F.least("n", "n_b") >= similarity * F.greatest("n", "n_b") - 1e-9
    enough = similarity / (1 + similarity) * (F.col("n") + F.col("n_b")) - 1e-9
    unknown = F.col("reach").isNull() | F.col("reach_b").isNull()
    differ = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(SKETCH)), F.lit(0))
    alike = (F.least("reach", "reach_b") >= enough) & (differ <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("n_b")) + 1e-9)
    sizes = sizes & (unknown | alike)
    pairs = apart.withColumnRenamed("node", "a").join(theirs, ["bucket", "salt"]).filter((F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b")) & sizes)
    pairs = stored(pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "rest")
    turn = 0
    while n := pairs.count():
        parts, turn = -(-n // PAIRS), turn + 1
        part = F.pmod(F.xxhash64(F.lit(turn), "a", "b"), F.lit(parts))
        some = pairs.filter(part == 0).withColumn("pivot", F.col("b"))
        labels, linked = _merged(labels, stored(_linked(stored(some, "pairs"), texts, similarity), "links"))
        pairs = pairs.filter(part != 0)
        if linked and parts > 1:
            for end in ("a", "b"):
                pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end)
            pairs = pairs.filter("label_a <> label_b").select("a", "b")
        pairs = stored(pairs, "rest")
    return labels


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and first of each row of docs (doc_id, text; other columns are not read).

    Two texts are linked if their 5-word shingles (words are runs without ASCII white space; a shorter text is one
    shingle), each weighing as often as it occurs, have a weighted Jaccard similarity of at least `similarity`; a class is what
    links and equal texts connect.  class_id is its smallest doc_id, and `first` marks one row of each class: that of
    class_id.  A text without words, or null, is a class of its own.  A null doc_id counts as the largest; repeated rows of
    one doc_id are all `first` or none; which of several equal texts comes first in the table changes nothing.  No rows:
    an empty result.

    Equal texts are one node.  Nodes are banded by weighted DartMinHash (at 0.8: 24 bands of 4 coordinates, which miss a pair with
    probability 3e-6; the width follows from `similarity`).  In each round every bucket has one pivot and its other members are
    held against it by their whole shingles: one pair for each member, so work grows with the members and not with their pairs.
    What is linked becomes one label; pivots meet other labels only.  In the first round pivots are the members that share most
    buckets (the original that copies were made from).  Buckets that still hold several labels are then split by every
    second such bucket that their members share, one for each member and bucket, drawn by a fresh hash each round like the pivots, until a round links nothing,
    ROUNDS times at most.  The pairs of different labels that still share a bucket and have not met are then all compared (`_rest`), so
    no pair that shares a band is left out.
    """
    return _judged(docs, similarity).drop("key")


def _judged(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """near_duplicates with the text's key: one doc_id may have several texts, each judged by itself."""
    width = band_width(similarity)
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    signed = keyed.mapInArrow(_sign(width), "doc_id long, key binary, n long, bands array<long>")
    signed = stored(signed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "signed")
    copies = signed.filter("size(bands) > 0").groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"), salts_seen().alias("row_salts")
    )
    # Numbers for nodes: shorter than keys, and only ever compared for being equal or the least.
    nodes = stored(copies.withColumn("node", F.monotonically_increasing_id()), "nodes").withColumn("salt", salt("node"))

    placed = nodes.select("node", "salt", F.explode("bands").alias("bucket"))  # many rows, so nothing else goes along
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), salts_seen().alias("salts")).filter("size > 1")
    members = placed.join(shared.select("bucket", "size", each_salt().alias("salt")), ["bucket", "salt"])
    members = members.join(nodes.select("node", F.xxhash64("key").alias("hash"), "n"), "node")
    central = F.sum("size").over(Window.partitionBy("node"))  # a node has one row for each band at most
    members = stored(members.withColumn("central", F.least(central, F.lit((1 << 31) - 1))).withColumn("label", F.col("node")), "members")

    wanted = stored(members.select("node").distinct(), "with-partners")
    some = nodes.join(wanted, "node").select("node", F.col("doc").alias("_doc"), F.col("key").alias("_key"))
    texts = keyed.join(small(stored(some, "wanted")), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]), "texts")

    labels = wanted.select("node", salt("node").alias("salt"), F.col("node").alias("label"))
    pairs = _against_pivots(members, F.shiftleft("central", 31).bitwiseOR(F.shiftrightunsigned("hash", 33)), similarity)
    tested = None
    for turn in range(1 + ROUNDS):
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        labels, linked = _merged(labels, stored(_linked(pairs, texts, similarity), "links"))
        if turn == ROUNDS or turn and not linked:
            break
        # Buckets with several labels: what can still be linked meets in some of them.
        apart, _ = _apart(members, labels)
        active = apart.groupBy("node", "label", "hash", "n", "salt").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))  # one for each band at most
        pairs = _against_pivots(_split(stored(active, "active"), turn), F.xxhash64(F.lit(turn), "bucket", "hash"), similarity)

    labels = _rest(members, labels, tested, texts, similarity)
    named = nodes.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("doc").alias("class_id"), F.sum("copies").alias("rows")).filter("rows > 1")
    grouped = looked_up(named.select("key", "label", "row_salts", "salt"), "label", classes.drop("rows"))
    grouped = grouped.select("key", "class_id", F.lit(True).alias("many"), each_salt("row_salts").alias("salt"))
    out = signed.select("doc_id", "key", "salt").join(grouped, ["key", "salt"], "left").withColumn("class_id", F.when(F.col("many"), F.col("class_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "key", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("first"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are first in their class, with the columns of docs; rows of equal doc_id and text share that, texts without words stay."""
    dropped = stored(_judged(docs).filter("NOT first").select(F.col("doc_id").alias("_bad"), F.col("key").alias("_hash")).distinct(), "dropped")
    return without(docs, [F.col("doc_id"), text_key(F.col("text"))], dropped)


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_dart_minhash": op4_dart_minhash}
ORACLE: dict[str, str] = {}
