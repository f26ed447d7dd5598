"""Packing: what documents leave over of whole windows fills windows by minimum bin slack, from counts of lengths."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, scratch, small, table
from .textnum import gather, trim

#: Tokens of a whole sequence.
CAPACITY = 4096
#: The id after each document.
END = 2


class WordEncoder:
    """Ids of whole texts by the tokenizers library, for tokenizers that drop white space and mark the ends of words; the ids of words seen before are looked up.

    Words are what stands between ASCII white space: such a tokenizer has no token, and its normalizer no rule, that
    reaches over it.  A word of plain letters and the marks behind it are looked up apart, the letters in lower case.
    New letters go to the library's model many at once, as the ids that end a word are known; all other new words go
    through the whole library, with a special token between them that marks where they end.  At most `held` words are
    remembered in a worker process; then the table starts afresh.
    """

    PLAIN = "^(?P<core>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<tail>[!-/:-@\\[-`{-~]*)$"

    def __init__(self, path: str, held: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        special = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in special.values()]
        self.mark = min(special)
        vocabulary = self.library.get_vocab()
        self.kind = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # The model alone, over words in the library's letters for bytes.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden) if b != 32}
        self.held = held
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple[bool, str] | str, int] = {}
        self.flat, self.begin, self.length = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, names: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.length), len(self.length) + len(names)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(lengths) - lengths))
        self.flat = np.concatenate((self.flat, ids.astype(self.kind)))
        self.length = np.concatenate((self.length, lengths))

    def learn_letters(self, words: list[str]) -> None:
        shown = [" ".join(words[k : k + 64]).lower().encode().decode("latin-1").translate(self.letters) for k in range(0, len(words), 64)]
        got = self.model.encode_batch_fast(shown, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(g.ids for g in got), np.uint32)
        self._keep(words, ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))

    def learn(self, words: list[str]) -> None:
        odd = {w for w in words if "<|" in w and any(s in w for s in self.special)}
        plain, mark = [w for w in words if w not in odd], self.library.id_to_token(self.mark)
        got = self.library.encode_batch_fast([mark.join([*plain[k : k + 64], ""]) for k in range(0, len(plain), 64)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(g.ids for g in got), np.uint32)
        self._keep([(True, w) for w in plain], ids[ids != self.mark], np.diff(np.flatnonzero(ids == self.mark), prepend=-1) - 1)
        for w in odd:
            each = np.asarray(self.library.encode(w, add_special_tokens=False).ids, np.uint32)
            self._keep([(True, w)], each, np.asarray([len(each)]))

    def numbers(self, words: pa.Array, letters: bool) -> np.ndarray:
        """The numbers of words in the table; those of letters are under their own names, all others under (True, word)."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        keys = names if letters else [(True, w) for w in names]
        fresh = [w for w, k in zip(names, keys, strict=True) if k not in self.known]
        if fresh:
            (self.learn_letters if letters else self.learn)(fresh)
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one entry more)."""
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        first = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if len(self.known) + len(words) > self.held:
            self.clear()
        parts = pc.extract_regex(words, self.PLAIN)
        plain = np.asarray(parts.is_valid())
        number = np.zeros((len(words), 2), np.int64)
        some = parts.filter(pa.array(plain))
        number[plain, 0] = self.numbers(pc.ascii_lower(some.field("core")), True)
        number[plain, 1] = self.numbers(some.field("tail"), False)
        number[~plain, 0] = self.numbers(words.filter(pa.array(~plain)), False)
        number[~plain, 1] = self.numbers(pa.array([""]), False)[0]
        size = self.length[number]
        index = coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(size.sum(1)[index])))
        each = number[index].ravel()
        return gather(self.flat, self.begin, self.length, each[self.length[each] > 0]), ends[first - first[0]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that what it has looked up serves later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _pieces(path: str, capacity: int):
    """(row, key, text) to pieces: whole windows of a document, then what is left over; whole windows are numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        window = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for b in batches:
            texts = pc.fill_null(b["text"].cast(pa.large_string()), "").cast(pa.string())
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (6 << 20), "right")))
                ids, ends = coder.encode(texts.slice(at, stop - at))
                who, out = [], []
                for k in range(stop - at):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.asarray([END], ids.dtype))
                    for start in range(0, len(own), capacity):
                        part = own[start : start + capacity].tobytes()
                        whole = len(own) - start >= capacity
                        who.append(at + k)
                        out.append((len(own), start, len(part) // own.itemsize, window if whole else None, zlib.crc32(part), part))
                        window += whole
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([b["row"].take(pa.array(who)), b["key"].take(pa.array(who)), *columns], ["row", "key", "doc_tokens", "start", "length", "window", "check", "ids"])
                at = stop
        trim()

    return run


def fill(counts: dict[int, int], alive: list[int], seed: int, capacity: int) -> tuple[dict[int, int], int]:
    """(copies of each length, what stays free) of the multiset with the seed that comes closest to the capacity.

    Bit b of `sums` says that lengths so far can add up to b; each length enters with 1, 2, 4, ... copies, as many as there
    are.  The sums before each length give the copies back, from the last length to the first.
    """
    gap = capacity - seed
    goal, sums, before = 1 << gap, 1, []
    for at in range(bisect_right(alive, gap) - 1, -1, -1):
        length = alive[at]
        most = min(counts[length] - (length == seed), gap // length)
        if most < 1:
            continue
        before.append((length, sums))
        copies = 1
        while most:
            copies = min(copies, most)
            sums |= sums << copies * length
            most -= copies
            copies *= 2
        sums &= (goal << 1) - 1
        if sums & goal:
            break
    best = sums.bit_length() - 1
    used, free = {seed: 1}, gap - best
    for length, reached in reversed(before):
        while not reached >> best & 1:
            used[length] = used.get(length, 0) + 1
            best -= length
    return used, free


def bin_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """(spans (length, first, last, base, per, offset), sequences, tokens left), from how many pieces there are of each length.

    The longest length seeds a window, and `fill` completes it.  A window without slack is repeated while there are
    pieces for it: ranks first .. last - 1 of a length go `per` to a sequence, from sequence `base` on, at `offset`.  A
    longest length that nothing completes stays out with all its pieces: of these, per is 0 and base is a place
    in the stream of what is left, which is to be cut at the borders of windows.  A step uses up a length or puts it
    aside, so there are at most as many as lengths, whatever the number of pieces.
    """
    left, alive = dict(counts), sorted(counts)
    used, spans, sequences, stream = dict.fromkeys(counts, 0), [], 0, []
    while alive:
        seed = alive[-1]
        copies, free = fill(left, alive, seed, capacity)
        if free:
            stream.append(seed)
            alive.pop()
            continue
        times = min(left[length] // n for length, n in copies.items())
        offset = 0
        for length, n in sorted(copies.items(), reverse=True):
            spans.append((length, used[length], used[length] + times * n, sequences, n, offset))
            used[length] += times * n
            left[length] -= times * n
            offset += n * length
            if not left[length]:
                alive.remove(length)
        sequences += times
    at = 0
    for length in stream:
        spans.append((length, used[length], used[length] + left[length], at, 0, 0))
        at += left[length] * length
    return spans, sequences, at


def tail_cuts(sequences: int, tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(lo, hi, sequence) of the stream's last stretch that fills no window: powers of two, the largest first."""
    whole = tokens // capacity
    lo, out, number = whole * capacity, [], sequences + whole
    while lo < tokens:
        size = 1 << (tokens - lo).bit_length() - 1
        out.append((lo, lo + size, number))
        lo, number = lo + size, number + 1
    return out


def _places(spans: Column, sequences: int, tokens: int, capacity: int) -> Column:
    """An array of (part, length, sequence, offset) for a piece's rank and length, from its length's spans."""
    span = F.filter(spans, lambda s: s["last"] > F.col("rank"))[0]
    turn = F.col("rank") - span["first"]
    placed = F.struct(
        F.lit(0).alias("part"), F.col("length").alias("length"), (span["base"] + F.floor(turn / span["per"])).alias("sequence"), (span["offset"] + turn % span["per"] * F.col("length")).cast("int").alias("offset")
    )
    lo = span["base"] + turn * F.col("length")
    hi = lo + F.col("length")
    whole = tokens // capacity
    windows = F.transform(F.sequence(F.floor(lo / capacity), F.floor((hi - 1) / capacity)), lambda w: F.struct((w * capacity).alias("lo"), ((w + 1) * capacity).alias("hi"), (w + sequences).alias("sequence")))
    tail = F.array(*(F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi"), F.lit(s).cast("long").alias("sequence")) for a, b, s in tail_cuts(sequences, tokens, capacity)))
    cuts = F.filter(windows, lambda w: w["lo"] < whole * capacity)
    if tokens % capacity:
        cuts = F.concat(cuts, F.filter(tail, lambda c: (c["lo"] < hi) & (c["hi"] > lo)))
    at = lambda c: F.greatest(c["lo"], lo)
    cut = F.transform(
        cuts, lambda c: F.struct((at(c) - lo).cast("int").alias("part"), (F.least(c["hi"], hi) - at(c)).cast("int").alias("length"), c["sequence"].alias("sequence"), (at(c) - c["lo"]).cast("int").alias("offset"))
    )
    return F.when(span["per"] > 0, F.array(placed)).otherwise(cut)


def _assembled(kind: str, capacity: int):
    """(sequence_id, pieces with ids) to sequences: one run of ids, padded, and the pieces without theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b["pieces"]
            flat, first = pieces.flatten(), pieces.offsets.to_numpy()
            first = first - first[0]
            parts = flat.field("ids").to_pylist()
            tokens, padded, joined = [], [], []
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                ids = np.frombuffer(b"".join(parts[lo:hi]), kind).astype("<u4")
                size = len(ids) if len(ids) & (len(ids) - 1) == 0 else capacity
                tokens.append(len(ids))
                padded.append(size)
                joined.append(np.concatenate((ids, np.full(size - len(ids), END, "<u4"))).tobytes())
            names = ["doc", "doc_tokens", "start", "length", "offset"]
            own = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([flat.field(n) for n in names], names))
            yield pa.RecordBatch.from_arrays([b["sequence_id"], pa.array(tokens, pa.int32()), pa.array(padded, pa.int32()), pa.array(joined, pa.binary()), own], ["sequence_id", "tokens", "size", "ids", "pieces"])

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Sequences (sequence_id, tokens, size, ids, pieces) of all documents: ids as little-endian unsigned 32-bit integers, padded to size.

    pieces has (doc, doc_tokens, start, length, offset) in the order of their offsets: which tokens of which document
    stand where.  A document is its ids and END.  Each whole window of a document is a sequence by itself; what is left
    over, shorter than a window, is packed by `bin_plan`: windows that pieces fill exactly, then a stream of the pieces that don't fit, cut at
    the borders of windows, whose end is cut into powers of two.  So size is tokens for every sequence, and a piece is cut
    once at most (at the stream's end, a few more times).  Where pieces of one length could swap places, a hash of key and
    ids decides, and equal rows may swap.  A null text is an empty one, a document of END alone; null keys and repeated rows
    are ordinary rows; other columns are not read.  No rows: no sequences.

    Ids are written once, pieces are counted by length (capacity - 1 numbers for the driver, however many rows), ranked
    within their length in buckets, and meet their place by row; a sequence has its own few pieces.
    """
    from tokenizers import Tokenizer

    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    made = rows.mapInArrow(_pieces(tokenizer, capacity), f"row long, key {kind}, doc_tokens long, start long, length int, window long, check long, ids binary")
    path = scratch(spark, "pieces")
    made.write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(made.schema).parquet(path)
    left = pieces.filter("window IS NULL")
    counts = {r["length"]: r["count"] for r in left.groupBy("length").count().collect()}
    spans, sequences, tokens = bin_plan(counts, capacity)
    plan = spark.createDataFrame(spans, "length int, first long, last long, base long, per long, offset int")
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("last", "first", "base", "per", "offset"))).alias("spans"))  # capacity - 1 rows at most
    ranked = numbered(left.select("row", "length", "key", "check"), ["length"], ["key", "check"], "rank", ["row"], rows=max(1, sum(counts.values())))
    placed = ranked.join(small(plan), "length").select("row", F.inline(_places(F.col("spans"), sequences, tokens, capacity)))
    placed = placed.withColumnRenamed("length", "size")
    wide = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    piece = lambda start, length, offset, ids: F.struct(offset.alias("offset"), F.col("key").alias("doc"), "doc_tokens", start.alias("start"), length.alias("length"), ids.alias("ids"))
    cut = F.expr(f"substring(ids, part * {wide} + 1, size * {wide})")
    packed = left.join(placed, "row").select(F.col("sequence").alias("sequence_id"), piece(F.col("start") + F.col("part"), F.col("size"), F.col("offset"), cut).alias("piece"))
    packed = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list("piece"), lambda a, b: a["offset"] - b["offset"]).alias("pieces"))
    above = sequences + tokens // capacity + len(tail_cuts(sequences, tokens, capacity))
    whole = pieces.filter("window IS NOT NULL").select((F.col("window") + above).alias("sequence_id"), F.array(piece(F.col("start"), F.col("length"), F.lit(0), F.col("ids"))).alias("pieces"))
    out = f"sequence_id long, tokens int, size int, ids binary, pieces array<struct<doc:{kind},doc_tokens:long,start:long,length:int,offset:int>>"
    return packed.unionByName(whole).mapInArrow(_assembled(f"<u{wide}", capacity), out)


def op13_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sequences = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    each = sequences.select("sequence_id", "ids", F.inline("pieces"))
    return each.select(
        F.col("doc").alias("doc_id"), "start", F.col("length").cast("long").alias("length"), F.crc32(F.expr("substring(ids, offset * 4 + 1, length * 4)")).alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset")
    )


QUERIES = {"op13_bin_slack_packing": op13_bin_slack_packing}
ORACLE: dict[str, str] = {}
