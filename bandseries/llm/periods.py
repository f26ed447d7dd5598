"""Periodic run detection: tiles of each period octave, solved apart by Z-functions at their boundaries, fragments stitched by text and period."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored, table
from .textnum import trim

#: Least length of a run, in words.
LEAST = 12
#: Words of a tile row, about; neighbouring boundaries share one.
TILE = 4096
#: Bytes of tiles that a task solves, about.
TASK = 1 << 20
#: Words that are searched for candidates at once (a longer text is searched by itself).
PIECE = 1 << 18


def reach(octave: int, least: int = LEAST) -> int:
    """How far a tile of periods octave .. 2 x octave - 1 looks to both sides of a boundary, which is also the way between boundaries.

    A run of period q has max(least - q, q) words or more that equal the word q further on.  This is the least of these
    numbers in the octave, so each run has a boundary among those words or at their end.
    """
    return min(max(least - q, q) for q in range(octave, 2 * octave))


def z_function(s: list) -> list[int]:
    """For each place, how many items from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def fragments(left: list, right: list, octave: int, width: int) -> list[tuple[int, int, int]]:
    """(period, before, after) at a boundary: stretches before .. after about it whose words equal those a period further on.

    right are the words from the boundary on, left those before it, as far as the tile has them.  Both
    sides end `width` words from the boundary.  Stretches shorter than `width` are left out, as are periods whose first
    words repeat a shorter period that divides them: there the shorter period reaches as far.
    """
    z = z_function(right)
    most = min(2 * octave, len(right) + 1)
    repeats = set()
    for d in range(1, most // 2 + 1):
        if d < len(z) and z[d] >= d:
            repeats.update(range(2 * d, min(z[d] + d, most - 1) + 1, d))
    # Backwards: the words before a boundary and a period on, from the end, against the words before the boundary.
    back = left[::-1]
    both = z_function([*back, None, *right[: most - 1][::-1], *back])
    at = len(back) + 1 + min(most - 1, len(right))  # where the words before the boundary start again
    out = []
    for q in range(octave, most):
        if q not in repeats:
            after = min(z[q], width) if q < len(z) else 0
            before = min(both[at - q], width)
            if before + after >= width:
                out.append((q, before, after))
    return out


def _levels(ids: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4, ... words from each place on, made as asked for; equal words have equal hashes, and they are only a filter."""
    return {1: ids.astype(np.uint32) * np.uint32(0x9E3779B1)}


def _level(levels: dict[int, np.ndarray], size: int) -> np.ndarray:
    if size not in levels:
        half, step = _level(levels, size // 2), size // 2
        whole = np.zeros(len(half), np.uint32)
        both = half[:-step] * np.uint32(0x85EBCA77)
        both += half[step:]
        both ^= both >> np.uint32(15)
        both *= np.uint32(0xC2B2AE3D)
        both ^= both >> np.uint32(13)
        whole[:-step] = both
        levels[size] = whole
        for old in [k for k in levels if 1 < k < size // 2]:
            del levels[old]
    return levels[size]


def active(ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, octave, width, boundaries) of the octaves in which a text may have runs; ids of all texts, and their first words.

    A stretch of `width` words about a boundary has half of them on one side, so the largest power of two
    of words there hashes alike a period further on.  Only this is looked for here, by comparing each boundary's hash with those of the octave's periods.
    """
    levels, n = _levels(ids), np.diff(first)
    octave = 1
    while True:
        texts = np.flatnonzero(n >= max(LEAST, 2 * octave))
        if not len(texts):
            return
        width = reach(octave)
        size = 1 << ((width + 1) // 2).bit_length() - 1
        level = _level(levels, size)
        per = (n[texts] - 1) // width + 1
        owner = np.repeat(texts, per)
        offset = (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * width
        rows = max(1, PIECE // octave)
        for lo in range(0, len(owner), rows):
            who, off = owner[lo : lo + rows], offset[lo : lo + rows]
            at, stop = first[who] + off, first[who + 1]
            hit = np.zeros(len(who), bool)
            for shift in (0, -size):
                here = at + shift
                there = np.minimum(here[:, None] + np.arange(octave, 2 * octave), len(level) - 1)
                same = level[there] == level[np.clip(here, 0, len(level) - 1)][:, None]
                same &= (there + size <= stop[:, None]) & (here >= first[who])[:, None]
                hit |= same.any(1)
            who, off = who[hit], off[hit]
            for some in np.split(np.arange(len(who)), np.flatnonzero(np.diff(who)) + 1):
                if len(some):
                    yield int(who[some[0]]), octave, width, off[some]
        octave *= 2


_TILE = pa.struct([("octave", pa.int64()), ("first", pa.int64()), ("at", pa.list_(pa.int32())), ("ids", pa.binary())])


def tiles(ids: np.ndarray, octave: int, width: int, boundaries: np.ndarray) -> Iterator[dict]:
    """Tiles of a text: neighbouring boundaries with the words that they look at, which overlap those of the next tile."""
    start = 0
    while start < len(boundaries):
        stop = int(np.searchsorted(boundaries, boundaries[start] + max(TILE, octave)))
        gaps = np.flatnonzero(np.diff(boundaries[start:stop]) > width + 2 * octave)
        stop = start + int(gaps[0]) + 1 if len(gaps) else stop
        first = max(0, int(boundaries[start]) - width)
        last = min(len(ids), int(boundaries[stop - 1]) + 2 * octave + width)
        yield {"octave": octave, "first": first, "at": (boundaries[start:stop] - first).tolist(), "ids": ids[first:last].astype("<i4").tobytes()}
        start = stop


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of all words (equal words, equal numbers), each text's first one, and the texts with one space between words."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    first = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    none = np.flatnonzero(np.asarray(pc.equal(pc.binary_length(flat), 0)))  # of texts without words
    ids = flat.dictionary_encode().indices.to_numpy()
    joined = pc.binary_join(lists, " ")
    first = first - first[0]
    if len(none):
        first = first - np.searchsorted(none, first)
        ids = np.delete(ids, none)
    return ids, first, joined


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key, text) to row, key, words and the tiles of its octaves; words are the text with one space between its words."""
    for b in batches:
        texts = pc.fill_null(b["text"].cast(pa.large_string()), "").cast(pa.string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (2 << 20), "right")))
            ids, first, joined = _words(texts.slice(at, stop - at))
            found: list[list] = [[] for _ in range(stop - at)]
            for text, octave, width, boundaries in active(ids, first):
                found[text] += tiles(ids[first[text] : first[text + 1]], octave, width, boundaries)
            yield pa.RecordBatch.from_arrays([b["row"].slice(at, stop - at), b["key"].slice(at, stop - at), joined, pa.array(found, pa.list_(_TILE))], ["row", "key", "words", "tiles"])
            at = stop
    trim()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles to the fragments (row, period, lo, hi) at their boundaries, those of one tile put together."""
    for b in batches:
        out: list[tuple[int, int, int, int]] = []
        for row, octave, first, at, raw in zip(*(b[c].to_pylist() for c in ("row", "octave", "first", "at", "ids")), strict=True):
            ids, width, held = np.frombuffer(raw, "<i4").tolist(), reach(octave), {}
            for c in at:
                for q, before, after in fragments(ids[max(0, c - width) : c], ids[c : c + 2 * octave - 1 + width], octave, width):
                    lo, hi = first + c - before, first + c + after
                    spans = held.setdefault(q, [])
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(hi, spans[-1][1])
                    else:
                        spans.append([lo, hi])
            out += [(row, q, lo, hi) for q, spans in held.items() for lo, hi in spans]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "period", "lo", "hi"])


def stitched(pieces: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, start, length, period) of the runs, from fragments (row, period, lo, hi): those that touch are one stretch.

    A stretch has its period as its smallest one unless a shorter period has the very same stretch.
    """
    by = Window.partitionBy("row", "period").orderBy("lo", "hi")
    new = F.coalesce(F.col("lo") > F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    part = pieces.withColumn("new", new).withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = part.groupBy("row", "period", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("end"))
    length = (F.col("end") - F.col("start") + F.col("period")).alias("length")
    whole = whole.select("row", "period", "start", length).filter((F.col("length") >= least) & (F.col("length") >= 2 * F.col("period")))
    return whole.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words, runs) to key, runs, and words without those that a run has after its first period."""
    for b in batches:
        kept = []
        for words, runs in zip(b["words"].to_pylist(), b["runs"].to_pylist(), strict=True):
            each = words.split(" ")
            keep = np.ones(len(each), bool)
            for r in runs:
                keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
            kept.append(" ".join(compress(each, keep)))
        yield pa.RecordBatch.from_arrays([b["key"], b["runs"], pa.array(kept, pa.string())], ["key", "runs", "collapsed"])
    trim()


RUNS = "array<struct<start:long,length:long,period:long>>"
TILES = "array<struct<octave:long,first:long,at:array<int>,ids:binary>>"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed) of every row of docs: the runs of its words, and its words without what they repeat.

    Words are runs of anything but ASCII white space.  A run is a stretch of words with smallest period q, of LEAST
    words and two periods at least, that no neighbouring word extends; runs are ordered by start and period.  collapsed has one
    space between words and leaves out each word that stands in a run after that run's first period.  A null text is
    an empty one, without runs.  Null keys and repeated rows are ordinary rows, each with its own result; other columns
    are not read.  No rows: an empty result.

    Periods are taken by octaves.  An octave has boundaries a reach apart, and each run of one of its periods has one of
    them where its words repeat.  A text's task only looks for boundaries at which a hash shows that something may
    repeat; their tiles are rows of their own, dealt out over all tasks, and solved by the Z-functions of the words
    after and before the boundary, which compare words and no hashes.  What tiles see of a run is put together by row and
    period.  So a long text is many tiles, and a text in which nothing may repeat is not shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    found = stored(rows.mapInArrow(_find, f"row long, key {kind}, words string, tiles {TILES}"), "tiles")
    some = found.filter(F.size("tiles") > 0)
    each = some.select("row", F.inline("tiles"))
    size = each.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    each = each.repartition(-(-size // TASK) or 1, "row", "octave", "first")  # by their bytes: a few of them are long work
    runs = stitched(each.mapInArrow(_solve, "row long, period long, lo long, hi long"))
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.array().cast(RUNS)
    named = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    rest = some.select("row", "key", "words").join(runs.select("row", named.alias("runs")), "row", "left").select("key", "words", F.coalesce("runs", none).alias("runs"))
    rest = rest.mapInArrow(_collapse, f"key {kind}, runs {RUNS}, collapsed string")
    plain = found.filter(F.size("tiles") == 0).select("key", none.alias("runs"), F.col("words").alias("collapsed"))
    return plain.unionByName(rest).withColumnRenamed("key", key)


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which, for a tenth of the doc_ids, all words from one on repeat with a period; both follow from the crc32 of doc_id."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, h = F.size(words), F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)).cast("long")).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE: dict[str, str] = {}
