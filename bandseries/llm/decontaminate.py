"""Benchmark decontamination by a distributed positional inverted index; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored, table, without

WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The text's words in order: A-Z lower-cased, runs of digits, letters and anything beyond ASCII; null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id and hash identify a text of a document; repeated rows share them."""
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), terms(F.col("text")).alias("words"))


def term_counts(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n): how often each term of the vocabulary occurs in all rows."""
    each = rows.select(F.explode("words").alias("term"))
    if vocabulary.limit(200_001).count() > 200_000:  # too large to broadcast: count every term first, then keep those asked for
        return each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "term", "left_semi")
    return each.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def build_index(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored index (term, doc_id, hash, position): all postings of the wanted terms.

    One row more for each document, with a null term, holds its number of words as position.
    """
    words = F.concat(F.transform("words", lambda w: F.struct(w.alias("term"))), F.array(F.struct(F.lit(None).cast("string").alias("term"))))
    each = rows.select("doc_id", "hash", F.posexplode(words).alias("position", "t")).select("doc_id", "hash", "position", "t.term")
    if wanted.limit(200_001).count() <= 200_000:
        hits = each.join(F.broadcast(wanted.withColumnRenamed("term", "_term")), F.col("term") == F.col("_term"), "left")
        hits = hits.filter(F.col("_term").isNotNull() | F.col("term").isNull()).drop("_term")
    else:  # deal the terms out anew by document, so that a common term doesn't land in one task
        salted = each.withColumn("_salt", F.pmod(F.col("hash"), F.lit(64)))
        many = wanted.select(F.col("term").alias("_term"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("_s"))
        hits = salted.join(many, (F.col("term") == F.col("_term")) & (F.col("_salt") == F.col("_s")), "left_semi").drop("_salt")
        hits = hits.unionByName(each.filter("term IS NULL"))
    return stored(hits, "index")


def phrases_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, phrase, terms): every run of `size` words of each item's text; a shorter text is one phrase."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), terms(F.col("text")).alias("w")).filter("size(w) > 0")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))), lambda i: F.slice("w", i, size))
    out = words.select("item", F.explode(runs).alias("terms")).distinct()
    return out.withColumn("phrase", F.md5(F.array_join("terms", " ")))


def find_phrases(docs: DataFrame, phrases: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Exact matches (doc_id, hash, phrase, start, length) of phrases (phrase, terms), and (doc_id, hash, n_words) per row.

    Phrases with a term that no document has are out at once.  Of each other phrase, the lists of its two rarest terms are
    taken from the index; shifted by the terms' offsets, they must meet in one start.  The index has no lists of terms that are
    in no phrase among the two rarest: these would be the longest, and what meets is held against the document's words, which
    decides on all terms at once.  With slop > 0 the two rarest terms may be up to `slop` words off their distance, and a match is
    a stretch in which all terms occur in order with at most `slop` words between in all (proximity).
    """
    rows = document_rows(docs)
    phrases = phrases.select("phrase", "terms").dropDuplicates(["phrase"])
    each = phrases.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    counts = stored(term_counts(rows, stored(each.select("term").distinct(), "vocabulary")), "counts")
    known = each.join(small(counts), "term", "left")
    by_rarity = Window.partitionBy("phrase").orderBy(F.col("n").asc_nulls_first(), "term", "offset")
    rarest = known.withColumn("rank", F.row_number().over(by_rarity)).withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("phrase")))
    anchors = stored(rarest.filter("least > 0 AND rank <= 2").select("phrase", "length", "term", "offset"), "anchors")
    index = build_index(rows, anchors.select("term").distinct())

    shifted = index.filter("term IS NOT NULL").join(small(anchors), "term")
    shifted = shifted.select("doc_id", "hash", "phrase", "length", "offset", (F.col("position") - F.col("offset")).alias("start"))
    if slop:
        apart = F.col("x.start") - F.col("y.start")
        x, y = shifted.withColumn("lo", F.min("offset").over(Window.partitionBy("phrase"))), shifted
        pairs = x.alias("x").join(y.alias("y"), F.expr("x.doc_id <=> y.doc_id AND x.hash = y.hash AND x.phrase = y.phrase AND x.offset <= y.offset") & (F.abs(apart) <= slop))
        met = pairs.filter("x.length = 1 OR x.offset < y.offset").select("x.doc_id", "x.hash", "x.phrase", "x.length", F.explode(F.sequence(F.greatest(F.col("x.start") - slop, F.lit(0)), F.col("x.start"))).alias("start")).distinct()
    else:
        met = shifted.filter("start >= 0").groupBy("doc_id", "hash", "phrase", "length", "start").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("offset").alias("k"))
        met = met.filter(F.col("k") == F.least("length", F.lit(2))).drop("n", "k")
    met = stored(met, "candidates")

    found = met.select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash")).distinct()
    here = rows.join(small(found), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash")), "left_semi").dropDuplicates(["doc_id", "hash"])
    tries = met.withColumnsRenamed({"doc_id": "_doc", "hash": "_hash"}).join(small(phrases), "phrase")
    tries = tries.groupBy("_doc", "_hash").agg(F.collect_list(F.struct("phrase", "start", "length", "terms")).alias("tries"))  # so a text's words are there once
    tried = here.join(tries, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash")))
    if slop:
        tried = tried.select("doc_id", "hash", "words", F.inline("tries"))
        span = F.slice("words", F.col("start") + 1, F.col("length") + slop)
        # Walk through the span: at each word, go on to the next term if it is the one awaited.
        walked = F.aggregate(span, F.struct(F.lit(0).alias("at"), F.lit(0).alias("seen")), lambda s, w: F.struct(
            F.when(F.get("terms", s["at"]) == w, s["at"] + 1).otherwise(s["at"]).alias("at"),
            F.when(s["at"] < F.size("terms"), s["seen"] + 1).otherwise(s["seen"]).alias("seen"),
        ))
        tried = tried.withColumn("walk", walked).filter((F.col("walk.at") == F.col("length")) & (F.get("words", F.col("start")) == F.get("terms", F.lit(0))))
        matches = tried.select("doc_id", "hash", "phrase", "start", F.col("walk.seen").alias("length"))
    else:
        exact = F.filter("tries", lambda t: F.slice("words", t["start"] + 1, t["length"]) == t["terms"])
        matches = tried.select("doc_id", "hash", F.inline(exact)).drop("terms")
    return stored(matches, "matches"), index.filter("term IS NULL").select("doc_id", "hash", F.col("position").cast("long").alias("n_words"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, hash, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs (doc_id, text).

    Items are rows of (item_id, text).  A document word inside an exact occurrence of any of an item's `size`-word
    phrases is hit; a document is contaminated if at least a twentieth of its words are.  A null text has no words and
    is never contaminated; a null item_id is written `null`; rows of one item_id count as one item; repeated documents
    are judged alike.  Columns other than these are not read.  No documents or no items: no hits.
    """
    phrases = stored(phrases_of(items, size), "phrases")
    matches, lengths = find_phrases(docs, phrases)
    key = ["doc_id", "hash"]
    before = Window.partitionBy(*key).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    hit = matches.select(*key, "start", "length").distinct().withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").cast("long").alias("n_hit"))
    which = matches.select(*key, "phrase").distinct().join(small(phrases.select("phrase", "item")), "phrase").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = hit.withColumnsRenamed({"doc_id": "_doc", "hash": "_hash"})
    named = which.withColumnsRenamed({"doc_id": "_doc2", "hash": "_hash2"})
    marks = marks.join(named, F.col("_doc").eqNullSafe(F.col("_doc2")) & (F.col("_hash") == F.col("_hash2")))
    out = lengths.join(small(stored(marks.select("_doc", "_hash", "n_hit", "items"), "hits")), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash")), "left")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", none)
    return out.select(
        *key, "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs; rows of equal doc_id and text share their verdict, null texts stay."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    found = stored(found.select(F.col("doc_id").alias("_bad"), F.col("hash").alias("_hash")).distinct(), "contaminated")
    return without(docs, [F.col("doc_id"), F.xxhash64("text")], found)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hash")


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE = {
    "op7_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents),
        b AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark),
        p AS (
            SELECT DISTINCT item_id, list_aggregate(w[i:i + least(len(w), 13) - 1], 'string_agg', ' ') AS phrase, least(len(w), 13) AS n
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        s AS (SELECT DISTINCT n FROM p),
        g AS (
            SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS phrase
            FROM (SELECT doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, s WHERE len(w) >= s.n)),
        m AS (SELECT doc_id, g.n, i, item_id FROM g JOIN p USING (phrase, n)),
        h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """
}
