"""URL filters: rules, then naive Bayes over the words of segmented host names and paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_salt, looked_up, salt, salts_seen, stored, table

#: Fixed rules: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host + path) and its verdict; nulls where none fits."""
    name, verdict, *_ = ruled(host, path, rules)
    return name, verdict


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column, Column, Column]:
    """As rule_of, and what the rule leaves of host and path; all of both where none fits."""
    name, verdict, host_rest, path_rest = F.lit(None).cast("string"), F.lit(None).cast("string"), host, path
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
        host_rest = F.when(fits, F.substring(host, F.lit(1), F.length(host) - len(h))).otherwise(host_rest)
        path_rest = F.when(fits, F.substring(path, F.lit(len(p) + 1), F.length(path))).otherwise(path_rest)
    return name, verdict, host_rest, path_rest


#: Letters of a dictionary word up to which it is met by joining substrings; a longer one is met by its first ones, and then compared.
JOINED = 64
#: Costs of a split are whole numbers of a millionth of a nat, so that equal ones are equal.
UNIT = 1_000_000
#: What each further letter of an unknown word costs, in nats.
LETTER = 2.3


def split_name(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The cheapest split of a name into words, by unigram counts (Viterbi); of equal ones, that with the longest last word, and so on.

    A known word costs the log of total / its count, an unknown one log(10 total), and LETTER for each letter after its first.
    """
    cost = {w: round(UNIT * math.log(total / n)) for w, n in counts.items()}
    lengths = sorted({len(w) for w in cost})
    unknown, letter = round(UNIT * math.log(10 * total)), round(UNIT * LETTER)
    best, back = [0], [0]
    run = (0, 0)  # the cheapest unknown word that ends here: cost, start
    for j in range(1, len(name) + 1):
        begun = (best[j - 1] + unknown, j - 1)
        run = min((run[0] + letter, run[1]), begun) if j > 1 else begun
        found = run
        for n in lengths:
            if n > j:
                break
            if (w := name[j - n : j]) in cost:
                found = min(found, (best[j - n] + cost[w], j - n))
        best.append(found[0])
        back.append(found[1])
    words, j = [], len(name)
    while j:
        words.append(name[back[j] : j])
        j = back[j]
    return words[::-1]


def _segment(total: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known = ({w["sub"]: w["n"] for w in (found if found is not None else ())} for found in f["found"])
            yield pd.DataFrame({"name": f["name"], "words": [split_name(n, k, total) for n, k in zip(f["name"], known, strict=True)]})

    return run


def unigrams(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): how often each word of two or more letters, of any script and case aside, occurs in all rows."""
    words = texts.select(F.explode(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}]+")).alias("word")).filter("length(word) > 1")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) of each of names (name, distinct): its split by the counts of words (word, n), however many words there are.

    The substrings of all names meet the words, so a name is split with just those words that occur in it; the dictionary
    never goes through the driver or into one task.  A substring that many names have is dealt out by salts.
    """
    total = (words.agg(F.sum("n")).first()[0] or 0) + 1
    names = stored(names.withColumn("id", F.monotonically_increasing_id()), "names")
    at = names.filter("length(name) > 1").select("id", "name", F.explode(F.expr("sequence(1, length(name) - 1)")).alias("i"))
    subs = at.select("id", "i", F.explode(F.expr(f"transform(sequence(2, least({JOINED}, length(name) - i + 1)), n -> substring(name, i, n))")).alias("sub"))
    short = words.filter(F.length("word") <= JOINED).select(F.col("word").alias("sub"), "n")
    found = looked_up(subs.select("id", "sub").distinct().withColumn("salt", salt("id")), "sub", short).select("id", "sub", "n")
    far = words.filter(F.length("word") > JOINED).select(F.substring("word", 1, JOINED).alias("sub"), "word", "n")
    first = subs.filter(F.length("sub") == JOINED).join(far, "sub").join(names, "id").filter("substring(name, i, length(word)) = word")
    found = found.unionByName(first.select("id", F.col("word").alias("sub"), "n").distinct())
    known = found.groupBy("id").agg(F.collect_list(F.struct("sub", "n")).alias("found"))  # substrings of one name
    return names.join(known, "id", "left").select("name", "found").mapInPandas(_segment(total), "name string, words array<string>")


def judge_urls(pages: DataFrame, words: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and method of each row of pages (page_id, url; no other column is read); words (word, n) are the segmenter's.

    The longest rule that fits decides.  All urls that a rule decides train a multinomial naive Bayes (add-one) over host
    and path tokens, which decides the others: runs of letters, of any script and case aside, are split into words, each
    a token, and a run of digits is a token by its length; `block` if the log odds of block, `score`, are above 0.  What the
    deciding rule itself names of host and path trains nothing, so the classifier doesn't learn the rules over again.
    Token counts are aggregated over all rows and all tokens are the model, joined to the rows by shuffle.  A null url, or one without
    ://, has an empty host and path and so no tokens; its odds are those of the classes.  Names are segmented whole, however long.  With no rule decided either way
    the odds are 0 and the verdict is allow.  Repeated rows are judged alike.  No rows: an empty result.
    """
    host, path = host_and_path(F.col("url"))
    name, verdict, host_rest, path_rest = ruled(F.col("host"), F.col("path"), rules)
    split = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), host_rest.alias("host_rest"), path_rest.alias("path_rest"))
    rows = stored(split.withColumn("row", F.monotonically_increasing_id()), "urls")
    runs = lambda c, kind: F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\p{N}+"), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    parts = rows.select("row", "ruled", F.inline(F.concat(runs("host_rest", "h:"), runs("path_rest", "p:")))).withColumn("salt", salt("row"))
    digits = parts.filter(r"name RLIKE '^\\p{N}'").select("row", "ruled", F.concat("kind", F.lit("#"), F.length("name").cast("string")).alias("token"))
    letters = parts.filter(r"name NOT RLIKE '^\\p{N}'")
    split_names = stored(segmented(letters.select("name").distinct(), words), "segmented")
    spelt = looked_up(letters, "name", split_names).select("row", "ruled", "kind", F.explode("words").alias("word")).select("row", "ruled", F.concat("kind", "word").alias("token"))
    tokens = stored(spelt.unionByName(digits), "url-tokens")
    blocked = F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0))
    classes = rows.filter("ruled IS NOT NULL").agg(blocked.alias("block"), F.count(F.lit(1)).alias("n")).first()
    n_block, n_allow = (classes["block"] or 0), classes["n"] - (classes["block"] or 0)
    prior = math.log((n_block + 1) / (n_allow + 1))
    seen = tokens.filter("ruled IS NOT NULL").groupBy("token").agg(blocked.alias("block"), F.count(F.lit(1)).alias("n"))
    seen = stored(seen, "token-counts")
    sums = seen.agg(F.sum("block").alias("block"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("size")).first()
    all_block, size = sums["block"] or 0, sums["size"]
    all_allow = (sums["n"] or 0) - all_block
    odds = F.log((F.col("block") + 1) / F.lit(all_block + size + 1)) - F.log((F.col("n") - F.col("block") + 1) / F.lit(all_allow + size + 1))
    weights = seen.select("token", odds.alias("odds"))
    held = tokens.groupBy("row", "token").agg(F.count(F.lit(1)).alias("times")).withColumn("salt", salt("row"))
    needed = held.groupBy("token").agg(salts_seen().alias("salts")).join(weights, "token").select("token", "odds", each_salt().alias("salt"))
    each = held.join(needed, ["token", "salt"]).groupBy("row").agg(F.array_sort(F.collect_list(F.col("times") * F.col("odds"))).alias("parts"))
    total = each.select(F.col("row").alias("_row"), F.aggregate("parts", F.lit(prior), lambda s, x: s + x).alias("score"))  # sorted: one sum whatever the order of rows
    scored = rows.join(total, F.col("row") == F.col("_row"), "left").withColumn("score", F.coalesce("score", F.lit(prior)))
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        "score", F.when(F.col("ruled").isNull(), "bayes").otherwise("rule").alias("method"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = pages.select(F.regexp_replace("html", r"(?s)<[^>]*>", " ").alias("text"))
    return judge_urls(pages, unigrams(texts, "text")).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE: dict[str, str] = {}
