"""Quality rules: counts over whole texts, and robust multivariate outliers by minimum covariance determinants."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, chi2_quantile, met, small, stored, table, without
from .textnum import SPACE, Hasher, U, alike, blocks, mix, shingles, trim, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
#: Bytes that add no letter to a word: white space, and all bytes of a code point but the first.
NOT_INK = SPACE.copy()
NOT_INK[0x80:0xC0] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

#: The transformed statistics, and the spread that each has at least: differences below it are no sign of bad text.
FLOORS = {"log_words": 1.0, "log_word_chars": 0.15, "log_symbols": 0.4, "dup_lines": 0.15, "repeat_words": 0.05, "log_upper": 0.5}
DIMS = len(FLOORS)


def _again(key: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether it occurs twice or more; whether it occurred before.

    Items are brought together by their keys; exact(a, b) says whether items a[k] and b[k], which have one key, are equal.
    """
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    met = np.flatnonzero(same)
    if not exact(order[met - 1], order[met]).all():  # different items with one key: all of these are compared
        for items in np.split(order, np.flatnonzero(~same[1:-1]) + 1):
            left = items
            while len(left) > 1:
                equal = exact(np.full(len(left), left[0]), left)
                twice[left[equal]] = equal.sum() > 1
                later[left[equal][1:]] = True
                left = left[~equal]
        return twice, later
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of a column; null is an empty text."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for block in blocks(column):
        data, at, n = block.data, block.at, block.last - block.first
        count = lambda hit: np.diff(np.searchsorted(np.flatnonzero(hit), at))  # noqa: B023, E731
        start, end, first = words(block)
        parts["n_words"].append(np.diff(first))
        parts["word_chars"].append(np.diff(at) - count(NOT_INK[data]))
        parts["n_symbols"].append(count(SYMBOLS[data]))
        parts["n_upper"].append(count(UPPER[data]))

        hashed = Hasher(data)
        breaks = np.flatnonzero(data == 10)
        text_of = np.searchsorted(at, breaks, "right") - 1
        lo = np.concatenate((at[:-1], breaks + 1))
        hi = np.concatenate((breaks, at[1:]))
        of = np.concatenate((np.arange(n), text_of))
        lo.sort()
        hi.sort()
        of.sort()
        inked = np.searchsorted(start, hi) > np.searchsorted(start, lo)  # words never span lines
        lo, hi, of = lo[inked], hi[inked], of[inked]
        line = lambda k: (data, lo[k], hi[k] - lo[k])  # noqa: B023, E731
        _, later = _again(hashed(lo, hi) ^ mix(of.astype(U) + U(1)), lambda a, b: (of[a] == of[b]) & alike(line(a), line(b)))  # noqa: B023
        parts["n_lines"].append(np.bincount(of, minlength=n))
        parts["n_dup_lines"].append(np.bincount(of[later], minlength=n))

        per = np.diff(first)
        whole = per >= 5
        word = hashed(start, end)
        runs, begin = shingles(word, first)
        of = np.repeat(np.arange(n), np.diff(begin))
        at_word = np.arange(len(runs)) - np.repeat(begin[:-1], np.diff(begin)) + np.repeat(first[:-1], np.diff(begin))

        def windows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Whether windows that stand for 5 words are equal, word by word."""
            out = (of[a] == of[b]) & whole[of[a]] & whole[of[b]]  # noqa: B023
            some = np.flatnonzero(out)
            x, y = (at_word[k[some]][:, None] + np.arange(5) for k in (a, b))  # noqa: B023
            same = word[x] == word[y]  # noqa: B023
            long = same & (end[x] - start[x] > 7)  # noqa: B023
            x, y = x[long], y[long]
            same[long] = alike((data, start[x], end[x] - start[x]), (data, start[y], end[y] - start[y]))  # noqa: B023
            out[some] = same.all(1)
            return out

        twice, _ = _again(runs ^ mix(of.astype(U) + U(1)), windows)
        hit = at_word[twice & whole[of]]
        depth = np.zeros(len(start) + 6, np.int64)
        depth += np.bincount(hit, minlength=len(depth)) - np.bincount(hit + 5, minlength=len(depth))
        covered = np.cumsum(depth)[: len(start)] > 0
        parts["n_repeat_words"].append(np.diff(np.concatenate(([0], np.cumsum(covered)))[first]))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            part = b.slice(i, 2000)
            out = {n: part[n] for n in part.schema.names if n != "text"} | {k: pa.array(v) for k, v in text_counts(part["text"]).items()}
            yield pa.RecordBatch.from_pydict(out)
    trim()


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, key (a hash of the row), COUNTS and base_failed of each row, whole texts."""
    keyed = docs.select("doc_id", "lang", "source", F.xxhash64("text", "lang", "source").alias("key"), "text")
    counted = keyed.mapInArrow(_count, "doc_id long, lang string, source string, key long, " + ", ".join(f"{k} long" for k in COUNTS))
    return counted.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _vector() -> list[Column]:
    """The statistics, transformed so that good text spreads roughly evenly about its centre."""
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("n_words")), F.log(chars / n), F.log1p(100 * F.col("n_symbols") / chars),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / n, F.log1p(100 * F.col("n_upper") / chars),
    ]


PARAMS = "level string, n long, mean array<double>, inverse array<double>, logdet double"
#: Rows that a level borrows from the level above it (a source from its language, a language from all), whatever its size.
BORROWED = 24


def _invert(scale: float):
    """Rows (level, n, sums, products) to PARAMS: means, and the inverse of the covariance times `scale`, floors added."""
    floor = np.diag([v * v for v in FLOORS.values()])
    upper = np.triu_indices(DIMS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for level, n, s, p in zip(f["level"], f["n"], f["sums"], f["products"], strict=True):
                mean = np.asarray(s) / n
                cov = np.zeros((DIMS, DIMS))
                cov[upper] = np.asarray(p) / n
                cov = (cov + np.triu(cov, 1).T - np.outer(mean, mean)) * scale + floor
                out.append((level, int(n), mean, np.linalg.inv(cov).ravel(), np.linalg.slogdet(cov)[1]))
            yield pd.DataFrame(out, columns=["level", "n", "mean", "inverse", "logdet"])

    return run


def _moments(rows: DataFrame, parents: DataFrame, scale: float, name: str) -> DataFrame:
    """PARAMS of each level, from rows (level, x0..): one pass of plain sums, combined before the shuffle.

    Each level's sums take in BORROWED rows' worth of its parent's: a level of a few rows is judged much as its parent is,
    a level of many by itself, and there is no size at which one turns into the other.
    """
    x = [f"x{i}" for i in range(DIMS)]
    sums = [F.sum(k) for k in x]
    products = [F.sum(F.col(x[i]) * F.col(x[j])) for i in range(DIMS) for j in range(i, DIMS)]
    grouped = rows.groupBy("level").agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*sums).alias("sums"), F.array(*products).alias("products"))
    grouped = stored(parents.join(grouped, "level"), f"{name}-sums")
    done = grouped.filter("depth = 0").drop("parent", "depth")
    for depth in (1, 2):
        above = done.select(F.col("level").alias("parent"), F.col("n").alias("_n"), F.col("sums").alias("_s"), F.col("products").alias("_p"))
        own = grouped.filter(F.col("depth") == depth).join(small(above), "parent")
        more = lambda a, b: F.zip_with(a, b, lambda u, v: u + v * F.lit(float(BORROWED)) / F.col("_n")).alias(a)
        done = done.unionByName(own.select("level", (F.col("n") + BORROWED).alias("n"), more("sums", "_s"), more("products", "_p")))
    return stored(done.mapInPandas(_invert(scale), PARAMS), name)


def _d2() -> Column:
    """The squared Mahalanobis distance of x0.. from `mean`, by `inverse`."""
    d = [F.col(f"x{i}") - F.col("mean")[i] for i in range(DIMS)]
    return sum((d[i] * d[j] * F.col("inverse")[i * DIMS + j] * (1 if i == j else 2) for i in range(DIMS) for j in range(i, DIMS)), F.lit(0.0))


def _distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Adds d2, the squared distance from the level's estimate."""
    return met(rows, "level", params.select("level", "mean", "inverse"), most=20_000).withColumn("d2", _d2()).drop("mean", "inverse")


def fit_mcd(rows: DataFrame, parents: DataFrame, keep: float = 0.75, steps: int = 8) -> DataFrame:
    """Minimum-covariance-determinant estimates, as PARAMS, of each level of rows (level, salt, x0..x5); all rows take part.

    parents: (level, parent, depth) of each level, depth 0 for the one above all.  The start is each level's median and
    quartile range.  A concentration step keeps the `keep` share of a level's rows that are nearest by the last estimate and
    takes their mean and covariance (_moments); each is two aggregations whose partial results combine before the shuffle,
    so a level with a third of all rows is no harder than the rest.  Steps end when no level's determinant falls by
    1 % any more, or after `steps`; each level has the estimate of its least determinant.  A last step takes the rows
    within the 97.5 % distance.
    """
    x = [f"x{i}" for i in range(DIMS)]
    quartiles = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(k, [0.25, 0.5, 0.75], 1000).alias(k) for k in x))
    spread = [F.pow((F.col(k)[2] - F.col(k)[0]) / 1.349, 2) + v * v for k, v in zip(x, FLOORS.values(), strict=True)]
    start = quartiles.select(
        "level", "n", F.array(*(F.col(k)[1] for k in x)).alias("mean"),
        F.array(*(1 / spread[i] if i == j else F.lit(0.0) for i in range(DIMS) for j in range(DIMS))).alias("inverse"), F.lit(None).cast("double").alias("logdet"),
    )
    params = stored(start, "mcd")
    inner = chi2_quantile(keep, DIMS)
    # A normal sample cut at its keep-quantile has its covariance shrunk by this factor, found by radial integration.
    r = np.linspace(0, inner, 20_001)[1:]
    density = r ** (DIMS / 2 - 1) * np.exp(-r / 2)
    shrunk = float((density * r).sum() / density.sum() / DIMS)
    for step in range(steps):
        far = _distance(rows, params)
        cut = stored(far.groupBy("level").agg(F.percentile_approx("d2", keep, 2000).alias("cut")), "mcd-cut")
        near = met(far, "level", cut, most=20_000).filter("d2 <= cut")
        new = _moments(near, parents, 1 / shrunk, f"mcd-{step}")
        both = new.join(small(params.select("level", *(F.col(c).alias(f"_{c}") for c in ("mean", "inverse", "logdet")))), "level")
        falls = F.col("_logdet").isNull() | (F.col("logdet") < F.col("_logdet"))
        best = both.select("level", "n", *(F.when(falls, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("mean", "inverse", "logdet")), (F.col("_logdet").isNull() | (F.col("logdet") < F.col("_logdet") - 0.01)).alias("moved"))
        best = stored(best, f"mcd-best-{step}")
        params = best.drop("moved")
        if not best.filter("moved").limit(1).count():
            break
    return _moments(_distance(rows, params).filter(F.col("d2") <= chi2_quantile(0.975, DIMS)), parents, 1.0, "mcd-last")


def levels() -> list[Column]:
    """The levels of a row: all, its language, its language and source; nulls have names of their own."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("?"))
    return [F.lit("*"), name(F.col("lang")), F.concat_ws("\x1f", name(F.col("lang")), name(F.col("source")))]


def judge(docs: DataFrame, reject: float = 1e-4) -> DataFrame:
    """doc_id, key, COUNTS, base_failed, d2 and kept of every row of docs (doc_id, text, lang, source).

    A row fails outright with under 10 words or over 20 % repeated words.  The other rows give the estimates, for each
    language and source, whatever its size; each borrows BORROWED rows' worth from its language's and that from all
    rows' estimate.  A row is rejected if its squared distance from its own language's and source's estimate exceeds the
    chi-square quantile of 1 - reject.  A null text is empty and so fails; null languages and sources form groups of
    their own; repeated rows are judged alike.  No rows: an empty result.
    """
    stats = statistics(docs).withColumns({f"x{i}": v for i, v in enumerate(_vector())}).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    stats = stored(stats.withColumn("level", levels()[2]), "quality")
    x = [f"x{i}" for i in range(DIMS)]
    good = stats.filter("NOT base_failed")
    whole, lang, fine = levels()
    groups = good.select(lang.alias("lang"), fine.alias("fine")).distinct()
    kinds = [(whole, F.lit(None).cast("string"), 0), (F.col("lang"), whole, 1), (F.col("fine"), F.col("lang"), 2)]
    parents = groups.select(F.inline(F.array(*(F.struct(c.alias("level"), p.alias("parent"), F.lit(d).alias("depth")) for c, p, d in kinds)))).distinct()
    params = fit_mcd(good.select("salt", *x, F.explode(F.array(*levels())).alias("level")), stored(parents, "quality-levels"))
    rows = met(stats, "level", params.select("level", "mean", "inverse"), "left", 20_000).withColumn("d2", _d2()).drop("mean", "inverse", "level", "salt", *x)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi2_quantile(1 - reject, DIMS)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs; rows of equal doc_id and text share their verdict.  A null text goes."""
    bad = stored(judge(docs).filter("NOT kept").select(F.col("doc_id").alias("_bad"), F.col("key").alias("_hash")).distinct(), "quality-rejects")
    return without(docs, [F.col("doc_id"), F.xxhash64("text", "lang", "source")], bad)


def op5_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op5_mcd_quality": op5_mcd_quality}
ORACLE: dict[str, str] = {}
