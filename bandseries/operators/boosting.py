"""Boosted trees by second-order gradients over histograms: penalties on leaves and splits, sampled rows and columns, two classes or many.

Rows stay where they are, in blocks of binned features; a level of a round is one job.  A task sums the gradients of its
rows by node, feature and bin; these sums meet by feature, where splits are weighed; the best split of each node comes to the driver.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stored

#: Rows in a block.
BLOCK = 4096
#: Nodes whose sums travel in one row.
CHUNK = 64
#: Rounds after which the margins of all rows are written again; until then a pass adds the latest trees to them.
KEEP = 8
#: A split must gain more than this.
LEAST = 1e-6

_STATE = pa.schema([("bins", pa.binary()), ("labels", pa.binary()), ("keys", pa.binary()), ("margins", pa.binary())])
STATE = "bins binary, labels binary, keys binary, margins binary"
_SUMS = pa.schema([("class", pa.int32()), ("feature", pa.int32()), ("chunk", pa.int32()), ("sums", pa.binary())])


class Tree:
    """A tree as lists by node, the root first; a leaf has feature -1.  Left is x < cut (in bins: bin <= split), or missing where so marked."""

    NAMES = ("feature", "split", "cut", "missing", "left", "right", "value")

    def __init__(self, columns: dict[str, list] | None = None) -> None:
        self.columns = columns or {n: [] for n in self.NAMES}

    def add(self) -> int:
        for name, v in zip(self.NAMES, (-1, -1, 0.0, False, -1, -1, 0.0), strict=True):
            self.columns[name].append(v)
        return len(self.columns["feature"]) - 1

    def leaves(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        """The node of each row that it ends in."""
        feature, split, cut, missing, left, right = (np.asarray(self.columns[n]) for n in self.NAMES[:6])
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            node = at[rows]
            inside = feature[node] >= 0
            rows, node = rows[inside], node[inside]
            v = x[rows, feature[node]]
            low = v <= split[node] if binned else v < cut[node]
            none = v == 255 if binned else np.isnan(v)
            at[rows] = np.where(np.where(none, missing[node], low), left[node], right[node])
        return at

    def values(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        return np.asarray(self.columns["value"], float)[self.leaves(x, binned)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(keys: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Whether a row is in the sample of a round, by hashes of its key."""
    if share >= 1:
        return np.ones(len(keys), bool)
    return mixed(mixed(keys ^ np.uint64(seed)) + np.uint64(turn)) / 2.0**64 < share


def gradients(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each class's margin: logistic for one margin, softmax for more."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins))
        return p - labels[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margins - margins.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p - (labels[:, None] == np.arange(p.shape[1])), np.maximum(2 * p * (1 - p), 1e-16)


def shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def weight(g: float, h: float, lam: float, alpha: float) -> float:
    """A leaf's weight: the minimum of g w + (h + lam) w^2 / 2 + alpha |w|."""
    return float(-shrunk(np.float64(g), alpha) / (h + lam)) if h + lam > 0 else 0.0


def gain(g: np.ndarray, h: np.ndarray, lam: float, alpha: float) -> np.ndarray:
    return np.where(h + lam > 0, shrunk(g, alpha) ** 2 / np.maximum(h + lam, 1e-300), 0.0)


def _blocks(cuts: list[list[float]], classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                x = some["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(some.num_rows, -1)
                if x.shape[1] != len(cuts):
                    raise ValueError(f"rows of {x.shape[1]} features among rows of {len(cuts)}")
                bins = np.stack([np.searchsorted(c, column, "right") for c, column in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)
                bins[np.isnan(x)] = 255
                row = (bins.tobytes(), some["y"].to_numpy().astype("<i4").tobytes(), some["key"].to_numpy().astype("<i8").tobytes(), np.zeros((len(x), classes)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], schema=_STATE)

    return run


def _read(b: pa.RecordBatch, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(b.num_rows):
        bins, labels, keys, margins = (b[c][i].as_buffer() for c in ("bins", "labels", "keys", "margins"))
        labels = np.frombuffer(labels, "<i4")
        yield np.frombuffer(bins, np.uint8).reshape(len(labels), -1), labels, np.frombuffer(keys, np.uint64), np.frombuffer(margins).reshape(-1, classes)


def _moved(trees: list[list[Tree]], classes: int):
    """Blocks with the trees of some rounds added to their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [(m + sum(np.stack([t.values(bins, True) for t in turn], 1) for turn in trees)).tobytes() for bins, _, _, m in _read(b, classes)]
            yield b.set_column(b.schema.get_field_index("margins"), "margins", pa.array(new, pa.binary()))

    return run


def _histograms(recent: list[list[Tree]], growing: list[Tree], frontier: list[list[int]], columns: list[int], width: int, sample: tuple[int, int, float]):
    """A task's rows to sums of gradients by class, column, node and bin; the last bin is that of missing values."""
    classes = len(growing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(f), len(columns), width, 2)) for f in frontier]
        seen = False
        for b in batches:
            for bins, labels, keys, margins in _read(b, classes):
                seen = True
                margins = margins + sum(np.stack([t.values(bins, True) for t in turn], 1) for turn in recent)
                g, h = gradients(margins, labels)
                into = drawn(keys, *sample)
                some = bins[:, columns].astype(np.int64)
                some[some == 255] = width - 1
                for k in range(classes):
                    place = np.full(len(growing[k].columns["feature"]), -1)
                    place[frontier[k]] = np.arange(len(frontier[k]))
                    node = place[growing[k].leaves(bins, True)]
                    rows = np.flatnonzero(into & (node >= 0))
                    at = ((node[rows, None] * len(columns) + np.arange(len(columns))) * width + some[rows]).ravel()
                    for c, v in enumerate((g, h)):
                        totals[k][..., c] += np.bincount(at, np.repeat(v[rows, k], len(columns)), totals[k][..., c].size).reshape(totals[k].shape[:3])
        if seen:
            out = []
            for k, total in enumerate(totals):
                for lo in range(0, len(total), CHUNK):
                    out += [(k, f, lo // CHUNK, total[lo : lo + CHUNK, j].tobytes()) for j, f in enumerate(columns)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SUMS.types, strict=True)], schema=_SUMS)

    return run


def _splits(width: int, lam: float, alpha: float, least: float):
    """All tasks' sums of a column to the best split of each node by it, class by class."""
    names = ["class", "node", "feature", "split", "missing", "gain", "g", "h", "gl", "hl"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(v) for v in rows["sums"]).reshape(-1, width, 2)
        low, none = np.cumsum(s[:, : width - 1], 1), s[:, width - 1]
        total = low[:, -1] + none
        best = None
        for missing in (False, True):
            left = low[:, :-1] + (none[:, None] if missing else 0)
            right = total[:, None] - left
            value = gain(left[..., 0], left[..., 1], lam, alpha) + gain(right[..., 0], right[..., 1], lam, alpha) - gain(total[:, 0], total[:, 1], lam, alpha)[:, None]
            fair = (left[..., 1] >= max(least, 1e-15)) & (right[..., 1] >= max(least, 1e-15))
            value = np.where(fair, np.round(value, 9), -1.0)  # compared to 9 decimals: sums in another order choose alike
            at = value.argmax(1)
            i = np.arange(len(s))
            got = np.stack((at, np.full(len(s), missing), value[i, at], left[i, at, 0], left[i, at, 1]), 1)
            best = got if best is None else np.where((got[:, 2] > best[:, 2])[:, None], got, best)
        node = rows["chunk"].iloc[0] * CHUNK + np.arange(len(s))
        return pd.DataFrame(
            {"class": rows["class"].iloc[0], "node": node, "feature": rows["feature"].iloc[0], "split": best[:, 0].astype(int), "missing": best[:, 1] > 0, "gain": best[:, 2], "g": total[:, 0], "h": total[:, 1], "gl": best[:, 3], "hl": best[:, 4]}
        )[names]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([one(some) for _, some in rows.groupby(["class", "chunk"])])

    return run


_SPLIT = "class int, node int, feature int, split int, missing boolean, gain double, g double, h double, gl double, hl double"


def _beside(brackets: dict[tuple[int, int], tuple[float, float]]):
    """For each bracket (feature, k): how many values lie below it (value null), and each value inside with its count."""
    kind = pa.schema([("f", pa.int32()), ("k", pa.int32()), ("value", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = dict.fromkeys(brackets, 0)
        for b in batches:
            if not b.num_rows:
                continue
            x, out = b["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1), []
            for f in sorted({f for f, _ in brackets}):
                values, counts = np.unique(x[:, f], return_counts=True)
                upto = np.append(0, np.cumsum(counts))
                for place, (lo, hi) in brackets.items():
                    if place[0] == f:
                        at, end = np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right")
                        below[place] += int(upto[at])
                        out += [(*place, v, n) for v, n in zip(values[at:end].tolist(), counts[at:end].tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)
        out = [(*place, None, n) for place, n in below.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

    return run


def bin_cuts(rows: DataFrame, n_features: int, bins: int) -> list[list[float]]:
    """Ascending cuts of each feature of rows (x): its values at 1 / bins, 2 / bins, ... of its rows, the ceil(n k / bins)-th smallest, exactly.

    Approximate quantiles a little below and above each place bracket it; what lies below the bracket is counted, what lies
    in it is ranked.  A bracket that misses its place is taken twice as wide.
    """
    value = lambda f: F.when(~F.isnan(F.col("x")[f]), F.col("x")[f])
    cuts: dict[tuple[int, int], float] = {}
    wanted, slack = {(f, k) for f in range(n_features) for k in range(1, bins)}, 2 / 10_000
    while wanted:
        features = sorted({f for f, _ in wanted})
        ends = [p for k in range(1, bins) for p in (max(0.0, k / bins - slack), min(1.0, k / bins + slack))]
        got = rows.agg(*(F.struct(F.count(value(f)).alias("n"), F.percentile_approx(value(f), ends, 10_000).alias("q")).alias(f"f{f}") for f in features)).first()
        n = {f: got[f"f{f}"]["n"] for f in features}
        wanted = {(f, k) for f, k in wanted if n[f]}
        if not wanted:
            break
        end = lambda f, i: (float("-inf"), float("inf"))[i % 2] if ends[i] in (0.0, 1.0) else got[f"f{f}"]["q"][i]  # noqa: B023, E731
        near = rows.mapInArrow(_beside({(f, k): (end(f, 2 * k - 2), end(f, 2 * k - 1)) for f, k in sorted(wanted)}), "f int, k int, value double, n long")
        upto = F.sum("n").over(Window.partitionBy("f", "k").orderBy("value"))  # nulls, what lies below, come first
        rank = F.ceil(F.element_at(F.create_map(*(F.lit(x) for f in features for x in (f, n[f]))), F.col("f")) * F.col("k") / F.lit(bins))
        near = near.groupBy("f", "k", "value").agg(F.sum("n").alias("n")).select("f", "k", "value", (upto >= rank).alias("reached")).filter("reached")
        found = near.groupBy("f", "k").agg(F.min("value").alias("cut"), F.bool_or(F.col("value").isNull()).alias("before"))
        new = {(r["f"], r["k"]): r["cut"] for r in found.collect() if not r["before"]}
        cuts |= new
        wanted, slack = wanted - set(new), 2 * slack
    return [sorted({cuts[f, k] for k in range(1, bins) if (f, k) in cuts}) for f in range(n_features)]


def grow(state: DataFrame, cuts: list[list[float]], classes: int, recent: list[list[Tree]], columns: list[int], depth: int, eta: float, lam: float, alpha: float, gamma: float, least: float, sample: tuple[int, int, float]) -> list[Tree]:
    """One tree for each class, level by level; splits that gain less than gamma are taken back from the leaves up."""
    width = max(map(len, cuts)) + 2
    trees, gains, sums = [Tree() for _ in range(classes)], [{} for _ in range(classes)], [{} for _ in range(classes)]
    frontier = [[t.add()] for t in trees]
    for _ in range(depth):
        found = state.mapInArrow(_histograms(recent, trees, frontier, columns, width, sample), "class int, feature int, chunk int, sums binary")
        found = found.groupBy("feature").applyInPandas(_splits(width, lam, alpha, least), _SPLIT)
        rank = F.struct(F.col("gain"), -F.col("feature"), -F.col("split"))
        best = found.groupBy("class", "node").agg(F.max_by(F.struct(*found.columns), rank).alias("b")).select("b.*").collect()
        after: list[list[int]] = [[] for _ in range(classes)]
        for b in sorted(best, key=lambda b: (b["class"], b["node"])):
            k, node = b["class"], frontier[b["class"]][b["node"]]
            sums[k].setdefault(node, (b["g"], b["h"]))
            if b["gain"] <= LEAST:
                continue
            t = trees[k].columns
            gains[k][node] = b["gain"]
            t["feature"][node], t["split"][node], t["cut"][node], t["missing"][node] = b["feature"], b["split"], cuts[b["feature"]][b["split"]], b["missing"]
            t["left"][node], t["right"][node] = trees[k].add(), trees[k].add()
            sums[k][t["left"][node]], sums[k][t["right"][node]] = (b["gl"], b["hl"]), (b["g"] - b["gl"], b["h"] - b["hl"])
            after[k] += [t["left"][node], t["right"][node]]
        frontier = after
        if not any(frontier):
            break
    for k, tree in enumerate(trees):
        t = tree.columns
        for node in range(len(t["feature"]) - 1, -1, -1):  # children come after their parents
            if t["feature"][node] >= 0 and t["feature"][t["left"][node]] < 0 and t["feature"][t["right"][node]] < 0 and gains[k][node] < gamma:
                t["feature"][node] = -1
            if t["feature"][node] < 0:
                t["value"][node] = eta * weight(*sums[k].get(node, (0.0, 0.0)), lam, alpha)
    return trees


class _Params(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasMaxIter, HasStepSize, HasSeed):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 254 at most", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows that a round's trees see", TypeConverters.toFloat)
    columnRate = Param(Params._dummy(), "columnRate", "share of the features that a round's trees see", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "quadratic penalty on leaf weights", TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "absolute penalty on leaf weights", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "what a split must gain at least", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least sum of second derivatives in a child", TypeConverters.toFloat)
    numClasses = Param(Params._dummy(), "numClasses", "labels 0 .. numClasses - 1; 0: as many as the labels need", TypeConverters.toInt)

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", maxIter=100, stepSize=0.3, seed=42, maxDepth=6, maxBins=64,
            subsamplingRate=1.0, columnRate=1.0, regLambda=1.0, regAlpha=0.0, gamma=0.0, minChildWeight=1.0, numClasses=0,
        )


class BoostedTrees(Estimator, _Params, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees on a vector column and labels 0, 1, ...; with two classes one tree a round, with more one for each.

    Rows without features or label, or with a label outside, are left out; NaN is a missing value, for which each split
    has a side.  Samples of rows follow hashes of their features and label, so partitioning changes no sample (equal rows are drawn alike).
    """

    @keyword_only
    def __init__(self, **kwargs) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, **kwargs) -> BoostedTrees:
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        get = lambda name: self.getOrDefault(getattr(self, name))
        x = vector_to_array(self.getFeaturesCol()) if dataset.schema[self.getFeaturesCol()].dataType.typeName() != "array" else F.col(self.getFeaturesCol()).cast("array<double>")
        rows = dataset.select(x.alias("x"), F.col(self.getLabelCol()).cast("int").alias("y")).filter("x IS NOT NULL AND y >= 0")
        rows = rows.withColumn("key", F.xxhash64("x", "y"))
        first = rows.agg(F.max("y").alias("most"), F.first(F.size("x")).alias("n")).first()
        labels, features = get("numClasses") or (first["most"] or 0) + 1, first["n"] or 0
        classes = 1 if labels <= 2 else labels
        turns: list[list[Tree]] = []
        if features:
            rows = rows.filter(F.col("y") < labels)
            cuts = bin_cuts(rows, features, min(get("maxBins"), 254))
            state, recent = stored(rows.mapInArrow(_blocks(cuts, classes), STATE), "boosting"), []
            for turn in range(get("maxIter")):
                n = max(1, round(get("columnRate") * features))
                columns = sorted(random.Random(f"{get('seed')}/{turn}").sample(range(features), n))
                made = grow(
                    state, cuts, classes, recent, columns, get("maxDepth"), get("stepSize"), get("regLambda"), get("regAlpha"), get("gamma"), get("minChildWeight"), (get("seed"), turn, get("subsamplingRate"))
                )
                turns.append(made)
                recent.append(made)
                if len(recent) == KEEP:
                    state, recent = stored(state.mapInArrow(_moved(recent, classes), STATE), "boosting"), []
        made = BoostedModel()
        self._copyValues(made)
        return made._set(trees=json.dumps([[t.columns for t in turn] for turn in turns]), numClasses=max(2, labels))


class BoostedModel(Model, _Params, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; adds the probability of each class and the class with the largest (the first of equals)."""

    trees = Param(Params._dummy(), "trees", "the trees of all rounds, as JSON", TypeConverters.toString)

    def rounds(self) -> list[list[Tree]]:
        return [[Tree(t) for t in turn] for turn in json.loads(self.getOrDefault(self.trees))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        turns, labels = self.rounds(), self.getOrDefault(self.numClasses)
        classes = 1 if labels <= 2 else labels

        @F.pandas_udf("array<double>")
        def probabilities(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))
            m = np.zeros((len(x), classes))
            for turn in turns:
                m += np.stack([t.values(x) for t in turn], 1)
            if classes == 1:
                p = 1 / (1 + np.exp(-m))
                p = np.concatenate((1 - p, p), 1)
            else:
                p = np.exp(m - m.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
            return pd.Series(list(p))

        column = self.getFeaturesCol()
        x = vector_to_array(column) if dataset.schema[column].dataType.typeName() != "array" else F.col(column).cast("array<double>")
        p = dataset.withColumn("_p", probabilities(x))
        first = F.array_position("_p", F.array_max("_p")) - 1
        return p.withColumn(self.getProbabilityCol(), array_to_vector("_p")).withColumn(self.getPredictionCol(), first.cast("double")).drop("_p")
