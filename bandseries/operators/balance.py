"""Class balance: counts, ratios, neighbours within a class, and synthetic minority rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import rank_by_uniform
from ..functions.scalars import hash_uniform
from ..sources.tables import stored

#: Distances that a task has in memory at a time.
CELLS = 1 << 20
#: Blocks of a class that grow with the class before their number does, and rows of a block at most.
BLOCKS, BLOCK = 32, 1 << 14
#: Draws that one copy of a row serves, about.
DRAWS = 4096
#: Most large classes that have pivots.
CLASSES = 20_000


def class_counts(rows: DataFrame, split: str, label: str) -> DataFrame:
    """(split, label, n, share); null split: over all splits."""
    counts = rows.rollup(label, split).agg(F.count(F.lit(1)).alias("n"), F.grouping(label).alias("_all")).filter("_all = 0").drop("_all")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def imbalance_ratio(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Per key: the largest and smallest class and their ratio."""
    n = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max("n").alias("majority"), F.min("n").alias("minority"), (F.max("n") / F.min("n")).alias("ratio"))


def _squares(x: np.ndarray, columns: np.ndarray, who: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Squared distances of pairs (row of x, row of y), summed by dimension in order whatever the block, so that equal vectors tie."""
    out = np.zeros(len(who))
    for d, column in enumerate(columns):
        gap = x[who, d] - column[near]
        out += gap * gap
    return out


def _nearest(key: str, label: str, k: int):
    """For two blocks of one class: the k nearest of the right block to each row of the left.

    A product of matrices gives all squared distances but for rounding; those that may be among the k nearest are summed exactly.
    """
    names = [key, label, "neighbour", "distance"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        right = right.sort_values("_key", kind="stable")
        ours, theirs = left[key].to_numpy(), right["_key"].to_numpy()
        x, y = np.stack(left["_v"].to_numpy()).astype(float), np.stack(right["_w"].to_numpy()).astype(float)
        columns, out = np.ascontiguousarray(y.T), []
        repeated = right["_key"].value_counts()
        own = int(repeated[repeated.index.isin(ours)].max()) if repeated.index.isin(ours).any() else 0  # as many may be the row itself
        length_x, length_y = np.square(x).sum(1), np.square(y).sum(1)
        most = k + own
        step = max(1, CELLS // len(y))
        with np.errstate(all="ignore"):
            slack = 4e-15 * (y.shape[1] + 16) * (length_x + length_y.max())
        sure = bool(np.isfinite(slack).all())
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            if most >= len(y) or not sure:  # all are looked at
                who, near = (i.ravel() for i in np.indices((len(part), len(y))))
            else:
                rough = length_y - 2 * (part @ columns)
                reach = np.partition(rough, most - 1, axis=1)[:, most - 1] + 2 * slack[lo : lo + step]
                who, near = np.nonzero(rough <= reach[:, None])
            other = ours[lo + who] != theirs[near]
            who, near = who[other], near[other]
            square = _squares(part, columns, who, near)
            known = ~np.isnan(square)
            who, near, square = who[known], near[known], square[known]
            order = np.lexsort((near, square, who))  # of equally near ones the smaller key
            who, near, square = who[order], near[order], square[order]
            first = np.searchsorted(who, who)
            some = np.arange(len(who)) - first < k
            out.append((lo + who[some], near[some], np.sqrt(square[some])))
        who, near, distance = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame({key: ours[who], label: left[label].iloc[0], "neighbour": theirs[near], "distance": distance})[names]

    return run


def _own(key: str, label: str, k: int):
    """For one block: the k nearest in it of each row."""
    both = _nearest(key, label, k)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        return both(block, block.rename(columns={key: "_key", "_v": "_w"}))

    return run


class Pivots:
    """Some rows of each large class: every row belongs to its nearest one's cell, and a cell reaches as far as its farthest row."""

    def __init__(self, rows: list) -> None:
        self.of: dict = {}
        for name, vector in rows:
            self.of.setdefault(name, []).append(vector)
        self.of = {name: np.asarray(sorted(v), float) for name, v in self.of.items()}
        self.radius: dict = {}

    def distances(self, name: object, x: np.ndarray) -> np.ndarray:
        p = self.of[name]
        out = np.empty((len(x), len(p)))
        for j, one in enumerate(p):
            out[:, j] = np.sqrt(np.square(x - one).sum(1))
        return out


def _celled(label: str, pivots: Pivots):
    """Adds each row's cell and its distance to the pivot; rows of small classes are in cell 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, far = np.zeros(len(b), np.int64), np.zeros(len(b))
            for name, at in b.groupby(label).indices.items():
                if name in pivots.of:
                    d = pivots.distances(name, np.stack(b["_v"].to_numpy()[at]).astype(float))
                    cell[at] = d.argmin(1)
                    far[at] = d[np.arange(len(at)), cell[at]]
            yield b.assign(_cell=cell, _far=far)

    return run


def _wanted(label: str, pivots: Pivots):
    """For blocks of rows (with `_kth`, how far a row's k-th nearest in its own block is): the cells that may hold a nearer one of some row.

    A row of a cell is no nearer than the pivot less the cell's reach, by the triangle inequality.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, at in b.groupby(label).indices.items():
                for lo in range(0, len(at), 1024):
                    some = b.iloc[at[lo : lo + 1024]]
                    d = pivots.distances(name, np.stack(some["_v"].to_numpy()).astype(float))
                    who, cell = np.nonzero(d - pivots.radius[name] <= some["_kth"].to_numpy()[:, None] + 1e-9 * (1 + d))
                    yield pd.DataFrame({"_block": some["_block"].to_numpy()[who], "_to": cell}).drop_duplicates().assign(**{label: name})[[label, "_block", "_to"]]

    return run


def class_neighbours(rows: DataFrame, key: str, label: str, vector: str, k: int = 5, exact_rows: int = 2_000, pivot_bytes: int = 32 << 20) -> DataFrame:
    """(key, label, rank, neighbour, distance): each row's k nearest rows of its own class, itself left out.

    Exact for classes of any size; ties go to the smaller key.  A class of up to `exact_rows` rows is one block, in which all
    rows are compared.  A larger class has about the square root of its rows as pivots (fewer where all pivots would take
    more than `pivot_bytes`): a row's cell is its nearest pivot's.  Small cells are put together into blocks of about `exact_rows`
    rows (more in very large classes, BLOCK at most), and large ones dealt over several.  A row's k-th nearest in its own block says
    how far it has to look: two blocks are compared where a row of the one may have a nearer one in a cell of the other.
    Where rows lie in clusters that's a few of all pairs; where they don't, it may be all of them, over many tasks.  No task
    has more than two blocks.  Rows without a key, label or vector neither have neighbours nor are any.
    """
    out, _ = _neighbours(rows, key, label, vector, k, exact_rows, pivot_bytes)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(label, key).orderBy("distance", "neighbour")))
    return ranked.filter(F.col("rank") <= k).select(key, label, "rank", "neighbour", "distance")


def pairs_compared(rows: DataFrame, key: str, label: str, vector: str, k: int = 5, exact_rows: int = 2_000, pivot_bytes: int = 32 << 20) -> int:
    """How many pairs (a row, another one's place) class_neighbours compares."""
    _, sides = _neighbours(rows, key, label, vector, k, exact_rows, pivot_bytes)
    total = 0
    for left, right, on, also in sides:
        named = lambda df, by, n: df.groupBy(*by).count().select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(by)), F.col("count").alias(n))
        counts = named(left, on, "_n").join(named(right, also, "_m"), [f"_c{i}" for i in range(len(on))])
        total += counts.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    return total


def _neighbours(rows: DataFrame, key: str, label: str, vector: str, k: int, exact_rows: int, pivot_bytes: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, list[str], list[str]]]]:
    """k nearest or more of each row by blocks, and the sides that are compared, with the columns on which they meet."""
    plain = F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    held = rows.select(key, label, plain.alias("_v")).filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col("_v").isNotNull())
    kind = {f.name: f.dataType.simpleString() for f in held.schema}
    schema = f"`{key}` {kind[key]}, `{label}` {kind[label]}, neighbour {kind[key]}, distance double"
    beyond = held.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.first(F.size("_v")).alias("_d")).filter(F.col("_n") > exact_rows)
    large = beyond.select(label, "_n", "_d").limit(CLASSES + 1).collect()
    if not large:
        return held.groupBy(label).applyInPandas(_own(key, label, k), schema), [(held, held, [label], [label])]
    large = large if len(large) <= CLASSES else []  # of more classes than that, all are one cell, and so blocks by a hash
    share = min(1.0, pivot_bytes / sum(8 * r["_d"] * r["_n"] ** 0.5 for r in large)) if large else 0.0
    spark = held.sparkSession
    least = spark.createDataFrame([(r[label], r["_n"] ** -0.5 * share) for r in large], f"`{label}` {kind[label]}, _share double")
    chosen = held.join(F.broadcast(least), label).filter(hash_uniform(0, F.lit("pivot"), key) < F.col("_share"))
    pivots = Pivots([(r[label], list(r["_v"])) for r in chosen.select(label, "_v").distinct().collect()])  # pivot_bytes of them, about
    cells = stored(held.mapInPandas(_celled(label, pivots), f"{', '.join(f'`{c}` {t}' for c, t in kind.items())}, _cell long, _far double"), "cells")
    sizes = cells.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_rows"), F.max("_far").alias("_reach"))
    size = F.greatest(F.lit(exact_rows), F.least(F.ceil(F.sum("_rows").over(Window.partitionBy(label)) / F.lit(BLOCKS)), F.lit(BLOCK)))
    sizes = sizes.withColumn("_size", size).withColumn("_small", F.col("_rows") < F.col("_size"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(label, "_small").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.when(F.col("_small"), 1).otherwise(F.ceil(F.col("_rows") / F.col("_size"))).cast("int")
    # Small cells share the blocks 0, 1, ...; a large one has blocks of its own, below 0.
    first = F.when(F.col("_small"), F.floor(before / F.col("_size"))).otherwise(-1 - F.shiftleft("_cell", 32)).cast("long")
    sizes = stored(sizes.select(label, "_cell", "_reach", first.alias("_first"), parts.alias("_parts")), "cell-sizes")
    for r in sizes.join(F.broadcast(least), label).select(label, "_cell", "_reach").collect():
        if r[label] in pivots.of:
            pivots.radius.setdefault(r[label], np.full(len(pivots.of[r[label]]), -np.inf))[r["_cell"]] = r["_reach"]
    block = F.col("_first") - F.pmod(F.xxhash64(F.lit("block"), key), F.col("_parts"))
    placed = stored(cells.join(sizes.select(label, "_cell", "_first", "_parts"), [label, "_cell"]).select(key, label, "_v", block.alias("_block")), "blocks")
    own_on = [label, "_block"]
    own = stored(placed.groupBy(*own_on).applyInPandas(_own(key, label, k), schema), "own-block")
    kth = own.groupBy(label, key).agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_kth"))
    asking = placed.join(beyond.select(label), label, "left_semi")
    rest = asking
    if pivots.of:
        rest = asking.filter(~F.col(label).isin(*pivots.of))
        asking = asking.filter(F.col(label).isin(*pivots.of)).join(kth, [label, key], "left")
        asking = asking.select(label, "_v", "_block", F.when(F.col("_n") >= k, F.col("_kth")).otherwise(F.lit(float("inf"))).alias("_kth"))
    asks = rest.select(label, "_block", F.lit(0).cast("long").alias("_to"))
    if pivots.of:
        asks = asks.unionByName(asking.mapInPandas(_wanted(label, pivots), f"`{label}` {kind[label]}, _block long, _to long"))
    others = sizes.select(label, F.col("_cell").alias("_to"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - F.lit(1).cast("long"))).alias("_part"), "_first")
    asks = asks.distinct().join(others.select(label, "_to", (F.col("_first") - F.col("_part")).alias("_of")), [label, "_to"])
    asks = stored(asks.filter(F.col("_of") != F.col("_block")).select(label, "_block", "_of").distinct(), "asking")
    on = [label, "_block", "_of"]
    ours = placed.join(asks, [label, "_block"])
    theirs = asks.select(*(F.col(c).alias(f"_on{i}") for i, c in enumerate(on)))
    theirs = placed.select(F.col(key).alias("_key"), F.col(label).alias("_on0"), F.col("_v").alias("_w"), F.col("_block").alias("_on2")).join(theirs, ["_on0", "_on2"])
    also = [f"_on{i}" for i in range(3)]
    far = ours.groupBy(*on).cogroup(theirs.groupBy(*also)).applyInPandas(_nearest(key, label, k), schema)
    return own.unionByName(far), [(placed, placed, own_on, own_on), (ours, theirs, on, also)]


def smote(rows: DataFrame, key: str, label: str, vector: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows (label, draw, base, neighbour, step, vector) that bring each class up to the largest.

    Draw d of a class picks a row, one of its k nearest and a step by hashes of seed, class and d; the vector lies on
    the segment between the two; a row that is alone in its class is its own neighbour, so every draw makes a row.  Only
    classes that need rows have neighbours computed.  Where a class has many draws to a row, its rows are repeated for
    every DRAWS draws of one, and draws are dealt over the copies, so no row gathers the draws of its class in one task.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    salts = F.ceil((F.lit(most) - F.col("_n")) / (F.col("_n") * F.lit(DRAWS))).cast("long")
    short = sizes.filter(F.col("_n") < most).withColumn("_salts", salts)
    draws = short.select(label, "_n", "_salts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most) - F.col("_n") - 1)).alias("draw"))
    u = lambda what: hash_uniform(seed, label, "draw", F.lit(what))
    minority = rows.select(key, label, vector).join(short.select(label, "_salts"), label)
    dealt = lambda df: df.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    placed = rank_by_uniform(minority.withColumn("_u", hash_uniform(seed, key)), [label], "_u", [key], "_at").select(label, "_salts", F.col(key).alias("base"), F.col(vector).alias("_x"), "_at")
    near = class_neighbours(minority, key, label, vector, k)
    held = near.groupBy(F.col(key).alias("base")).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("_near"))
    drawn = draws.withColumn("_at", F.floor(u("row") * F.col("_n")).cast("long")).withColumn("_salt", F.col("draw") % F.col("_salts"))
    drawn = drawn.join(dealt(placed.join(held, "base", "left")), [label, "_at", "_salt"])
    pick = F.element_at("_near", (F.floor(u("neighbour") * F.size("_near")) + 1).cast("int"))
    drawn = drawn.select(label, "draw", "_salt", "base", F.coalesce(pick["neighbour"], "base").alias("neighbour"), u("step").alias("step"), "_x")
    other = dealt(minority.select(label, "_salts", F.col(key).alias("neighbour"), F.col(vector).alias("_y")))
    made = drawn.join(other, [label, "neighbour", "_salt"])
    mixed = lambda x, y: x.cast("double") + F.col("step") * (y.cast("double") - x.cast("double"))
    return made.select(label, "draw", "base", "neighbour", "step", F.zip_with("_x", "_y", mixed).alias(vector))


def oversampled(rows: DataFrame, key: str, label: str, vector: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(label, vector) of all rows and the synthetic ones."""
    real = rows.select(label, F.col(vector).cast("array<double>").alias(vector))
    return real.unionByName(smote(rows, key, label, vector, k, seed).select(label, vector))
