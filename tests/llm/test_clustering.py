"""Clusters by heaps of gaps against plain rounds over all vectors."""

import hashlib
import math
import random

from bandseries.llm import clustering


def plain(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        got = [min((far(v, c), j) for j, c in enumerate(centers)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centers)):
                own = [v for (_, v), (_, at) in zip(kept, got, strict=True) if at == j]
                if own:
                    centers[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, got, strict=True)), key=str), centers


def lumps(n, dims, seed=5, spread=0.05):
    rng = random.Random(seed)
    at = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    return [(k, [float(x + rng.gauss(0, spread)) for x in at[k % 6]]) for k in range(n)]


def check(spark, rows, k=4, rounds=6, dims=5):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, id string, point string")
    out, centers, scanned = clustering.heap_clusters(made, k=k, rounds=rounds, dims=dims)
    want, means = plain([r[:2] for r in rows], k, rounds, dims)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert centers == means
    return scanned


def test_equal_to_plain_rounds_and_few_rescanned(spark):
    rows = [(*r, "x", "x", "x") for r in lumps(3000, 5)]
    scanned = check(spark, rows, k=6, rounds=8)
    assert scanned[0] == 3000
    assert scanned[-1] < 300


def test_odd_rows(spark):
    bad = [(1, None), (2, []), (3, [1.0] * 4), (4, [1.0] * 6), (5, [1.0, None, 1.0, 1.0, 1.0]), (6, [1.0, math.nan, 1.0, 1.0, 1.0]), (7, [math.inf] * 5)]
    rows = [(*r, "x", "x", "x") for r in [*lumps(40, 5), *bad, (None, [0.5] * 5), (8, [0.5] * 5), (8, [0.5] * 5), (9, [-0.5] * 5)]]
    check(spark, rows)


def test_ties_and_empty_clusters(spark):
    rows = [(k, [float(k % 2)] * 5, "x", "x", "x") for k in range(50)]
    check(spark, rows, k=8, rounds=3)


def test_fewer_vectors_than_clusters(spark):
    check(spark, [(*r, "x", "x", "x") for r in lumps(3, 5)], k=8)
    check(spark, [(*r, "x", "x", "x") for r in lumps(1, 5)], k=8)


def test_large_components(spark):
    check(spark, [(k, [float((k * 7919 + d) % 1_000_003) for d in range(5)], "x", "x", "x") for k in range(200)], k=5, rounds=4)


def test_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustering.heap_clusters(none)[0].collect() == []
