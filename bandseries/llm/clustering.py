"""Centroid clustering: Lloyd's rounds with a heap of bound gaps per cluster, so that only vectors whose gap expires are rescanned."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Vectors in a block: a block is one row of the state, and has one heap per cluster.
BLOCK = 4096
#: Components beyond this have squared distances that a long may not hold.
LARGEST = 1 << 27

_FIELDS = [
    ("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("points", pa.binary()), ("cluster", pa.binary()), ("sizes", pa.list_(pa.int32())),
    ("gaps", pa.binary()), ("members", pa.binary()), ("sums", pa.list_(pa.int64())), ("scanned", pa.int64()),
]
_SCHEMA = pa.schema(_FIELDS)
STATE = "ids array<long>, kind string, points binary, cluster binary, sizes array<int>, gaps binary, members binary, sums array<long>, scanned long"


def squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to integer centers, as longs."""
    if max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0)) < 1 << 21:  # all sums stay below 2**53
        x, c = x.astype(float), centers.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([np.square(x.astype(np.int64) - c).sum(1) for c in centers], 1)


def _blocks(dims: int, k: int):
    """(id, point) rows to blocks; at first all vectors are in the first heap with a gap that has expired."""

    def block(ids: list, points: np.ndarray) -> pa.RecordBatch:
        most = int(np.abs(points).max(initial=0))
        if most > LARGEST:
            raise ValueError(f"component {most}: squared distances may pass a long")
        kind = next(t for t in ("<i1", "<i2", "<i4") if most <= np.iinfo(t).max)
        n = len(ids)
        row = {
            "ids": ids, "kind": kind, "points": points.astype(kind).tobytes(), "cluster": np.full(n, -1, "<i4").tobytes(), "sizes": [n] + [0] * (k - 1),
            "gaps": np.full(n, -np.inf).tobytes(), "members": np.arange(n, dtype="<i4").tobytes(), "sums": [0] * (k * (dims + 1)), "scanned": 0,
        }
        return pa.RecordBatch.from_pylist([row], _SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                yield block(some["id"].to_pylist(), some["point"].flatten().to_numpy().reshape(-1, dims))

    return run


def _step(centers: list[list[int]], drift: list[float]):
    """One assignment of every block: what a heap has at or below its cluster's drift is popped, rescanned and pushed again."""
    c = np.asarray(centers, np.int64)
    k, dims = c.shape
    drift = np.asarray(drift)

    def block(row: dict) -> dict:
        x = np.frombuffer(row["points"], row["kind"]).reshape(-1, dims)
        cluster = np.frombuffer(row["cluster"], "<i4").copy()
        sums = np.asarray(row["sums"], np.int64).reshape(k, dims + 1)
        gaps, members = np.frombuffer(row["gaps"]).tolist(), np.frombuffer(row["members"], "<i4").tolist()
        heaps, at = [], 0
        for size in row["sizes"]:
            heaps.append(list(zip(gaps[at : at + size], members[at : at + size], strict=True)))  # stored in heap order
            at += size
        expired = []
        for heap, limit in zip(heaps, drift, strict=True):
            if heap and np.isneginf(heap[0][0]):  # the first round: all of them
                expired += [m for g, m in heap if g <= limit]
                heap[:] = [e for e in heap if e[0] > limit]
                heapify(heap)
            while heap and heap[0][0] <= limit:
                expired.append(heappop(heap)[1])
        if expired:
            who = np.asarray(expired)
            d = squares(x[who], c)
            own = d.argmin(1)  # the first of equals
            near = np.sqrt(d[np.arange(len(who)), own].astype(float))
            d[np.arange(len(who)), own] = np.iinfo(np.int64).max
            other = np.sqrt(d.min(1).astype(float)) if k > 1 else np.full(len(who), np.inf)
            gap = other - near - 1e-9 * (1 + near + np.where(np.isinf(other), 0, other)) + drift[own]
            old = cluster[who]
            moved = old != own
            rows = np.concatenate((x[who].astype(np.int64), np.ones((len(who), 1), np.int64)), 1)
            np.add.at(sums, own[moved], rows[moved])
            left = moved & (old >= 0)
            np.subtract.at(sums, old[left], rows[left])
            cluster[who] = own
            for g, j, m in zip(gap.tolist(), own.tolist(), expired, strict=True):
                heappush(heaps[j], (g, m))
        flat = [e for heap in heaps for e in heap]
        return row | {
            "cluster": cluster.tobytes(), "sizes": [len(h) for h in heaps], "gaps": np.asarray([g for g, _ in flat], float).tobytes(),
            "members": np.asarray([m for _, m in flat], "<i4").tobytes(), "sums": sums.ravel().tolist(), "scanned": len(expired),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pylist([block(b.slice(i, 1).to_pylist()[0])], _SCHEMA)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's blocks, summed to one row."""
    total = None
    for b in batches:
        for sums in b["sums"]:
            one = np.asarray(sums.values)
            total = one.copy() if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tolist()], pa.list_(pa.int64()))})


def _unfolded(centers: list[list[int]]):
    """A block to its vectors' ids, clusters and exact squared distances."""
    c = np.asarray(centers, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                cluster = np.frombuffer(row["cluster"], "<i4")
                gap = np.frombuffer(row["points"], row["kind"]).reshape(-1, c.shape[1]).astype(np.int64) - c[cluster]
                yield pa.RecordBatch.from_pydict({"id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(cluster), "distance": pa.array((gap * gap).sum(1))})

    return run


def cluster_sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the clusters: each task adds its blocks up, and k x (dims + 1) numbers come to the driver."""
    each = state.select("sums").mapInArrow(_added, "sums array<long>").select(F.posexplode("sums").alias("at", "v"))
    total = np.zeros(k * (dims + 1), object)
    for at, v in each.groupBy("at").agg(F.sum("v")).collect():
        total[at] = int(v)
    total = total.reshape(k, dims + 1)
    return total[:, :dims], total[:, dims]


def heap_clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(rows (id, cluster, distance), the final centroids, vectors rescanned in each assignment) by Lloyd's rounds on integer vectors.

    A component x counts as floor(scale * x).  Rows whose vector hasn't `dims` components, or has a null, an infinite or no
    number among them, are left out; a null key is an ordinary one (as a centroid it comes last); repeated rows are
    ordinary rows; a component beyond 2**27 after scaling is an error, as its distances may pass a long.  The k vectors
    with the smallest sha256 of `1:<key>` are the first centroids (equal keys: the smaller vector first); of fewer than k vectors
    all are.  Each round assigns every vector to its nearest centroid (ties: the smaller number) and moves
    each centroid to the floor of its vectors' mean, empty ones staying; then all are assigned once more.  No rows: an
    empty result.  Other columns are not read.

    Vectors stay in blocks.  A block has a heap for each cluster, of the gaps between its vectors' distances to the second
    nearest and to the nearest centroid, plus the cluster's drift when the gap was taken.  A cluster's drift grows each
    round by its own move and by the largest move of another; a vector whose gap is above the drift can't change its cluster, so only
    what the drift has reached is popped, compared with all centroids exactly, and pushed again.  A block's sums
    change by the vectors that moved.  State is written to the shared folder each round; centroids and drifts, k x dims numbers, go through the driver.
    """
    v = F.col(vector)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = vectors.filter((F.size(v) == dims) & F.forall(v, fine))
    kept = kept.select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("point"))
    placed = kept.withColumn("hash", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256))
    centers = [list(r["point"]) for r in placed.orderBy(F.asc_nulls_last("hash"), "point").limit(k).collect()]
    if not centers:
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], []
    k = len(centers)
    state, drift, scanned = stored(kept.mapInArrow(_blocks(dims, k), STATE), "vectors"), np.zeros(k), []
    for turn in range(rounds + 1):
        state = stored(state.mapInArrow(_step(centers, drift.tolist()), STATE), "clusters")
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if turn < rounds:
            sums, counts = cluster_sums(state, k, dims)
            new = [[int(s) // int(n) for s in row] if n else old for row, n, old in zip(sums, counts, centers, strict=True)]
            moves = np.sqrt(np.square(np.asarray(new, float) - np.asarray(centers, float)).sum(1)) * (1 + 1e-12)
            order = np.sort(moves)
            drift += moves + np.where(moves == order[-1], order[-2] if k > 1 else 0.0, order[-1])
            centers = new
    return state.mapInArrow(_unfolded(centers), "id long, cluster int, distance long"), centers, scanned


def op12_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centers, _ = heap_clusters(table(spark, sf_dir, "embeddings"))
    rows = stored(rows, "assigned")
    inertia = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())
    named = [(j, int(inertia.get(j, 0)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centers)]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, centroid_sha256 string")
    all_ = F.lit(sum(inertia.values())).cast("long")
    out = rows.join(F.broadcast(named), "cluster")  # one row for each centroid
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", all_.alias("inertia"), "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    far = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])))"
    floor = "(s - ((s % n) + n) % n) // n"
    out = f"""
        WITH q AS (
            SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
        c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x FROM (SELECT x, sha256('1:' || vec_id) AS h FROM q ORDER BY h NULLS LAST, x LIMIT {k}))"""
    for t in range(rounds + 1):
        out += f""",
        a{t} AS (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (SELECT q.r, c.c, {far} AS d FROM q, c{t} c) GROUP BY r)"""
        if t < rounds:
            out += f""",
        s{t} AS (SELECT c, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(range(1, {dims + 1})) AS i, unnest(x) AS v FROM a{t} JOIN q USING (r)) GROUP BY c, i),
        c{t + 1} AS (SELECT c, coalesce(y, x) AS x FROM c{t} LEFT JOIN (SELECT c, list({floor} ORDER BY i) AS y FROM s{t} GROUP BY c) USING (c))"""
    return out + f"""
        SELECT vec_id, m.c AS cluster, m.d::BIGINT AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN q USING (r) JOIN c{rounds} c ON c.c = m.c"""


QUERIES = {"op12_heap_clusters": op12_heap_clusters}
ORACLE = {"op12_heap_clusters": _sql()}
