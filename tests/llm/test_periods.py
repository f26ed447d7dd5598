"""Periodic runs against plain comparison of all words."""

import hashlib
import random
import re
import zlib

import pytest

from bandseries.llm import periods
from compare import duck

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(w):
    """(start, length, period) by comparing every word with those of every distance."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    keep = [True] * len(w)
    for s, n, q in runs:
        keep[s + q : s + n] = [False] * (n - q)
    return " ".join(x for x, k in zip(w, keep, strict=True) if k)


def planted(d, t):
    w, h = WORD.findall(t or ""), zlib.crc32(str(d).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_op11(spark, sf):
    got = {r["doc_id"]: r for r in periods.op11_periodic_runs(spark, sf).collect()}
    docs = duck(sf).execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(docs)
    some = 0
    for d, t in docs:
        w = planted(d, t)
        if len(w) > 4000:
            continue
        runs, r = runs_of(w), got[d]
        some += bool(runs)
        assert r["n_runs"] == len(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else None
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert some > 10


def random_words(rng):
    n, k = rng.choice([0, 1, 11, 12, 13, 40, 100, 300, 700]), rng.choice([1, 2, 3, 5, 26])
    w = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n)]
    for _ in range(rng.choice([0, 1, 3])):
        if n > 4:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 2 + 1))
            for i in range(a + p, min(n, a + p * rng.choice([2, 3, 4, 10]) + rng.randrange(3))):
                w[i] = w[i - p]
    return w


def test_random_words(spark, monkeypatch):
    rng = random.Random(7)
    words = [random_words(rng) for _ in range(400)]
    made = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "doc_id long, text string")
    for r in periods.periodic_runs(made).collect():
        w = words[r["doc_id"]]
        assert [tuple(x) for x in r["runs"]] == runs_of(w)
        assert r["collapsed"] == collapsed(w, runs_of(w))


def test_fibonacci_words(spark):
    """Words with as many runs as words can have."""
    a, b = "x", "x y"
    for _ in range(11):
        a, b = b, f"{b} {a}"
    w = b.split()
    made = periods.periodic_runs(spark.createDataFrame([(1, b)], "doc_id long, text string")).first()
    assert [tuple(x) for x in made["runs"]] == runs_of(w)


def test_one_very_long_text(spark):
    w = [f"w{k}" for k in range(30_000)]
    w = [*w, *w[20_000:], *["z"] * 50_000, *w[:7], *w[:7], "end"]
    made = periods.periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert [tuple(x) for x in made["runs"]] == [(20_000, 20_000, 10_000), (40_000, 50_000, 1), (90_000, 14, 7)]
    assert len(made["collapsed"].split()) == 30_000 + 1 + 7 + 1
    tile = max(len(t["ids"]) for o in _tiles(" ".join(w)) for t in o)
    assert tile < 4 * 3 * 32_768


def _tiles(text):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"row": [1], "key": [1], "text": [text]})
    return [r["tiles"] for b in periods._find(iter([batch])) for r in b.to_pylist()]


def test_z_function():
    assert periods.z_function(list("aabaab")) == [6, 1, 0, 3, 1, 0]
    assert periods.z_function([]) == []


@pytest.mark.parametrize("octave", [1, 2, 4, 8, 64])
def test_reach_meets_every_run(octave):
    assert all(periods.reach(octave) <= max(12 - q, q) for q in range(octave, 2 * octave))
