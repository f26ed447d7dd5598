"""Packed sequences against the tokenizers library and what packing must keep."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bandseries.llm import packing
from compare import duck


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def test_op13(spark, sf, library):
    docs = duck(sf).execute("SELECT doc_id, text FROM documents").fetchall()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.op13_bin_slack_packing(spark, sf).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, t in docs:
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces.pop(d), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    assert not pieces
    assert padding(sequences) == 0


def padding(sequences):
    out = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            assert r["length"] > 0
            at += r["length"]
        assert at <= 4096
        out += 4096 - at if at & (at - 1) else 0
    return out


def test_words_are_encoded_as_whole_texts_are(path, library):
    texts = [
        "a<|endoftext|>b c", "<|startoftext|>", "", "  \n\t ", "Don't STOP it's 123 45,6   　x", "é ́x ΑΣ ς", "\x1c a\x1fb \x85c",
        "ABC<|startoftext|>DEF<|startoftext|> <|endoftext|>", "   ", "x" * 5000, "\U0001f600 क्ष ée", "'s 'S ''ll we'll",
    ]
    coder = packing.WordEncoder(path, held=20)
    for _ in range(2):
        ids, ends = coder.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def fits(counts, capacity):
    """Whether some pieces add up to the capacity, by plain search over sums."""
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= capacity}
    return capacity in sums


@pytest.mark.parametrize("counts", [{}, {5: 1}, {3: 7, 4: 2}, {9: 4, 1: 3}, {6: 5, 4: 5, 3: 1}, {7: 9, 2: 2}, {1: 40}, {9: 3, 8: 3, 2: 4, 1: 1}])
def test_plan_places_each_piece_once_and_stops_only_where_nothing_fits(counts):
    spans, sequences, tokens = packing.bin_plan(counts, 10)
    ranks, load, left = Counter(), Counter(), Counter()
    for length, first, last, base, per, offset in spans:
        for rank in range(first, last):
            ranks[length, rank] += 1
            if per:
                load[base + (rank - first) // per] += length
                assert offset + (rank - first) % per * length + length <= 10
            else:
                left[length] += 1
    assert ranks == Counter((length, k) for length, n in counts.items() for k in range(n))
    assert [load[s] for s in range(sequences)] == [10] * sequences
    assert sum(length * n for length, n in left.items()) == tokens
    assert not fits(left, 10)


def test_fill_comes_as_close_as_any_multiset():
    counts = {7: 1, 5: 2, 3: 3}
    for capacity in range(7, 30):
        used, free = packing.fill(counts, sorted(counts), 7, capacity)
        assert sum(k * n for k, n in used.items()) == capacity - free
        assert all(n <= counts[k] for k, n in used.items())
        sums = {7 + 5 * a + 3 * b for a in range(3) for b in range(4)}
        assert capacity - free == max(s for s in sums if s <= capacity)


def test_tail_is_cut_into_powers_of_two():
    assert packing.tail_cuts(3, 4096 + 11, 4096) == [(4096, 4104, 4), (4104, 4106, 5), (4106, 4107, 6)]
    assert packing.tail_cuts(3, 0) == []


def test_many_pieces_of_one_length(spark, path):
    rows = [(k, "one two three " * 500) for k in range(60)] + [(None, "one two three " * 500)] * 3 + [(7, None), (7, ""), (7, "x")]
    made = spark.createDataFrame([(*r, "q", "q", "q") for r in rows], "doc_id long, text string, row string, length string, ids string")
    out = packing.pack(made, path).collect()
    assert all(r["size"] == r["tokens"] for r in out)
    assert sum(r["tokens"] for r in out) == 63 * 1501 + 1 + 1 + 2
    whole = Counter()
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["size"]
        for p in r["pieces"]:
            whole[p["doc"]] += p["length"]
            if p["start"] + p["length"] == p["doc_tokens"]:
                assert ids[p["offset"] + p["length"] - 1] == packing.END
    assert whole[None] == 3 * 1501
    assert whole[7] == 1501 + 4


def test_empty_table(spark, path):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []
