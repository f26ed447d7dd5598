"""Texts that a plain polynomial hash takes for one another, and hashes that are all equal."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bandseries.llm import neardup, quality, textnum, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


SIZES = [512, 1024, 2048, 4096, 8192]


def plain_counts(t):
    w = WORD.findall(t)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x, n in Counter(runs).items() if n > 1}
    covered = {i + k for i, x in enumerate(runs) if x in twice for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return dup, len(covered)


def texts_for_counts():
    out = []
    for n in SIZES:
        x, y = thue_morse(n)
        out += [f"{x}\n{y}", f"{x}\n{y}\n{x}", f"c d {x} e f g c d {y} e f g", f"c d {x} e f g c d {x} e f g c d {y} e f", f"{x} {x} {x} {x} {x} {y} {y} {y} {y} {y} {x} {x} {x} {x} {x}"]
    return [*out, "a b c\na b c\n\n\na b", "", "one two three four five six one two three four five", "aaaaaaaa bbbbbbbb\naaaaaaaa bbbbbbbb\naaaaaaaa cbbbbbbb"]


@pytest.mark.parametrize("one_hash", [False, True])
def test_lines_and_windows_are_compared_as_they_are(monkeypatch, one_hash):
    if one_hash:
        real = textnum.Hasher.__call__
        monkeypatch.setattr(textnum.Hasher, "__call__", lambda self, a, z: np.where(z - a > 7, np.uint64(5), real(self, a, z)))
    texts = texts_for_counts()
    got = quality.text_counts(pa.array(texts))
    assert list(zip(got["n_dup_lines"].tolist(), got["n_repeat_words"].tolist(), strict=True)) == [plain_counts(t) for t in texts]


@pytest.mark.parametrize("one_hash", [False, True])
def test_chunks_are_compared_as_they_are(monkeypatch, one_hash):
    import public_tokenizers

    if one_hash:
        real = textnum.Hasher.__call__
        monkeypatch.setattr(textnum.Hasher, "__call__", lambda self, a, z: np.where(z - a > 7, np.uint64(5), real(self, a, z)))
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = [" ".join(p) for n in SIZES for x, y in [thue_morse(n)] for p in ((x, y), (y, x), (y,), (x,))] + ["somewhere elsewhere somewhere", "elsewhere anywhere"]
    for _ in range(2):
        for t in texts:
            assert coder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
        assert coder.encode("\n".join(texts)).tolist() == library.encode("\n".join(texts), add_special_tokens=False).ids


def test_unlike_texts_are_not_linked(spark):
    rows = []
    for k, n in enumerate(SIZES):
        x, y = thue_morse(n)
        rows += [(2 * k, x), (2 * k + 1, y), (100 + 2 * k, f"{x} {x} {x} {x} {x} {x}"), (101 + 2 * k, f"{y} {y} {y} {y} {y} {y}")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["class_id"] for r in out)


def test_short_ranges_have_hashes_of_their_own():
    r = np.random.default_rng(1)
    data = np.concatenate((r.integers(0, 3, 4000).astype(np.uint8), np.zeros(40, np.uint8)))
    start, n = np.arange(4000).repeat(12), np.tile(np.arange(12), 4000)
    got = textnum.Hasher(data)(start, start + n)
    names = [data[a : a + k].tobytes() for a, k in zip(start.tolist(), n.tolist(), strict=True)]
    assert len(set(zip(names, got.tolist(), strict=True))) == len(set(names)) == len(set(got.tolist()))


def test_alike():
    a, b = np.frombuffer(b"one two one", np.uint8), np.frombuffer(b"two one onx", np.uint8)
    s = np.array
    assert textnum.alike((a, s([0, 4, 8, 0, 0]), s([3, 3, 3, 0, 2])), (b, s([4, 0, 8, 3, 4]), s([3, 3, 3, 0, 3]))).tolist() == [True, True, False, True, False]


def test_words_are_learnt_once_whatever_marks_follow():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), tokens.Encoder(path)
    marks = ["", ".", ",", "###", "***", "&&&", ".%%%", ",$$$"]
    text = " ".join(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}{m}" for k in range(100) for m in marks)
    assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.n < 120  # a hundred words and the marks; by words with their marks these were 800


def test_chunks_cut_between_kinds_have_the_ids_of_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), tokens.Encoder(path)
    parts = ["a", "the", "Été", "ß", "÷", "×", "é", "7", "2024", "'", "'s", "'ll", "'", ".", "!!", "€", "Жз", "ª", "²", "é", " ", " ", "\n", "  ", "\t", " ", "\x00", "\x01", "\r\n", "\U0001f600", "中"]
    rng = np.random.default_rng(5)
    for _ in range(3000):
        text = "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 12)))
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_grammar_takes_a_bounded_number_of_bytes_an_id():
    import tracemalloc

    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 1 << 20), 40_000).astype(np.uint32)
    tracemalloc.start()
    try:
        seq, rules = tokens.re_pair(ids)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (tokens.decode(seq, rules, tokens.expansions(rules)) == ids).all()
    assert peak < 76 * len(ids)


def test_chunks_met_again_outlast_a_full_table(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder, learnt = Tokenizer.from_file(path), tokens.Encoder(path, held=200), []
    learn = coder.learn
    monkeypatch.setattr(coder, "learn", lambda data, start, end: learnt.append(len(start)) or learn(data, start, end))
    letters = "abcdefghij"
    for turn in range(40):
        words = [f"common{letters[k % 10]}{letters[k // 10]}ofallthetexts" for k in range(20)]
        words += [f"new{letters[k % 10]}{letters[k // 10]}in{letters[turn % 10]}{letters[turn // 10]}" for k in range(30)]
        text = " ".join(["x", *words])
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.n <= 200
    assert sum(learnt) == 1 + 20 + 40 * 30


def test_decoding_takes_a_bounded_number_of_bytes_an_id():
    import tracemalloc

    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 1 << 20), 40_000).astype(np.uint32)
    seq, rules = tokens.re_pair(ids)
    length = tokens.expansions(rules)
    tracemalloc.start()
    try:
        got = tokens.decode(seq, rules, length)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (got == ids).all()
    assert peak < 24 * len(ids)
