"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest

from bandseries.llm import decontaminate, mixing, neardup, periods, pii, quality, secrets, sharding, tokens, urls, warc

LONG = "many words of one very long text " * 20_000

DOCS = [
    (1, "a b c d e f g h i j k l", "en", "s"),
    (1, "a b c d e f g h i j k l", "en", "s"),
    (2, "a b c d e f g h i j k l", None, None),
    (3, None, "en", "s"),
    (4, "", None, "s"),
    (5, " \n\t ", "en", None),
    (None, "token = abcdef0123456789abcdef0123456789 x y z", "en", "s"),
    (None, None, None, None),
    (6, LONG, "en", "s"),
    (7, "a b c d e f g h i j k l", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = "key string, hash string, size string, bucket string, salt string, row string, label string, words string, start string, _doc string, rank string"


@pytest.fixture(scope="module")
def odd(spark):
    extra = EXTRA.count(",") + 1
    return spark.createDataFrame([r + ("x",) * extra for r in DOCS], f"{SCHEMA}, {EXTRA}")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {EXTRA}")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "c d e f", "x"), (None, "i j k l", "x"), (2, None, "x"), (3, "", "x"), (1, "c d e f", "x")], "item_id long, text string, words string")


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


OPERATORS = {
    "mix": lambda d, i: mixing.mix(d),
    "secrets": lambda d, i: secrets.scan_secrets(d, vocabulary()),
    "neardup": lambda d, i: neardup.near_duplicates(d),
    "quality": lambda d, i: quality.judge(d),
    "pii": lambda d, i: pii.pseudonymise(d, "k"),
    "decontaminate": lambda d, i: decontaminate.contamination(d, i),
    "sharding": lambda d, i: sharding.lpt_shards(d),
    "tokens": lambda d, i: tokens.tokens_of(d),
    "periods": lambda d, i: periods.periodic_runs(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(odd, items, name):
    out = OPERATORS[name](odd, items)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect())
    assert ids == sorted((r[0] is None, r[0] or 0) for r in DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(none, items, name):
    assert OPERATORS[name](none, items).collect() == []


def test_no_items(odd, spark):
    out = decontaminate.contamination(odd, spark.createDataFrame([], "item_id long, text string"))
    assert {r["n_hit"] for r in out.collect()} == {0}


def test_stages_keep_columns(spark, odd, none):
    for stage in (quality.quality_stage, neardup.dedup_stage, mixing.mixing_stage, decontaminate.decontamination_stage):
        assert stage(spark, odd, "/root/testdata/sf0.001").columns == odd.columns
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0


def test_near_duplicate_values(odd):
    rows = [(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(odd).collect()]
    assert sorted(r for r in rows if r[0] in (1, 2, 7)) == [(1, 1), (1, 1), (2, 1), (7, 1)]
    assert all(d == c for d, c in rows if d in (3, 4, 5, 6))


def test_dedup_judges_each_text_of_an_id(spark):
    copied, own, other, third = (" ".join(f"{w}{k}" for k in range(12)) for w in "abcd")
    rows = [(1, copied), (None, copied), (None, own), (None, None), (2, copied), (2, other), (2, other), (3, third), (4, third)]
    kept = neardup.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(1, copied), (None, own), (None, None), (2, other), (2, other), (3, third)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_contamination_values(odd, items):
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(odd, items).collect()}
    assert got[1, 12] == (8, 2, True)
    assert got[3, 0] == (0, 0, False)


def test_urls_and_warc(spark):
    big = "é" * 700
    rows = [(1, "http://A.com/x", big), (2, None, big), (3, "no scheme", None), (None, "http://b.net/fr/y?z", big), (4, "", ""), (4, "", ""), (5, "HTTP://x.org", "short"), (6, "http://y.org", "short")]
    pages = spark.createDataFrame([(*r, "q", "q", "q") for r in rows], "page_id long, url string, html string, host string, path string, digest string")
    judged = urls.judge_urls(pages, spark.createDataFrame([("word", 3)], "word string, n long")).collect()
    assert len(judged) == len(rows)
    assert {r["host"] for r in judged if r["page_id"] in (2, 3, 4)} == {""}
    path = warc.scratch(spark, "odd")
    warc.write_warc(pages, path)
    back = sorted(warc.read_warc(spark, path, 100).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["record_type"]))
    assert len(back) == len(rows)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back}
    assert kinds[1] == ("revisit", 2, 1400)
    assert kinds[2] == ("response", None, 1400)
    assert kinds[None] == ("revisit", 2, 1400)
    assert kinds[5] == kinds[6] == ("response", None, 5)
    empty = warc.scratch(spark, "none")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame([], "word string, n long")).count() == 0
