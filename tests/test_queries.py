"""Every query of the library against its SQL; those without SQL at least give rows."""

import pytest

from bandseries import catalog
from compare import compare

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, QUERIES[name], ORACLE[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["class", "n_epochs", "n_objects", "g", "r", "i", "z"]


@pytest.mark.parametrize("name", ["adaptive_bins", "gap_fill", "object_split", "roc_curve"])
def test_partitioning_changes_nothing(spark, sf, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(str, QUERIES[name](spark, sf).collect())))
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
