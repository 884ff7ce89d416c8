"""Every registered query against its oracle, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import oracle_bag, oracle_connection, spark_bag

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, oracle, name):
    got = spark_bag(contract.queries()[name](spark, SF))
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert sum(got[1].values()) > 0
    else:
        assert got == oracle_bag(oracle, sql)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["author_class", "period", "n"] and df.count() == 4


@pytest.mark.parametrize("name", ["review_keep_first", "unique_works", "link_first_seen", "knn_graph"])
def test_one_shuffle_partition_gives_the_same(spark, oracle, name):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert spark_bag(contract.queries()[name](spark, SF)) == oracle_bag(oracle, contract.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
