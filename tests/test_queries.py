"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, SF, name, queries()[name], oracle_sql()[name]) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["kind", "name", "metric", "count", "min", *["p10", "p25", "p50", "p75", "p90", "p99"], "max", "mean", "sum"]
    assert df.count() > 0


def test_only_brute_force_queries_lack_sql():
    # the training-data queries, where they are there, have brute-force tests of their own
    without = {n for n in set(queries()) - set(oracle_sql()) if not re.match(r"op\d+_|pipeline$", n)}
    assert without == set()
