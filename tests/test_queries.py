"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_small):
    return connect(sf_small)


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_small, name):
    verdict = compare(spark, duck, name, QUERIES[name], SQL.get(name), sf_small)
    assert verdict.startswith("ok") or (name not in SQL and verdict.startswith("ROWS")), verdict


def test_entry_has_rows(spark):
    result = entry.entry(spark)
    assert result.columns == ["query_id", "cluster_label", "era_no", "period", "rank_in_era", "year", "score", "arxiv_id"]
    assert result.count() > 0
