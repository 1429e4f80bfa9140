"""Every registered query against its DuckDB SQL on the same Parquet tables."""

import pytest

from tests.conftest import SF001
from tools.compare import compare, duck

from tessera.plans.oracle import ORACLE_SQL
from tessera.plans.queries import QUERIES

from __spark_entry__ import oracle_sql, queries

NAMES = sorted(QUERIES)            # the corpus queries have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_oracle_sql():
    missing = sorted(set(QUERIES) - set(ORACLE_SQL))
    assert missing == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    msg, ok = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF001)
    assert ok, msg


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["vec_id", "label", "prediction"]
    assert df.count() > 0
