import duckdb
import pytest

import __spark_entry__ as entry
import check_queries

SF = "/root/testdata/sf0.001"
FAST = ["bm25_topk", "vector_topk", "chat_reconcile", "state_versions", "batch_ranges", "identity_resolution", "calendar_proximity"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_queries.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_its_sql():
    own = entry._load()
    assert set(own.SQL) == set(own.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    message, _, good = check_queries.compare(spark, con, name, SF)
    assert good, message


def test_flagship_entry(spark):
    assert entry.entry(spark).count() > 0
