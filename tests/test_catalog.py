import pytest

from findery import catalog
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), SF, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["chunk_anchors", "pipeline_job_states", "batch_status", "batch_identity", "no_result", "latest_order", "events_during_orders", "duplicate_report", "visible_documents", "user_sessions"])
def test_query_equals_sql_where_the_small_tables_say_little(spark, name):
    sf = "/root/testdata/sf0.01"
    df = catalog.QUERIES[name](spark, sf)
    assert df.limit(1).count() == 1
    assert_same(df, sf, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
