"""Every query of the core on the smallest tables: against its SQL, or rows only."""

import pytest
from oracle import compare, connect

from loomflow import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert {"p2_found", "p3_found", "p5_found", "p6_found", "p7_found"} <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        compare(df, con, SQL[name])
    else:
        assert df.count() >= 0


FOUND = {
    "p2_found": [("dag", "string"), ("eventtype", "string")],
    "p3_found": [("log_id", "string"), ("first_line", "int"), ("last_line", "int"), ("ts_ms", "bigint"), ("log_level", "string"), ("component", "string")],
    "p5_found": [("field_name", "string"), ("row_key", "string"), ("pos", "int"), ("item", "string")],
    "p6_found": [("container_id", "string"), ("kind", "string"), ("from_ms", "bigint"), ("to_ms", "bigint")],
    "p7_found": [("key_field", "string"), ("key_value", "string")],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_columns(spark, small, name):
    assert QUERIES[name](spark, small).dtypes == FOUND[name]


def test_entry(spark, small):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["word", "cnt"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, small, plan):
    text = plan(QUERIES["hash_join_semi"](spark, small))
    assert "PushedFilters: [IsNotNull(o_orderpriority)" in text or "EqualTo(o_orderpriority" in text
    assert "l_extendedprice" not in text.split("== Physical Plan ==")[1]
