"""The subpackage's queries on the smallest tables: against their SQL, or rows only."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import compare, connect  # noqa: E402

from loomflow.llm import queries as module  # noqa: E402

QUERIES, SQL = module.queries(), module.oracle_sql()

FOUND = {
    "p1_found": [("vertex_name", "string")],
    "p4_found": [("dag_id", "string"), ("vertex_name", "string"), ("rank_no", "int"), ("task_attempt_id", "string")],
    "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p9_found": [("source", "string")],
    "p10_found": [("doc_id", "bigint")],
}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in FOUND:
        assert df.dtypes == FOUND[name]
    if name in SQL:
        compare(df, con, SQL[name])
    else:
        assert df.count() >= 0


def test_percentiles_near_exact_ones(spark, small):
    exact = module.attempt_values(spark, small).groupBy("vertex_name").agg(*[module.F.expr(f"percentile_disc({q}) within group (order by time_taken)").alias(n) for n, q in module.SHARES.items()])
    got = {r["vertex_name"]: r for r in module.p1_percentiles(spark, small).collect()}
    days = {r["vertex_name"]: r for r in module.p1_from_days(spark, small).collect()}
    rows = exact.collect()
    assert len(rows) == len(got) == len(days)
    for r in rows:  # groups this small are exact
        assert all(got[r["vertex_name"]][n] == days[r["vertex_name"]][n] == r[n] for n in module.SHARES)
