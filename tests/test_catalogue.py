from pathlib import Path

import pytest
from oracle import DATA, assert_equal

from lodestar.plans import catalogue

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
SLOW = {"store_roundtrip", "stream_seal"}


@pytest.mark.parametrize("name", [n for n in catalogue.ORACLE_SQL if n not in SLOW])
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_equal(spark, catalogue.QUERIES_BY_NAME[name], catalogue.ORACLE_SQL[name])


def test_filter_and_columns_reach_the_scan(spark):
    plan = catalogue.knn_filtered(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan
    plan = catalogue.vector_norms(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "exact_knn_l2" in entry.queries()
