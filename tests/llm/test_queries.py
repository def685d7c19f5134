from pathlib import Path

import pytest
from oracle import DATA, assert_equal

from lodestar.llm import queries

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_equal(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op2_decontamination", "op6_kd_sharding", "op7_chat_rotation"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
