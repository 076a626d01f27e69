import os

import pytest

from graphloom.operators import adhoc
from graphloom.plans import registry, tools, views

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_ad_hoc_sql_over_the_graph(spark):
    assert "calls" in views.register(spark, DATA)
    got = adhoc.ask(spark, "SELECT src, count(*) AS n FROM calls GROUP BY src ORDER BY n DESC, src", 3)
    assert len(got.rows) == 3 and got.truncated
    one = tools.call(spark, DATA, "get_program", got.rows[0][0]).collect()
    assert len(one) == 1 and one[0].callees.count(",") == got.rows[0][1] - 1
    assert tools.run_named(spark, DATA, "nq15_all_calls", 2).count() == 2


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.queries()["nq11_text_search"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,n_chars:bigint>" in plan
    plan = registry.queries()["nq07_programs_using_copybook"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "risk_score" not in plan


def test_every_core_query_has_a_stable_schema(spark):
    for name in ("lst01_programs", "agg17_validation", "joi01_shared_files", "txt44_tagged_gaps"):
        df = registry.queries()[name](spark, DATA)
        assert df.columns and df.count() >= 0
