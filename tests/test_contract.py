"""Registered queries against their SQL counterparts on the smallest tables, and plan shapes."""
import duckdb
import pytest

import __spark_entry__ as contract
import check
from stillvalid.plans.monitor import monitor
from stillvalid.plans.specs import EVENTS, LINES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["l4_window_risk", "t2_time_to_violation", "t6_history_and_anchor",
                                  "m8_kaplan_meier", "s26_feedback", "s23_stability_index",
                                  "r2_tumbling_risk", "r7_alarms", "x5_prior"])
def test_query_equals_sql(spark, con, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(contract.oracle_sql()[name]).fetchdf()
    assert check.normal_form(got) == check.normal_form(want)


def test_flagship(spark):
    out = contract.entry(spark)
    assert out.count() == 48 and out.filter("event = 1").count() == 40


def test_every_sql_has_a_query():
    from oracles import SQL

    assert set(SQL) <= set(contract.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_risk_reads_two_columns_and_prunes_segments(spark):
    m = monitor(spark, FOLDER, EVENTS)
    text = plan(m.deployment.groupBy("stream_id", "window_idx").avg("loss"))
    assert "PartitionFilters: [isnotnull(segment" in text
    assert "ReadSchema: struct<stream_id:string,window_idx:bigint,loss:double>" in text


def test_no_nested_loop_or_single_partition_sort_in_the_core(spark):
    from stillvalid.operators import targets

    m = monitor(spark, FOLDER, EVENTS)
    text = plan(targets.censored_targets(m.risk, m.eps, 20))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "SinglePartition" not in text
