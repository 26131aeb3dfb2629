"""Registered queries: oracle coverage, results on the smallest data, and plan shape."""

import os
import re

import pytest

import __spark_entry__ as entry
from packetmill.plans import catalog
from tools import check_oracle

SF = "/root/testdata/sf0.001"
# Without an exact SQL text: results of trained models.
ROWS_ONLY = {"l06_soft_vote", "l07_isolation_forest", "l08_batch_scoring", "l09_legacy_classify",
             "l10_model_comparison", "l11_training_run", "o04_feature_importance", "o06_best_model", "s10_artifacts"}
# A spread over all modules; PACKETMILL_ALL_ORACLES=1 compares every query.
QUICK = ["w00_flow_records", "w02_arrival_clock", "j11_next_packet", "p01_flatten_types", "a14_feature_psi",
         "a03_kpis", "m01_dispatch_plan", "m04_expiry", "t05_dispatch_loop", "d02_drift_job", "s06_alert_rows", "p15_explanation", "a09_class_metrics", "o05_mutual_information"]


def chosen():
    return sorted(catalog.oracle_sql()) if os.environ.get("PACKETMILL_ALL_ORACLES") else QUICK


def test_every_query_has_an_oracle_or_is_listed():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == ROWS_ONLY
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in check_oracle.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", chosen())
def test_oracle(spark, duck, name):
    ok, text = check_oracle.compare(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


@pytest.mark.parametrize("name", ["w00_flow_records", "m01_dispatch_plan", "p01_flatten_types", "a05_hourly_timeline"])
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_flow_windows_are_partitioned(spark):
    plan = entry.queries()["w00_flow_records"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_timeline_reads_only_its_columns(spark):
    plan = entry.queries()["a05_hourly_timeline"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "props" not in schema and "value" not in schema and "PushedFilters: [" in plan
