"""Scale properties of the physical plans, checked on the smallest tables."""

import re

import pytest

from crawlgrid.plans.registry import QUERIES, load_all

SF = "/root/testdata/sf0.001"
load_all()
# L11 reads sorted logins one after the other in Python, plugins (D5) and package files (S5) are read by Python; streams and writers run on call; their plans are covered by the operators they reuse
BATCH = sorted(n for n in QUERIES if not n.startswith(("X", "S1", "S2", "S3", "W1", "W2", "W3_restore_catalog", "L11", "D5_plugin_execute", "S5_package_files", "I1_log_facts_of_files")))
BAD = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
       "FlatMapGroupsInPandas", "MapInPandas"]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_product_join_or_python(spark, name):
    p = plan(spark, name)
    assert not [b for b in BAD if b in p], name


def test_purge_rank_is_limited_before_the_shuffle(spark):
    p = plan(spark, "T1_history_to_purge")
    assert p.count("WindowGroupLimit") >= 2      # partial (map side) and final


def test_scans_are_pruned_and_filtered(spark):
    df = QUERIES["T3_last_run_per_spider"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    orders = [m for m in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "o_orderkey" in m]
    assert orders and all("o_totalprice" not in m and "o_orderpriority" not in m for m in orders)
    assert "EqualTo(o_orderstatus,F)" in text
