"""Physical plans of the registered queries: no pair-building joins, pushed filters."""

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as contract
from tarnwork.workload import QUERIES

# These write tables or train models when they are built; their parts are covered elsewhere.
EAGER = re.compile(r"^(stream_|sink_|rf_|ml_run|model_gate|ddl_|csv_|materialize_incremental|label_encode)")
LAZY = sorted(n for n in QUERIES if not EAGER.match(n))


def plan_text(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_no_python_no_forced_broadcast(spark, sf, name):
    text = plan_text(contract.queries()[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text, text


def test_filter_reaches_the_scan(spark, sf):
    text = plan_text(contract.queries()["retention_filter"](spark, sf))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,", text)
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>", text)


def test_old_days_are_not_opened(spark, sf):
    text = plan_text(contract.queries()["retention_partitions"](spark, sf))
    assert re.search(r"PartitionFilters: \[isnotnull\(event_date#\d+\), \(event_date#\d+ >= 2024-01-23\)\]", text)


def test_only_needed_columns_are_read(spark, sf):
    text = plan_text(contract.queries()["daily_order_totals"](spark, sf))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_hot_keys_are_sliced(spark, sf):
    """No window over the entity key alone sees the rows themselves."""
    text = plan_text(contract.queries()["pit_features"](spark, sf))
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", text)
    assert any("__key" in k and "__slice" in k for k in keys)


# Exchanges in the plan before AQE; lookups that are broadcast by size do not count.
EXCHANGES = {
    "contract_columns": 0,
    "governance_lookup": 0,
    "log_fields": 0,
    "json_decode_valid": 0,
    "grants_active": 0,
    "tumble_1m": 1,
    "log_rate_by_level": 1,
    "current_step": 1,
    "materialize_latest": 1,
    "status_class_rate": 1,
    "latency_avg": 2,  # samples to label sets, label sets to rule levels
    "counter_rate": 2,  # samples by (series, slice), slices by series
    "access_decision": 3,  # slices of pairs, pairs, rows
    "hist_q99": 4,  # samples, rule levels, bounds, windows
}


@pytest.mark.parametrize("name", sorted(EXCHANGES))
def test_number_of_exchanges(spark, sf, name):
    df = contract.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Round|Single)", plan)) == EXCHANGES[name], plan


def test_as_of_join_reads_each_source_once(spark, sf):
    """Facts and probes are scanned once each and cross one exchange, which the carried state uses again."""
    df = contract.queries()["pit_features"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[o_orderkey", plan)) == 2
    assert len(re.findall(r"- Exchange hashpartitioning\(__key#\d+, __slice#\d+L, \d+\), REPARTITION", plan)) == 1
    assert "ReusedExchange" in plan
