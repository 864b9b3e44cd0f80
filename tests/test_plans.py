"""Physical plans: no cross joins, pruned scans, filters at the scan."""

import pytest

from gradeflow.plans import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cross_join_and_no_row_udf(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


@pytest.mark.parametrize(
    "name, absent",
    [("annotation_stats", "text:string"), ("eval_summary", "text:string"), ("eval_summary_lines", "l_extendedprice"),
     ("job_totals", "props:string"), ("dashboard", "o_orderpriority")],
)
def test_only_needed_columns_are_read(spark, name, absent):
    schemas = [line for line in plan(spark, name).splitlines() if "ReadSchema" in line]
    assert schemas and not any(absent in line.split("ReadSchema")[1] for line in schemas)


@pytest.mark.parametrize(
    "name, pushed",
    [("scan_incremental", "GreaterThan(ts,2024-01-14T23:59"), ("job_result_page", "EqualTo(user_id,7)"),
     ("select_manual", "EqualTo(toxic,1)")],
)
def test_filters_reach_the_scan(spark, name, pushed):
    assert any(pushed in line for line in plan(spark, name).splitlines() if "PushedFilters" in line)


@pytest.mark.parametrize("name", ["eval_summary_lines", "dup_groups", "high_water"])
def test_summaries_shuffle_once(spark, name):
    assert plan(spark, name).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["first_errors", "dup_keep_latest", "latest_per_job", "nearest_examples"])
def test_first_rows_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["select_random_count", "select_random_percent", "select_percent_lines"])
def test_samples_read_their_table_three_times_at_most(spark, name):
    text = plan(spark, name)
    table = "lineitem" if name == "select_percent_lines" else "documents"
    assert sum(f"/{table}.parquet" in line for line in text.splitlines() if "FileScan" in line) <= 3
