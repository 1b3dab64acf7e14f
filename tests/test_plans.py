"""Physical plans: nothing funnels rows through one task, leaves the JVM or crosses tables."""

import re

import pytest

from loadscope.catalog import ORACLES, QUERIES
from loadscope.operators import serving

# Inputs of a single-partition exchange that are bounded: partial aggregates, one
# row per piece of an ordered table, top-n of a table capped before.
_BOUNDED = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "WindowGroupLimit")


def plan_lines(spark, sf_dir, name):
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if line.strip(" :+-")]


def operator(line):
    return re.sub(r"^[\s:+\-*()\d]*", "", line)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, sf_dir, name):
    lines = [operator(x) for x in plan_lines(spark, sf_dir, name)]
    text = "\n".join(lines)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name in ORACLES:
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|InPandas|InArrow", text)
    for here, line in enumerate(lines):
        if line.startswith("Exchange SinglePartition"):
            below = next(x for x in lines[here + 1 :] if not x.startswith(("Project", "Filter", "Sort [")))
            assert below.startswith(_BOUNDED), below


def scan_columns(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>\n?", text)]


@pytest.mark.parametrize(
    "name,column", [("serving_throughput", "max_batch_size"), ("arrival_rate_histogram", "value"), ("step_ft_throughput", "props")]
)
def test_scans_are_pruned(spark, sf_dir, name, column):
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in text and all(column not in cols for cols in scan_columns(text))


def test_filters_reach_the_scan(spark, tmp_path):
    schema = "request_guid bigint, is_warmup_request int, decoding_step_idx int, timestamp_us bigint"
    spark.createDataFrame([(1, 0, 0, 5)], schema).write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    text = serving.throughput(log)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_warmup_request,0)" in text and "GreaterThanOrEqual(decoding_step_idx,0)" in text
