"""What a physical plan holds: for tests that a plan stays the one that was meant."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

_NODES = "Exchange|BroadcastExchange|HashAggregate|ObjectHashAggregate|SortAggregate|SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|CartesianProduct|BroadcastNestedLoopJoin|TakeOrderedAndProject|Window|WindowGroupLimit|Sort|Generate|MapInArrow|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython"


def operators(df: DataFrame) -> Counter:
    """How often each operator stands in the plan before adaptive changes."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter(m for m in re.findall(rf"(?<![A-Za-z])({_NODES})(?![A-Za-z])", plan))


def scan_facts(df: DataFrame) -> tuple[list[str], list[str]]:
    """The pushed filters and the columns read, of all Parquet scans."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = [x for group in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) for x in group.split(", ") if x]
    read = [x.split(":")[0] for group in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for x in group.split(",") if x]
    return pushed, read
