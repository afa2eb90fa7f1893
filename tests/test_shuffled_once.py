"""Forms of the base table that shuffle all bars once."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from candlework.operators.features import base_table, base_table_by_joins
from candlework.operators.history import HotSymbols, measure, overlap
from candlework.schema import BAR_SCHEMA
from candlework.session import joining_dealt


@pytest.fixture(scope="module")
def rows():
    """Bars of four symbols, one without a name and one with a bar without a time."""
    rng = np.random.default_rng(2)
    found = []
    for s, size in enumerate((400, 260, 90, 30)):
        for i in range(size):
            low, last, high = sorted(rng.integers(1, 900, 3) / 8)
            time = None if s == 2 and i == 0 else datetime(2020, 1, 1) + timedelta(hours=13 * i)
            found.append((None if s == 3 else f"S{s}", time, float(last), float(high), float(low), float(last), 1.0, float(rng.integers(0, 50))))
    return found


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_branches_join_where_they_are(spark, rows):
    own = joining_dealt(spark)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    bars = own.createDataFrame(rows, BAR_SCHEMA).repartition(3, "stockName")
    table = base_table_by_joins(bars, None, 6)
    plan = plan_of(table)
    assert plan.count("SortMergeJoin") >= 7 and "hashpartitioning(stockTime" not in plan
    assert all("hashpartitioning(stockName#" in line for line in plan.split("Initial Plan")[-1].splitlines() if "Exchange" in line)
    # an inner join has no rows without name or time
    assert same(table, base_table(bars, None, 6).where("stockName is not null and stockTime is not null")) and table.count() == 749


def test_segments_and_their_copies_meet_without_a_shuffle_of_all(spark, rows):
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    hot = measure(bars, 50)
    hot = HotSymbols(hot.table, hot.broadcastable, 3)
    above, _, below = plan_of(base_table(bars, hot, 6)).split("Initial Plan")[-1].partition("Union")
    assert below and "Exchange" not in above
    assert same(base_table(bars, hot, 6), base_table(bars, None, 6)) and base_table(bars, hot, 6).count() == 780
    assert overlap(bars, hot, 21).columns == [*bars.columns, "segment", "_before"]
