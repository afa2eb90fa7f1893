"""Shuffles of bars are sized by their number, and slices are multiplied after the shuffle."""

from pyspark.sql import functions as F

from candlework.operators.features import base_table
from candlework.operators.history import measure
from candlework.operators.labels import Grid
from candlework.operators.trades import optimal_return
from candlework.plans import queries as q
from candlework.sources import tables

GRID = Grid((100, 200), (100, 300), (1.0, 100.0))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_bars_of_a_partition_are_bounded(spark, data):
    bars, hot = q.line_bars(spark, data, 500)
    assert hot is None
    trades = tables.line_symbols(spark, data).count()
    assert f"{-(-trades // 500)}), REPARTITION_BY_NUM" in plan(bars)
    table = optimal_return(bars, GRID, q.month(), hot)
    assert plan(table).count("Exchange hashpartitioning") == 1  # trades once; no slice is shuffled
    assert same(table, optimal_return(tables.line_bars(spark, data), GRID, q.month(), None))


def test_hot_symbols_are_dealt_by_their_number(spark, data, monkeypatch):
    from candlework.operators import history

    monkeypatch.setattr(history, "BARS_PER_PARTITION", 500)
    monkeypatch.setattr(history.parts_for, "__defaults__", (500,))
    bars = tables.line_bars(spark, data)
    hot = measure(tables.line_symbols(spark, data), 100)
    assert hot is not None and hot.parts == -(-tables.line_symbols(spark, data).count() // 500)
    found = optimal_return(bars, GRID, q.month(), hot)
    slices = plan(found)
    assert "hashpartitioning(stockName" in slices and "deployment#" not in "".join(x for x in slices.splitlines() if "Exchange" in x)
    assert same(found, optimal_return(bars, GRID, q.month(), None))
    assert same(base_table(bars, hot, 6), base_table(bars, None, 6))


def test_many_hot_symbols_are_stored_not_collected(spark, data, monkeypatch):
    from candlework.operators import history

    monkeypatch.setattr(history, "MAX_BROADCAST_SYMBOLS", 2)
    symbols = tables.line_symbols(spark, data)
    hot = measure(symbols, 100)
    assert not hot.broadcastable and hot.table.inputFiles()
    assert hot.table.count() == symbols.groupBy("stockName").count().where(F.col("count") > 100).count() > 2


def test_each_bar_line_is_cut_once(spark):
    from datetime import datetime

    from candlework.sources.bar_files import parse_bar_lines

    good = "02/01/2020 09:30,1,2.5,0.5,1.5,3,10"
    values = [good, good + ",,", good + ",x", "NAME" + good, good[:-3], "02/13/2020 09:30" + good[16:], good.replace("2.5", "NaN"), "", None]
    bars = parse_bar_lines(spark.createDataFrame([("A", v) for v in values], "stockName string, value string"))
    assert plan(bars).count("split(") == 1
    assert [tuple(r) for r in bars.collect()] == [("A", datetime(2020, 1, 2, 9, 30), 1.0, 2.5, 0.5, 1.5, 3.0, 10.0)] * 2
