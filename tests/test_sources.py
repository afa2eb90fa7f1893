import os
import tempfile
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from candlework.operators.features import base_table
from candlework.schema import BAR_COLUMNS, BASE_COLUMNS
from candlework.sources import bar_files, wire
from candlework.sources.tables import event_bars

GOOD = "27/04/2015 15:31,1.0,2.0,0.5,1.5,3,10"


def folder_with(files):
    path = tempfile.mkdtemp(prefix="candlework-test-")
    for name, lines in files.items():
        with open(os.path.join(path, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    return path


def test_bar_files(spark):
    path = folder_with(
        {
            "QQX ZZ Share.csv": [
                "NAME,OPEN,HIGH,LOW,LAST,NUMBER,VOLUME",
                GOOD,
                "27/04/2015 15:32,1,2,0.5,1.5,3",
                "27/04/2015 15:33,1,2,0.5,1.5,3,10,11",
                "27/04/2015 15:34,1,2,abc,1.5,3,10",
                "2015-04-27 15:35,1,2,0.5,1.5,3,10",
                "27/04/2015 15:36,1,2,0.5,1.5,3,",
                "27/04/2015 15:37,1,2,0.5,1.5,3,10,,",
            ],
            "X+M 1.csv": [GOOD],
        }
    )
    rows = bar_files.read_bar_files(spark, path).orderBy("stockName", "stockTime").collect()
    assert [r.stockName for r in rows] == ["QQX ZZ Share", "QQX ZZ Share", "X+M 1"]
    assert rows[0].stockTime == datetime(2015, 4, 27, 15, 31) and rows[1].stockTime.minute == 37
    assert list(rows[0].asDict())[2:] == BAR_COLUMNS[2:]
    assert (rows[0].priceOpen, rows[0].high, rows[0].low, rows[0].lastPrice, rows[0].number, rows[0].volume) == (
        1.0, 2.0, 0.5, 1.5, 3.0, 10.0,
    )


def test_wire_record(spark):
    record = "U, 2015-04-27T15:31, 1.0, 2.0, 0.5, 1.5, 3.0, 10.0\n"
    records = spark.createDataFrame([(record,)], "value string")
    bar = wire.parse_wire(records)
    assert tuple(bar.first()) == ("U", datetime(2015, 4, 27, 15, 31), 1.0, 2.0, 0.5, 1.5, 3.0, 10.0)
    assert wire.format_wire(bar).first().value == record
    assert wire.parse_wire(records, parse_time=False).first().stockTime == "2015-04-27T15:31"


def test_wire_record_that_does_not_parse(spark):
    records = spark.createDataFrame([("U, yesterday, 1, 2, 3, 4, 5, 6",), ("U, 2015-04-27T15:31, 1",)], "value string")
    assert wire.parse_wire(records, strict=False).count() == 0
    with pytest.raises(PySparkException):
        wire.parse_wire(records).collect()


def test_replay(spark, make_bars):
    first = make_bars([(1, 1, 1, 1)] * 4, "A", "2020-01-01 09:02:00")
    other = make_bars([(1, 1, 1, 1)] * 20, "B", "2020-01-01 09:00:00")
    rows = wire.replay(other.union(first)).collect()
    assert [(r.stockTime.minute, r.stockName) for r in rows] == [(m, s) for m in (2, 3, 4) for s in "AB"]


def test_base_csv_round_trip(spark, data):
    path = tempfile.mkdtemp(prefix="candlework-test-") + "/base"
    bars = event_bars(spark, data).withColumn("stockTime", F.col("stockTime").cast("timestamp"))
    table = base_table(bars)
    bar_files.write_base_csv(table, path, single_file=True)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 1
    back = bar_files.read_base_csv(spark, path)
    assert back.columns == BASE_COLUMNS and back.count() == table.count()
    assert sorted(map(str, back.select("CCI", "D", "stockTime").collect())) == sorted(
        map(str, table.select("CCI", "D", "stockTime").collect())
    )
    renamed = bar_files.rename_for_analysis(back)
    assert renamed.columns[:2] == ["dateTime", "name"] and "BB_lowerbound" in renamed.columns


def test_labelled_signals(spark):
    path = folder_with({"some_signals.csv": ["2015-04-27 15:31:00,QQX,1.5,1.4,0,1,2,0,0,1,2,0,2"]})
    row = bar_files.read_labelled_signals(spark, path).first()
    assert row._1 == datetime(2015, 4, 27, 15, 31) and row._13 == 2


def test_sweep_is_partitioned(spark):
    path = tempfile.mkdtemp(prefix="candlework-test-") + "/sweep"
    bar_files.write_sweep(spark.createDataFrame([(389, 1.0), (1945, 2.0)], "deployment int, r double"), path)
    assert {f for f in os.listdir(path) if "=" in f} == {"deployment=389", "deployment=1945"}


def test_sort_all(spark):
    t = spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "a int, b int")
    assert [tuple(r) for r in bar_files.sort_all(t).collect()] == [(1, 1), (1, 2), (2, 1)]


def test_filter_and_columns_reach_the_scan(spark, data):
    path = tempfile.mkdtemp(prefix="candlework-test-") + "/bars"
    event_bars(spark, data).write.parquet(path)
    t = base_table(spark.read.parquet(path)).filter(F.col("stockName") == "click").select("stockTime", "CCI")
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(stockName,click)" in plan
    scan = plan[plan.index("ReadSchema") :]
    assert "priceOpen" not in scan and "number" not in scan and "volume" not in scan


def test_bucketed_bars_need_no_shuffle(spark, data):
    path = tempfile.mkdtemp(prefix="candlework-test-") + "/bucketed"
    bars = event_bars(spark, data)
    bar_files.save_bars(bars, "bucketed_bars", 4, path)
    table = base_table(spark.table("bucketed_bars"), hot=None)
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    assert table.count() == bars.count()
    spark.sql("drop table bucketed_bars")
