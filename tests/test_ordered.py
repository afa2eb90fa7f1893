"""Live features in event time: order, late bars, expiry, and joined indicator streams."""

import tempfile
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlework.operators.features import base_table
from candlework.schema import BASE_COLUMNS
from candlework.sources.tables import event_bars
from candlework.streaming import ordered
from check_queries import differences


def fresh(name):
    return tempfile.mkdtemp(prefix=f"candlework-test-{name}-")


@pytest.fixture(scope="module")
def bars(spark, data):
    b = event_bars(spark, data).withColumn("stockTime", F.col("stockTime").cast("timestamp"))
    few = b.where(F.col("stockName").isin(*[r.stockName for r in b.select("stockName").distinct().orderBy("stockName").limit(3).collect()]))
    few = few.withColumn("hour", F.floor((F.unix_micros("stockTime") - F.lit(b.agg(F.min(F.unix_micros("stockTime"))).first()[0])) / 3_600_000_000))
    with ordered.rocksdb(spark):
        yield few.where("hour < 240").cache()


def write(rows, folder):
    rows.select("stockName", "stockTime", "priceOpen", "high", "low", "lastPrice", "number", "volume").coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def end(spark, bars, hours=24 * 30):
    """A bar of another symbol that moves the watermark on."""
    top = bars.orderBy(F.desc("stockTime")).limit(1)
    return top.withColumn("stockName", F.lit("~end")).withColumn("stockTime", F.col("stockTime") + F.expr(f"interval {hours} hours"))


def drained(spark, bars, src, build):
    stream = spark.readStream.schema(bars.select("stockName", "stockTime", "priceOpen", "high", "low", "lastPrice", "number", "volume").schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, late, cp = fresh("out"), fresh("late"), fresh("cp")
    query = ordered.start_with_side_table(build(stream), cp, out, late)
    query.awaitTermination()
    return spark.read.parquet(out + "/batch=*"), spark.read.parquet(late + "/batch=*"), query.recentProgress


def test_out_of_order_and_late_bars(spark, bars):
    src = fresh("src")
    moved = F.col("hour") + F.pmod(F.xxhash64("stockName", "hour"), F.lit(20))  # arrives up to 19 hours after newer bars
    is_late = (F.col("hour") < 60) & (F.col("hour") % 5 == 3)
    for low in range(0, 280, 70):
        write(bars.where(~is_late & (moved >= low) & (moved < low + 70)), src)
    write(bars.where(is_late), src)
    write(end(spark, bars), src)
    got, late, _ = drained(spark, bars, src, lambda s: ordered.ordered_base_table(s, "96 hours", digits=6))
    want = base_table(bars.where(~is_late).drop("hour"), digits=6).toPandas()
    assert differences(got.select(*BASE_COLUMNS).toPandas(), want) == ""
    lost = bars.where(is_late).select("stockName", "stockTime", "high", "low", "lastPrice", "volume").toPandas()
    assert len(lost) > 5 and differences(late.select("stockName", "stockTime", "high", "low", "lastPrice", "volume").toPandas(), lost) == ""


def test_idle_symbols_expire_and_return_anew(spark, bars):
    src, name = fresh("src"), bars.select("stockName").orderBy("stockName").first()[0]
    one, others = F.col("stockName") == name, F.col("stockName") != name
    first, second = F.col("hour") < 60, F.col("hour") >= 180
    write(bars.where("hour < 60"), src)
    for low in (60, 120):
        write(bars.where(others & (F.col("hour") >= low) & (F.col("hour") < low + 60)), src)
    write(bars.where(others & second), src)
    write(end(spark, bars, 2), src)
    write(bars.where(one & second).withColumn("stockTime", F.col("stockTime") + F.expr("interval 60 hours")), src)
    write(end(spark, bars), src)
    got, _, progress = drained(spark, bars, src, lambda s: ordered.ordered_base_table(s, "3 hours", idle_days=2, digits=6))
    returned = bars.where(one & second).withColumn("stockTime", F.col("stockTime") + F.expr("interval 60 hours"))
    parts = [bars.where(others), bars.where(one & first), returned]
    want = pd.concat([base_table(p.drop("hour"), digits=6).toPandas() for p in parts])
    got = got.where("stockName <> '~end'")  # the second marker releases the first
    assert differences(got.select(*BASE_COLUMNS).toPandas(), want) == ""
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # a list counts as one row: at the end the marker alone has state, its waiting and its released bars
    assert rows[-1] <= 2 < max(rows), rows


def test_joined_indicators_equal_the_base_table_and_state_shrinks(spark, bars):
    src, some = fresh("src"), ("sma", "rsi", "williams_r")
    for low in range(0, 240, 80):
        write(bars.where((F.col("hour") >= low) & (F.col("hour") < low + 80)), src)
    write(end(spark, bars), src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, cp = fresh("out"), fresh("cp")
    joined = ordered.joined_indicators(stream, "5 hours", some, digits=6)
    query = joined.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
    query.awaitTermination()
    got = spark.read.parquet(out)
    want = base_table(bars.drop("hour"), digits=6).select(*got.columns)
    assert differences(got.toPandas(), want.toPandas()) == ""
    progress = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
    joins = [o["numRowsTotal"] for p in progress for o in p if "Join" in o["operatorName"]]
    waiting = [sum(o["numRowsTotal"] for o in p if "Join" not in o["operatorName"]) for p in progress]
    # what is released has been passed by the watermark, so a join keeps no row beyond its batch
    assert joins and not any(joins) and max(waiting) > 0, (joins, waiting)
