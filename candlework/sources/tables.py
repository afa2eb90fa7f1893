"""Bars built from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.functions.columns import ratio, rnd
from candlework.operators.history import HotSymbols, dealt, with_segments

SESSION_MINUTES = 390


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type. Combines map-side, so a hot type shrinks before the shuffle."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return (
        events.groupBy(
            F.col("event_type").alias("stockName"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("stockTime"),
        )
        .agg(
            F.min_by("value", "ts").alias("priceOpen"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "ts").alias("lastPrice"),
            F.count("*").cast("double").alias("number"),
            F.sum("value").alias("volume"),
        )
        .withColumn("volume", rnd("volume", 2))
    )


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    minute = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % SESSION_MINUTES
    return items.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("stockName"),
        (F.col("l_shipdate") + F.make_dt_interval(mins=minute.cast("int"))).alias("stockTime"),
        ratio(F.col("l_extendedprice"), F.col("l_quantity")),
        "l_tax",
        "l_discount",
        "l_quantity",
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + F.col("l_partkey") % 1000).alias("seq"),
    ).toDF("stockName", "stockTime", "raw", "l_tax", "l_discount", "l_quantity", "seq")


def line_bars(spark: SparkSession, sf_dir: str, parts: int = 1, by: tuple[str, ...] = ("stockName",), hot: HotSymbols | None = None) -> DataFrame:
    """Minute bars per supplier: every line item is a trade in one minute of its ship date.

    Trades of one minute follow the order key, line number (at most seven) and part, packed
    into one long, which keeps the aggregate hash-based. With ``parts`` the trades are shuffled by symbol into so many
    partitions; windows over symbols then need no shuffle of their own. With hot symbols they go ``by`` symbol and time, or if
    those are given by symbol and ``segment``, which the bars then keep.
    """
    trades, keys = _trades(spark, sf_dir), ["stockName", "stockTime"]
    if hot is not None:
        trades, parts, by, keys = with_segments(trades, hot), hot.parts, ("stockName", "segment"), [*keys, "segment"]
    trades = (
        dealt(trades, parts, *by)
        .withColumn("price", rnd("raw", 2))
        .withColumn("high", rnd(F.col("price") * (1 + F.col("l_tax")), 2))
        .withColumn("low", rnd(F.col("price") * (1 - F.col("l_discount")), 2))
    )
    return trades.groupBy(*keys).agg(
        F.min_by("price", "seq").alias("priceOpen"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("price", "seq").alias("lastPrice"),
        F.count("*").cast("double").alias("number"),
        F.sum("l_quantity").alias("volume"),
    )


def line_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol and time of every trade: an upper bound of the bars per symbol, read cheaply."""
    return _trades(spark, sf_dir).select("stockName", "stockTime")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per order priority, with the undefined cases the other two lack.

    The price stands still in the first three months of a year, nothing is traded in volume from March to May, and a
    day with one order has no range.
    """
    month = F.month("o_orderdate")
    price = F.when(month <= 3, 100.0).otherwise(F.floor(F.col("o_totalprice") / 1000).cast("double"))
    size = F.when(month.between(3, 5), 0.0).otherwise((F.col("o_orderkey") % 100 + 1).cast("double"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderpriority").alias("stockName"),
        F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("stockTime"),
        price.alias("price"), size.alias("size"), "o_orderkey",
    )
    return orders.groupBy("stockName", "stockTime").agg(
        F.min_by("price", "o_orderkey").alias("priceOpen"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "o_orderkey").alias("lastPrice"),
        F.count("*").cast("double").alias("number"),
        F.sum("size").alias("volume"),
    )
