"""The wire record: one comma-separated line per bar, and its stream sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIRE_TIME = "yyyy-MM-dd'T'HH:mm"  # fixed value: the time format of a record
_NUMBERS = ["priceOpen", "high", "low", "lastPrice", "number", "volume"]


def _part(i: int) -> Column:
    # fields carry a leading blank, and the last one the newline
    return F.trim(F.regexp_replace(F.get("_parts", F.lit(i)), "\\s+$", ""))


def parse_wire(records: DataFrame, parse_time: bool = True, strict: bool = True) -> DataFrame:
    """Bars from a string column ``value``. Works on batch and streaming DataFrames.

    With ``parse_time`` off the time stays the string that was sent. A record that does not
    parse fails the query; with ``strict`` off such records are dropped.
    """
    time = F.try_to_timestamp(_part(1), F.lit(WIRE_TIME)) if parse_time else _part(1)
    if strict and parse_time:
        time = F.to_timestamp(_part(1), WIRE_TIME)
    numbers = [(_part(i + 2).cast if strict else _part(i + 2).try_cast)("double").alias(n) for i, n in enumerate(_NUMBERS)]
    parts = records.select(F.split(F.col("value").cast("string"), ",").alias("_parts"))
    bars = parts.select(_part(0).alias("stockName"), time.alias("stockTime"), *numbers)
    return bars if strict else bars.dropna("any")


def format_wire(bars: DataFrame) -> DataFrame:
    """Bars as records in a column ``value``, with a trailing newline."""
    record = F.concat_ws(
        ", ",
        "stockName",
        F.date_format("stockTime", WIRE_TIME),
        *[F.col(n).cast("string") for n in _NUMBERS],
    )
    return bars.select(F.concat(record, F.lit("\n")).alias("value"))


def replay(bars: DataFrame) -> DataFrame:
    """Bars of all symbols from the first symbol's first bar until just before its last one,
    ordered by minute, then symbol. The bounds are one row, read by one scalar subquery."""
    spans = bars.groupBy("stockName").agg(F.struct(F.min("stockTime").alias("lo"), F.max("stockTime").alias("hi")).alias("s"))
    first = spans.agg(F.min_by("s", "stockName").alias("s"))
    bounds = first.scalar()
    return bars.filter((F.col("stockTime") >= bounds["lo"]) & (F.col("stockTime") < bounds["hi"])).orderBy("stockTime", "stockName")


def read_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Bars from a topic. Needs the Kafka connector on the class path; offsets are kept by the
    query's checkpoint, so a consumer group is optional (``**{"kafka.group.id": ...}``)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return parse_wire(reader.options(**options).load())


def write_kafka(bars: DataFrame, servers: str, topic: str) -> None:
    """Send bars to a topic as records."""
    writer = format_wire(bars).write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.option("topic", topic).option("kafka.acks", "all").save()


def read_wire_files(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of bars from text files of records, oldest file first."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return parse_wire(lines.filter(F.trim("value") != ""))
