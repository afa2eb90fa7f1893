"""Splitting long histories so that no task holds a hot symbol whole.

All frames of the indicators look back a fixed number of bars, so a symbol's history may be
cut into calendar segments if each segment also sees the bars just before it. Whether that
is needed is measured: one column-pruned count decides, and symbols under the limit keep a
single segment and pay nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlework.session import stored

MAX_BARS_PER_TASK = 2_000_000
MAX_BROADCAST_SYMBOLS = 10_000
BARS_PER_PARTITION = 100_000  # of a shuffle by symbol: some 25 MB of base table

_PERIODS = ["year", "month", "day", "hour", "minute"]  # widest first


@dataclass(frozen=True)
class HotSymbols:
    """Symbols with more bars than one task should hold, and the period that cuts them."""

    table: DataFrame  # stockName, period
    broadcastable: bool
    parts: int = 1  # partitions for shuffles of all bars, so that a task's share does not grow with their number

    def side(self) -> DataFrame:
        return F.broadcast(self.table) if self.broadcastable else self.table


def parts_for(bars: int, per_partition: int = BARS_PER_PARTITION) -> int:
    """Partitions for so many bars. Windows read a partition whole, and adaptive execution merges but never splits those."""
    return max(1, -(-bars // per_partition))


def dealt(bars: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Bars shuffled by the keys into so many partitions; as they are where one will do."""
    return bars.repartition(parts, *keys) if parts > 1 else bars


def measure(bars: DataFrame, limit: int = MAX_BARS_PER_TASK) -> HotSymbols | None:
    """Find the symbols with more than ``limit`` bars; None when there are none.

    The count combines map-side and brings back at most MAX_BROADCAST_SYMBOLS + 1 names; the periods of more are stored.
    Each hot symbol gets the widest calendar period whose fullest segment is within limit.
    """
    heavy = bars.groupBy("stockName").count().filter(F.col("count") > limit).select("stockName")
    names = [r.stockName for r in heavy.limit(MAX_BROADCAST_SYMBOLS + 1).collect()]
    if not names:
        return None
    broadcastable = len(names) <= MAX_BROADCAST_SYMBOLS
    spark = bars.sparkSession
    chosen = spark.createDataFrame([(n,) for n in names], "stockName string") if broadcastable else heavy
    parts = parts_for(bars.count())
    hot_bars = bars.join(F.broadcast(chosen) if broadcastable else chosen, "stockName", "left_semi")
    by_hour = dealt(hot_bars.select("stockName", F.date_trunc("hour", "stockTime").alias("hour")), parts, "stockName", "hour")
    hours = dealt(by_hour.groupBy("stockName", "hour").agg(F.count("*").alias("n")), parts, "stockName")
    levels = F.array(
        *[
            F.struct(F.lit(rank).alias("rank"), F.date_trunc(period, "hour").alias("start"))
            for rank, period in enumerate(_PERIODS[:-1])
        ]
    )
    fullest = (
        hours.select("stockName", "n", F.explode(levels).alias("level"))
        .groupBy("stockName", "level")
        .agg(F.sum("n").alias("n"))
        .groupBy("stockName", F.col("level.rank").alias("rank"))
        .agg(F.max("n").alias("n"))
    )
    finest = len(_PERIODS) - 1
    fits = F.min(F.when(F.col("n") <= limit, F.col("rank")))
    table = fullest.groupBy("stockName").agg(
        F.element_at(F.array(*map(F.lit, _PERIODS)), F.coalesce(fits, F.lit(finest)) + 1).alias("period")
    )
    table = spark.createDataFrame(table.collect(), table.schema) if broadcastable else stored(table, "hot-symbols")
    return HotSymbols(table, broadcastable, parts)


MEASURE = "measure"  # stands for "count first": the default wherever a history could be hot


def resolve(bars: DataFrame, hot: HotSymbols | str | None) -> HotSymbols | None:
    """Measure the bars unless the caller has already, or has said with None that none is hot."""
    return measure(bars.select("stockName", "stockTime")) if isinstance(hot, str) else hot


def with_segments(bars: DataFrame, hot: HotSymbols, how: str = "left") -> DataFrame:
    """Add ``segment``: the calendar period of a hot symbol's bar, one constant for the rest.

    With ``how="inner"`` only hot symbols are kept.
    """
    return (
        bars.join(hot.side(), "stockName", how)
        .withColumn(
            "segment",
            F.coalesce(F.expr("date_trunc(period, stockTime)"), F.lit("1970-01-01").cast("timestamp")),
        )
        .drop("period")
    )


def overlap(bars: DataFrame, hot: HotSymbols, lookback: int) -> DataFrame:
    """Cut hot symbols into segments, each preceded by the ``lookback`` bars before it.

    Adds ``segment`` and ``_before`` (true on the copied bars). The bars are shuffled once, by symbol and segment, unless they
    come with their ``segment`` and so dealt; after that only copies are. Only the last bars of each segment are ranked and copied.
    """
    tagged = bars if "segment" in bars.columns else dealt(with_segments(bars, hot), hot.parts, "stockName", "segment")
    # the join below has no use for bars without a symbol: left out here as well, both read the same shuffle
    named, nameless = tagged.filter(F.col("stockName").isNotNull()), tagged.filter(F.col("stockName").isNull())
    by_symbol = Window.partitionBy("stockName").orderBy("segment")
    segments = (
        named.groupBy("stockName", "segment")
        .agg(F.count("*").alias("n"))
        .withColumn("start", F.sum("n").over(by_symbol) - F.col("n"))  # bars before the segment
    )
    # A bar is needed by the segments that start within ``lookback`` bars of it. Segments are
    # never empty, so those are among the next ``lookback`` ones. A symbol that is not cut has none.
    following = F.collect_list(F.struct("segment", "start")).over(by_symbol.rowsBetween(1, lookback))
    segments = segments.withColumn("following", following).filter(F.size("following") > 0)
    newest_first = Window.partitionBy("stockName", "segment").orderBy(F.col("stockTime").desc())
    tail = named.withColumn("back", F.row_number().over(newest_first)).filter(F.col("back") <= lookback)
    ordinal = F.col("start") + F.col("n") - F.col("back") + 1
    copies = (
        tail.join(segments, ["stockName", "segment"])
        .withColumn("ordinal", ordinal)
        .withColumn("to", F.explode(F.expr(f"filter(following, s -> s.start < ordinal + {lookback})")))
        .withColumn("segment", F.col("to.segment"))
    )
    columns = [*[x for x in bars.columns if x != "segment"], "segment"]
    copies = dealt(copies.select(*columns, F.lit(True).alias("_before")), hot.parts, "stockName", "segment")
    # all dealt alike, which the union keeps
    named, nameless = (x.select(*columns, F.lit(False).alias("_before")) for x in (named, nameless))
    return named.unionByName(nameless).unionByName(copies)


def number_bars(bars: DataFrame, hot: HotSymbols | str | None = MEASURE, name: str = "bar_no") -> DataFrame:
    """Number each symbol's bars 1, 2, ... in time order.

    With hot symbols present the number is the count of bars in earlier segments plus the rank
    within the segment, so no task sorts a whole hot symbol.
    """
    hot = resolve(bars, hot)
    if hot is None:
        in_symbol = Window.partitionBy("stockName").orderBy("stockTime")
        return bars.withColumn(name, F.row_number().over(in_symbol).cast("long"))
    keyed = dealt(with_segments(bars, hot), hot.parts, "stockName", "segment")
    by_symbol = Window.partitionBy("stockName").orderBy("segment")
    segments = (
        keyed.groupBy("stockName", "segment")
        .agg(F.count("*").alias("_n"))
        .select("stockName", "segment", (F.sum("_n").over(by_symbol) - F.col("_n")).alias("_earlier"))
    )
    in_segment = Window.partitionBy("stockName", "segment").orderBy("stockTime")
    return (
        keyed.withColumn("_rank", F.row_number().over(in_segment))
        .join(segments, ["stockName", "segment"])
        .withColumn(name, F.col("_earlier") + F.col("_rank"))
        .select(*bars.columns, name)
    )
