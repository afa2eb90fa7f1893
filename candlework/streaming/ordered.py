"""Live features in event time: bars are held back until the watermark passes them, late ones are kept, idle symbols expire.

A bar waits in list state until the watermark, the newest time seen less the tolerance, has passed it; an event-time timer
then releases a symbol's waiting bars in time order, whatever order they came in, and of copies the one that ``dedupe_bars``
keeps. A bar that comes when the watermark has already passed its time goes to a side table with all its columns. When a
symbol has had no bar for ``idle``, another timer drops its state, and the symbol starts anew should it return. The released
rows carry an event time of their own, so that streams of single indicators can be joined under a watermark that bounds the
joins' state.

State and timers need Spark's RocksDB state store; ``rocksdb`` sets it while a query is started.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from candlework.schema import BASE_COLUMNS, BASE_SCHEMA, KEY, TIE_COLUMNS
from candlework.streaming.window_math import INDICATOR_COLUMNS, base_rows

_LOOKBACK = 101  # bars before the current one that can matter
_VALUES = ["high", "low", "lastPrice", "volume"]
_BAR = "micros long, high double, low double, lastPrice double, volume double"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class OrderedBars(StatefulProcessor):
    """State of a symbol: the bars that wait, and the last 101 released ones."""

    def __init__(self, digits: int | None, idle_days: float | None, indicators: Sequence[str], late: bool):
        self.digits, self.idle, self.indicators, self.late = digits, idle_days and int(idle_days * _DAY), tuple(indicators), late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _BAR)
        self.recent = handle.getListState("recent", _BAR)

    def _due(self, ms: int, watermark: int) -> None:
        """Wakes the symbol when the watermark reaches ms, unless it wakes before anyway. Timers that are due now do not
        count: they are listed until they have been handled."""
        if not any(watermark < t <= ms for t in self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            passed = frame["micros"] <= watermark * 1000
            waits = frame[~passed]
            if len(waits):
                self.waiting.appendList([(int(m), *map(float, v)) for m, *v in waits[["micros", *_VALUES]].itertuples(index=False)])
                self._due(-(-int(waits["micros"].min()) // 1000), watermark)
            if self.late and passed.any():
                yield self._out(key[0], frame[passed].assign(late=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = pd.DataFrame(list(self.waiting.get()), columns=["micros", *_VALUES])
        ready = waiting["micros"] <= watermark * 1000
        new, rest = waiting[ready], waiting[~ready]
        kept = pd.DataFrame(list(self.recent.get()), columns=["micros", *_VALUES])
        if len(new):
            new = new.sort_values(["micros", *TIE_COLUMNS], kind="stable", na_position="first").drop_duplicates("micros")
            bars = pd.concat([kept, new], ignore_index=True) if len(kept) else new.reset_index(drop=True)
            kept = bars.tail(_LOOKBACK)
            self._put(self.recent, kept)
            self._put(self.waiting, rest)
            bars["stockName"], bars["stockTime"] = key[0], pd.to_datetime(bars["micros"], unit="us")
            yield self._out(key[0], base_rows(bars, self.digits, self.indicators).tail(len(new)).assign(late=False))
        if len(rest):
            self._due(-(-int(rest["micros"].min()) // 1000), watermark)
        elif len(kept) and self.idle is not None:
            end = int(kept["micros"].iloc[-1]) // 1000 + self.idle
            if end <= watermark:
                self.recent.clear()
            else:
                self._due(end, watermark)

    @staticmethod
    def _put(state, bars: pd.DataFrame) -> None:
        if len(bars):
            state.put([(int(m), *map(float, v)) for m, *v in bars[["micros", *_VALUES]].itertuples(index=False)])
        else:
            state.clear()

    def _columns(self) -> list[str]:
        wanted = [c for i in self.indicators for c in INDICATOR_COLUMNS[i]]
        return [c for c in BASE_COLUMNS if c in ("stockTime", "stockName", "lastPrice", *wanted)]

    def schema(self) -> str:
        types = dict(x.split(" ") for x in BASE_SCHEMA.split(", "))
        return ", ".join(f"{c} {types[c]}" for c in self._columns()) + (", late boolean, high double, low double, volume double" if self.late else "")

    def _out(self, name: str, rows: pd.DataFrame) -> pd.DataFrame:
        if "stockTime" not in rows:
            rows = rows.assign(stockTime=pd.to_datetime(rows["micros"], unit="us"))
        wanted = self._columns() + (["late", "high", "low", "volume"] if self.late else [])
        out = rows.reindex(columns=wanted)
        out["stockName"] = pd.Series([name] * len(out), index=out.index, dtype=object)
        return out

    def close(self) -> None:
        pass


def _released(bars: DataFrame, tolerance: str, processor: OrderedBars, event_time: bool) -> DataFrame:
    # the time goes in as a plain number: Spark would drop late rows before they reach the state
    marked = bars.withWatermark("stockTime", tolerance).select("stockName", F.unix_micros("stockTime").alias("micros"), *_VALUES)
    more = {"eventTimeColumnName": "stockTime"} if event_time else {}
    return marked.groupBy("stockName").transformWithStateInPandas(processor, processor.schema(), "append", "eventTime", **more)


def ordered_base_table(bars: DataFrame, tolerance: str, idle_days: float | None = None, digits: int | None = None) -> DataFrame:
    """The base table of a stream whose bars may come out of order by up to ``tolerance``, with late bars beside it.

    Rows with ``late`` false are base rows; those with ``late`` true are bars that came too late, with stockName, stockTime,
    lastPrice, high, low and volume. Bars newer than the watermark wait. After ``idle_days`` without a bar a symbol is
    forgotten.
    """
    return _released(bars, tolerance, OrderedBars(digits, idle_days, tuple(INDICATOR_COLUMNS), True), False)


def indicator_stream(bars: DataFrame, indicator: str, tolerance: str, idle_days: float | None = None, digits: int | None = None) -> DataFrame:
    """(stockTime, stockName, lastPrice, ...) of one indicator, released in time order, with stockTime as event time."""
    return _released(bars, tolerance, OrderedBars(digits, idle_days, (indicator,), False), True)


def joined_indicators(bars: DataFrame, tolerance: str, indicators: Sequence[str] = tuple(INDICATOR_COLUMNS), idle_days: float | None = None, digits: int | None = None) -> DataFrame:
    """Streams of single indicators joined on time and symbol: each is a stateful operator of its own, and the joins keep a
    row only until the watermark of both their sides has passed it."""
    streams = [indicator_stream(bars, i, tolerance, idle_days, digits) for i in indicators]
    streams = [streams[0], *[s.drop("lastPrice") for s in streams[1:]]]
    joined = reduce(lambda a, b: a.join(b, KEY), streams)
    return joined.select(*[c for c in BASE_COLUMNS if c in joined.columns])


def start_with_side_table(stream: DataFrame, checkpoint: str, path: str, late_path: str, every: str | None = None) -> StreamingQuery:
    """Writes the rows of ``ordered_base_table`` to ``path`` and its late bars to ``late_path``, a folder a batch, so that a
    batch that is repeated after a failure replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("not late").select(*BASE_COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.where("late").select(*KEY, "high", "low", "lastPrice", "volume").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
