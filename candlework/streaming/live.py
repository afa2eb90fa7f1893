"""Stateful features, scoring, joins and sinks on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candlework.operators.models import score
from candlework.schema import BASE_COLUMNS, BASE_SCHEMA, CODE_COLUMNS, FEATURE_COLUMNS, TIE_COLUMNS
from candlework.streaming.window_math import base_rows

LOOKBACK = 101  # bars before the current one that can matter
_VALUES = ["high", "low", "lastPrice", "volume"]
_STATE_SCHEMA = "seen long, late long, times array<timestamp>, " + ", ".join(f"{c} array<double>" for c in _VALUES)


def with_processing_time(stream: DataFrame, name: str = "processedAt") -> DataFrame:
    """Expose the time at which a row is processed."""
    return stream.withColumn(name, F.current_timestamp())


def with_event_time(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("stockTime", delay)


def _advance(digits: int | None):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames), ignore_index=True)
        arrived = len(new)
        new = new.sort_values(["stockTime", *TIE_COLUMNS], kind="stable", na_position="first").drop_duplicates("stockTime")
        if state.exists:
            seen, late, times, *columns = state.get
            kept = pd.DataFrame(dict(zip(["stockTime", *_VALUES], [pd.to_datetime(list(times)), *columns])))
            new = new[new["stockTime"] > kept["stockTime"].iloc[-1]]
        else:
            seen, late = 0, 0
            kept = new[["stockTime", *_VALUES]].iloc[:0]
        late += arrived - len(new)
        bars = pd.concat([kept, new[["stockTime", *_VALUES]]], ignore_index=True) if len(kept) else (
            new[["stockTime", *_VALUES]].reset_index(drop=True)
        )
        buffer = bars.tail(LOOKBACK)
        state.update(
            (
                seen + len(new),
                late,
                [t.to_pydatetime() for t in buffer["stockTime"]],
                *[[float(v) for v in buffer[c]] for c in _VALUES],
            )
        )
        if len(new):
            bars["stockName"] = key[0]
            # the kept bars hold everything a new bar can look back on, so rows computed from
            # a truncated start are exactly those not emitted
            yield base_rows(bars, digits).tail(len(new))[BASE_COLUMNS]

    return step


def live_base_table(bars: DataFrame, digits: int | None = None) -> DataFrame:
    """The base table of a stream of bars, appended as bars arrive.

    State per symbol is its last 101 bars. A bar at or before the symbol's newest is dropped
    and counted in the state. Bars of one symbol within a batch are put in time order; of copies within a batch the one
    is kept that ``dedupe_bars`` keeps, across batches the one that arrived first.
    """
    return bars.select("stockName", "stockTime", *_VALUES).groupBy("stockName").applyInPandasWithState(
        _advance(digits), BASE_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def live_features(bars: DataFrame, digits: int | None = None) -> DataFrame:
    """The 27 feature columns alone."""
    return live_base_table(bars, digits).select(*FEATURE_COLUMNS)


def late_bars(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Bars seen and dropped per symbol, read from a query's state."""
    state = spark.read.format("statestore").load(checkpoint)
    value = state.select("key", "value.groupState.*")
    return value.select(F.col("key.*"), "seen", "late")


def live_scores(features: DataFrame, model: PipelineModel, columns: list[str] = CODE_COLUMNS) -> DataFrame:
    """Every row with the stored model's prediction."""
    return score(features, model, columns)


def join_live(left: DataFrame, right: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Inner join of two indicator streams on their key.

    Both sides carry a watermark on the joined event time, so each row's state is dropped once
    the watermark passes it.
    """
    return left.withWatermark("stockTime", delay).join(right.withWatermark("stockTime", delay), ["stockTime", "stockName"])


def start(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    sink: str = "parquet",
    every: str | None = "100 seconds",
) -> StreamingQuery:
    """Start an append query with a checkpoint. ``every=None`` drains what is there and stops."""
    writer = stream.writeStream.format(sink).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path) if path else writer.start()
