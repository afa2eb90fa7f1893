"""Labelling bars against the end-of-day price, and slicing them by bar number."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.operators.history import MEASURE, HotSymbols, dealt, number_bars, resolve
from candlework.schema import BUY, DEPLOYMENT_PERIODS, HOLD, SELL, THRESHOLDS, TRAINING_PERIODS, sweep_lengths


def day_of(period: str = "day") -> Column:
    """The trading-day key: the calendar day, or a longer period for sparse bars."""
    day = F.to_date("stockTime")
    return day if period == "day" else F.trunc(day, period)


def end_of_day(bars: DataFrame, day: Column | None = None) -> DataFrame:
    """Last price per symbol and day."""
    day = day_of() if day is None else day
    return bars.groupBy("stockName", day.alias("day")).agg(F.max_by("lastPrice", "stockTime").alias("eodPrice"))


def join_end_of_day(bars: DataFrame, day: Column | None = None) -> DataFrame:
    """Every bar with the last price of its day, as an inner join."""
    day = day_of() if day is None else day
    return bars.withColumn("day", day).join(end_of_day(bars, day), ["stockName", "day"])


def with_end_of_day(bars: DataFrame, day: Column | None = None, hot: HotSymbols | str | None = MEASURE) -> DataFrame:
    """Every bar with the last price of its day.

    A window over (symbol, day), which needs no join and, after a numbering, no shuffle. With
    hot symbols a day itself may be large: then the last price is aggregated, which combines
    map-side, and joined, where Spark splits skewed keys. By default they are counted first.
    """
    if resolve(bars, hot) is not None:
        return join_end_of_day(bars, day)
    day = day_of() if day is None else day
    whole_day = (
        Window.partitionBy("stockName", "day")
        .orderBy("stockTime")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return bars.withColumn("day", day).withColumn("eodPrice", F.last("lastPrice").over(whole_day))


def response(threshold: Column) -> Column:
    """2 sell when the price is above the end of day by the threshold, 1 buy when below, else 0."""
    price, end = F.col("lastPrice"), F.col("eodPrice")
    return F.when(price - end >= threshold, SELL).when(end - price >= threshold, BUY).otherwise(HOLD)


def label(bars: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One row per bar and threshold, with ``responseVariable``. Needs ``eodPrice``."""
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    return bars.withColumn("threshold", F.explode(values)).withColumn(
        "responseVariable", response(F.col("threshold"))
    )


@dataclass(frozen=True)
class Grid:
    """The sweep: training and deployment lengths in bars, and thresholds."""

    training: tuple[int, ...] = tuple(TRAINING_PERIODS)
    deployment: tuple[int, ...] = tuple(DEPLOYMENT_PERIODS)
    thresholds: tuple[float, ...] = tuple(THRESHOLDS)

    @classmethod
    def of_day_bars(cls, day_bars: int, thresholds: Sequence[float] = THRESHOLDS) -> Grid:
        """The full sweep where a day has ``day_bars`` bars; 389 give the default."""
        return cls(*map(tuple, sweep_lengths(day_bars)), tuple(thresholds))

    @property
    def last_bar(self) -> int:
        return max(self.training) + max(self.deployment)

    def slices(self) -> Column:
        """Training and deployment pairs as an array literal: it is a parameter, not data."""
        return F.array(
            *[
                F.struct(F.lit(t).alias("training"), F.lit(d).alias("deployment"))
                for t in self.training
                for d in self.deployment
            ]
        )


def _slice(numbered: DataFrame, grid: Grid, first: str, last: str, upto: int) -> DataFrame:
    inside = F.expr(f"filter(_slices, s -> bar_no between {first} and {last})")
    return (
        numbered.filter(F.col("bar_no") <= upto)
        .withColumn("_slices", grid.slices())
        .withColumn("_slice", F.explode(inside))
        .select("*", F.col("_slice.training").alias("training"), F.col("_slice.deployment").alias("deployment"))
        .drop("_slices", "_slice")
    )


def training_slices(numbered: DataFrame, grid: Grid) -> DataFrame:
    """Bars 1..training of every slice. Needs ``bar_no``."""
    return _slice(numbered, grid, "1", "s.training", max(grid.training))


def deployment_slices(numbered: DataFrame, grid: Grid) -> DataFrame:
    """Bars training..training + deployment: the slice starts at the last training bar."""
    return _slice(numbered, grid, "s.training", "s.training + s.deployment", grid.last_bar)


def both_slices(numbered: DataFrame, grid: Grid) -> DataFrame:
    """Training and deployment bars of every slice in one pass, told apart by ``part``. Needs ``bar_no``."""
    parts = F.array(
        *[
            F.struct(
                F.lit(part).alias("part"), F.lit(t).alias("training"), F.lit(d).alias("deployment"),
                F.lit(first).alias("first"), F.lit(last).alias("last"),
            )
            for t in grid.training
            for d in grid.deployment
            for part, first, last in (("training", 1, t), ("deployment", t, t + d))
        ]
    )
    return (
        numbered.filter(F.col("bar_no") <= grid.last_bar)
        .withColumn("_parts", parts)
        .withColumn("_s", F.explode(F.expr("filter(_parts, s -> bar_no between s.first and s.last)")))
        .select("_s.part", *numbered.columns, "_s.training", "_s.deployment")
    )


def labelled_slices(
    table: DataFrame,
    grid: Grid,
    day: Column | None = None,
    hot: HotSymbols | str | None = MEASURE,
    keep: Iterable[str] = (),
    warmup: int = 0,
) -> DataFrame:
    """Deployment slices labelled for every threshold of the grid, after each symbol's first ``warmup`` bars.

    The end of day is taken over the whole table before slicing, as a slice may end mid-day. Of a hot symbol the slices
    reach a bounded number of bars; those are brought together before they are multiplied.
    """
    keys = ["stockName", "stockTime", "lastPrice"]
    hot = resolve(table, hot)
    numbered = numbered_days(table.select(*keys, *[x for x in keep if x not in keys]), day, hot, warmup)
    if hot is not None:
        numbered = dealt(numbered.filter(F.col("bar_no") <= grid.last_bar), hot.parts, "stockName")
    return label(deployment_slices(numbered, grid), grid.thresholds)


def numbered_after_warmup(bars: DataFrame, hot: HotSymbols | str | None = MEASURE, warmup: int = 0) -> DataFrame:
    """Bars with ``bar_no``, counted 1, 2, ... from each symbol's first bar after its first ``warmup`` ones, which go."""
    numbered = number_bars(bars, hot)
    if not warmup:
        return numbered
    return numbered.filter(F.col("bar_no") > warmup).withColumn("bar_no", F.col("bar_no") - warmup)


def numbered_days(
    bars: DataFrame, day: Column | None = None, hot: HotSymbols | str | None = MEASURE, warmup: int = 0
) -> DataFrame:
    """Bars after the warm-up with ``bar_no``, ``day`` and ``eodPrice``.

    Numbering comes first: where it partitions by symbol, the day windows need no shuffle.
    """
    hot = resolve(bars, hot)
    return with_end_of_day(numbered_after_warmup(bars, hot, warmup), day, hot)


def position(label_column: str = "responseVariable") -> Column:
    """Position codes 1 hold, 2 buy, 3 sell from labels 0, 1, 2."""
    return F.col(label_column) + 1


def label_binary(label_column: str = "_13") -> Column:
    """1 for buy or sell, -1 for hold."""
    return F.when(F.col(label_column).isin(1, 2), 1).otherwise(-1)
