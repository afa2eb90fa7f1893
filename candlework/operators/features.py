"""The wide feature tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlework.operators.history import MEASURE, HotSymbols, number_bars, overlap, resolve
from candlework.operators.indicators import BASE_INDICATORS, SMA, Frames, Indicator, add_indicators
from candlework.schema import BASE_COLUMNS, FEATURE_COLUMNS, KEY, TIE_COLUMNS, WARMUP_BARS


def _tie_order(bars: DataFrame) -> list[str]:
    """Copies of a bar are told apart by the columns that indicators read, then by the rest."""
    rest = [x for x in bars.columns if x not in KEY]
    return [x for x in TIE_COLUMNS if x in rest] + [x for x in rest if x not in TIE_COLUMNS]


def dedupe_bars(bars: DataFrame) -> DataFrame:
    """One bar per (stockTime, stockName): of copies, the smallest by TIE_COLUMNS, then by the other columns.

    A map-side combining aggregate, so a group of many copies never travels whole.
    """
    rest = _tie_order(bars)
    picked = bars.groupBy("stockName", "stockTime").agg(F.min(F.struct(*rest)).alias("_bar"))
    return picked.select("stockName", "stockTime", "_bar.*").select(*bars.columns)


def _first_copies(bars: DataFrame) -> DataFrame:
    """As ``dedupe_bars``, on the shuffle and sort their frames need anyway."""
    by_time = Window.partitionBy("stockName").orderBy("stockTime", *_tie_order(bars))
    copy = F.row_number().over(by_time) > 1  # the first row has no bar before it, whatever its time
    copy = copy & F.lag("stockTime").over(by_time).eqNullSafe(F.col("stockTime"))
    return bars.withColumn("_copy", copy).filter(~F.col("_copy")).drop("_copy")


def indicator_table(
    bars: DataFrame,
    indicators: Iterable[Indicator],
    columns: Iterable[str],
    hot: HotSymbols | str | None = MEASURE,
    digits: int | None = None,
    unique: bool = True,
) -> DataFrame:
    """Indicators of bars, all in one pass.

    ``hot`` names the symbols whose history is split; by default they are found by a count of
    the bars, None skips that. ``digits`` rounds intermediate values so that the result does not depend on the order in
    which a frame is summed; None keeps full precision. Bars are taken to be unique, as ``read_bar_files`` and the stream
    give them; with ``unique=False`` one of each symbol and time is kept first, the same as by ``dedupe_bars``.
    """
    indicators = tuple(indicators)
    columns = list(columns)
    hot = resolve(bars, hot)
    if hot is None:
        bars = bars if unique else _first_copies(bars)
        return add_indicators(bars, indicators, Frames(), digits).select(*columns)
    bars = bars if unique else dedupe_bars(bars)
    # the copied bars must cover the longest frame, and at least the lag
    cut = overlap(bars, hot, max(i.lookback for i in indicators))
    out = add_indicators(cut, indicators, Frames(("stockName", "segment")), digits)
    return out.filter(~F.col("_before")).select(*columns)


def base_table(
    bars: DataFrame, hot: HotSymbols | str | None = MEASURE, digits: int | None = None, unique: bool = True
) -> DataFrame:
    """Key, price, lagged price and the 27 feature columns."""
    return indicator_table(bars, BASE_INDICATORS, BASE_COLUMNS, hot, digits, unique)


def feature_table(
    bars: DataFrame, hot: HotSymbols | str | None = MEASURE, digits: int | None = None, unique: bool = True
) -> DataFrame:
    """The 27 feature columns alone, as the live path emits them."""
    return indicator_table(bars, BASE_INDICATORS, FEATURE_COLUMNS, hot, digits, unique)


def base_table_by_joins(
    bars: DataFrame, hot: HotSymbols | str | None = MEASURE, digits: int | None = None, unique: bool = True
) -> DataFrame:
    """The same table as one inner join per indicator; kept to cross-check ``base_table``.

    The branches of bars that are dealt by symbol are so as well, and in order of time: in a session whose joins may use that
    (``session.joining_dealt``) they are joined where they are.
    """
    hot = resolve(bars, hot)
    parts = []
    for indicator in BASE_INDICATORS:
        extra = ["lastPrice"] if indicator is SMA else []
        parts.append(indicator_table(bars, [indicator], [*KEY, *extra, *indicator.outputs], hot, digits, unique))
    return reduce(lambda a, b: a.join(b, ["stockName", "stockTime"]), parts).select(*BASE_COLUMNS)


def sma_by_joins(bars: DataFrame, hot: HotSymbols | str | None = MEASURE) -> DataFrame:
    """The crossover as four joined tables: the two averages and their lags."""
    hot = resolve(bars, hot)

    def part(*columns: str) -> DataFrame:
        return indicator_table(bars, [SMA], [*KEY, *columns], hot)

    short, long = part("lastPrice", "SMA10"), part("SMA100")
    short_lag = part("_SMA10_before").withColumnRenamed("_SMA10_before", "SMA10lag")
    long_lag = part("_SMA100_before").withColumnRenamed("_SMA100_before", "SMA100lag")
    return reduce(lambda a, b: a.join(b, KEY), [short, long, short_lag, long_lag])


def drop_warmup(table: DataFrame, bars: int = WARMUP_BARS, hot: HotSymbols | str | None = MEASURE) -> DataFrame:
    """Drop each symbol's first bars, whose frames are not yet full."""
    return number_bars(table, hot, "_bar_no").filter(F.col("_bar_no") > bars).drop("_bar_no")
