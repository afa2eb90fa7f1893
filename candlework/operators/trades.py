"""Turning position codes into trades and returns.

Codes are label + 1: 1 hold, 2 buy, 3 sell. The groups are slices of the sweep, so their
size is set by the grid and not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.operators.history import MEASURE, HotSymbols
from candlework.operators.labels import Grid, labelled_slices
from candlework.schema import DAY_BARS, POSITION_BUY, POSITION_HOLD, POSITION_SELL, WARMUP_BARS

SLICE_KEYS = ["stockName", "deployment", "training", "threshold"]
_SYMBOLS = 256  # traded together by a task


def mark_trades(
    slices: DataFrame,
    code: Column,
    sell_at_day_end: bool,
    keys: Sequence[str] = SLICE_KEYS,
) -> DataFrame:
    """Add position, switchPrice, returnPrice, nextPrice and return to the rows of each slice.

    ``code`` is 0, 1 or 2 for hold, buy and sell. Rows that play no part keep NULLs instead of
    being filtered out, so positions are compared across holds and one sort serves all steps:

    * position: NULL for holds and for the slice's last bar, which never trades;
    * switchPrice: the price where the position differs from the one before, else 0; the first
      position only opens the comparison;
    * returnPrice: as switchPrice, NULL for 0; when the final row did not switch but another
      did, it closes the open position at its price;
    * return: the relative change to the next returnPrice, negated for a sell.
    """
    w = Window.partitionBy(*keys).orderBy("stockTime")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = f"over (partition by {', '.join(keys)} order by stockTime)"
    position = code + 1
    if sell_at_day_end:
        position = F.when(F.col("day") != F.col("_next_day"), POSITION_SELL).otherwise(position)
    position = F.when(F.col("_next_day").isNotNull() & (position != POSITION_HOLD), position)
    switch = F.when(F.col("position") != F.col("_previous"), F.col("lastPrice")).otherwise(0.0)
    closes = F.col("_later").isNull() & (F.col("switchPrice") == 0) & (F.col("_highest") > 0)
    change = F.try_divide(F.col("nextPrice") - F.col("returnPrice"), F.abs("returnPrice"))
    return (
        slices.withColumns({"_next_day": F.lead("day").over(w), "_last_day": F.lag("day").over(w)})
        .withColumn("position", position)
        .withColumn("_previous", F.expr(f"lag(position) ignore nulls {over}"))
        .withColumn("switchPrice", F.when(F.col("position").isNotNull() & F.col("_previous").isNotNull(), switch))
        .withColumns(
            {
                "_later": F.expr(f"lead(switchPrice) ignore nulls {over}"),
                "_highest": F.max("switchPrice").over(whole),
            }
        )
        .withColumn(
            "returnPrice",
            F.when(closes, F.col("lastPrice")).when(F.col("switchPrice") != 0, F.col("switchPrice")),
        )
        .withColumn("nextPrice", F.expr(f"lead(returnPrice) ignore nulls {over}"))
        .withColumn(
            "return",
            F.when(
                F.col("returnPrice").isNotNull(), F.when(F.col("position") == POSITION_BUY, change).otherwise(-change)
            ),
        )
        .withColumn(
            "opensDay", F.col("_last_day").isNull() | (F.col("_last_day") != F.col("day"))
        )
        .drop("_next_day", "_last_day", "_previous", "_later", "_highest")
    )


def trades(marked: DataFrame) -> DataFrame:
    """The bars at which money moves."""
    return marked.filter(F.col("returnPrice").isNotNull())


def trade_returns(marked: DataFrame) -> DataFrame:
    """The trades that have a following trade, with their return."""
    return marked.filter(F.col("return").isNotNull())


def summarise(marked: DataFrame, keys: Sequence[str] = SLICE_KEYS) -> DataFrame:
    """Per slice: days (traded or not), transactions, and the returns' total, mean and deviation.

    Transactions are counted before the open position is closed.
    """
    total = F.coalesce(F.sum("return"), F.lit(0.0))
    days = F.count_if("opensDay")
    return marked.groupBy(*keys).agg(
        days.alias("days"),
        F.count_if(F.col("switchPrice") > 0).alias("transactions"),
        total.alias("totalReturn"),
        F.avg("return").alias("meanReturn"),
        F.stddev_samp("return").alias("sdReturn"),
        (total / days).alias("averageDailyReturn"),
    )


class _Accounts:
    """Trading of many slices bar by bar: what ``mark_trades`` and ``summarise`` without selling at day end give of each."""

    def __init__(self, slices: int):
        whole, real, flag = (lambda: np.zeros(slices, np.int64)), (lambda: np.zeros(slices)), (lambda: np.zeros(slices, bool))
        self.previous = np.zeros(slices, np.int8)  # position before, 0 for none
        self.days, self.transactions, self.n = whole(), whole(), whole()
        self.total, self.mean, self.squares = real(), real(), real()  # of the returns, the squares around their mean
        self.price, self.opened = real(), np.zeros(slices, np.int8)  # of the last return price, 0 for none
        self.level, self.known, self.unmoved = real(), flag(), flag()  # the last switch price was 0: the bar's price, if any
        self.above = flag()  # a switch price above 0

    def add(self, at: np.ndarray, price: np.ndarray) -> None:
        """A following return price, which ends the return of the one before."""
        had = self.opened[at] > 0
        at, price = at[had], price[had]
        x = (price - self.price[at]) / np.abs(self.price[at])
        x = np.where(self.opened[at] == POSITION_BUY, x, -x)
        self.n[at] += 1
        self.total[at] += x
        off = x - self.mean[at]
        step = off / self.n[at]
        self.mean[at] += step
        self.squares[at] += off * (off - step)

    def trade(self, at: np.ndarray, position: np.ndarray, price: np.ndarray, known: np.ndarray) -> None:
        """A bar of these slices, which has a position and is not the slice's last."""
        before = self.previous[at]
        self.previous[at] = position
        moved = before != position
        still, moved = (before > 0) & ~moved, (before > 0) & moved & known
        zero = still | (moved & (price == 0))
        flat = at[zero]
        self.unmoved[flat], self.level[flat], self.known[flat] = True, price[zero], known[zero]
        event = moved & (price != 0)
        at, position, price = at[event], position[event], price[event]
        self.add(at, price)
        above = ~(price <= 0)  # a price that is no number counts as above
        self.price[at], self.opened[at], self.unmoved[at] = price, position, False
        self.transactions[at] += above
        self.above[at] |= above

    def closed(self, at: np.ndarray) -> dict[str, np.ndarray]:
        """The summary of these slices, the open position closed where the last one kept it."""
        end = _Accounts(len(at))
        for name, values in vars(self).items():
            setattr(end, name, values[at])
        end.add(*(lambda x: (x, end.level[x]))(np.flatnonzero(end.unmoved & end.above & end.known)))
        with np.errstate(divide="ignore", invalid="ignore"):
            return {
                "days": end.days, "transactions": end.transactions, "totalReturn": end.total,
                "meanReturn": np.where(end.n > 0, end.total / end.n, np.nan),
                "sdReturn": np.sqrt(end.squares / (end.n - 1)), "averageDailyReturn": end.total / end.days, "n": end.n,
            }


def _traded(names: pa.Array, first: np.ndarray, bars: dict[str, np.ndarray], grid: Grid) -> Iterator[pa.RecordBatch]:
    """Summaries of all slices of some symbols, whose bars begin at ``first``, in order of their number."""
    start, reach, thresholds = min(grid.training), max(grid.deployment) + 1, len(grid.thresholds)
    symbols, fits = len(first), len(grid.training)
    of = np.repeat(np.arange(symbols), np.diff([*first, len(bars["bar_no"])]))
    row = bars["bar_no"] - start

    def by_bar(values: np.ndarray) -> np.ndarray:
        out = np.zeros((max(grid.training) - start + reach + 1, symbols, *values.shape[1:]), values.dtype)
        out[row, of] = values
        return out

    def at_bar(values: np.ndarray, k: int) -> np.ndarray:
        """Bar k of each slice, by training length, symbol and threshold."""
        some = np.stack([values[t - start + k] for t in grid.training])
        return np.repeat(some[:, :, None], thresholds, 2).ravel()

    here, price, known = by_bar(np.ones(len(row), bool)), by_bar(bars["price"]), by_bar(bars["known"])
    day, dated = by_bar(bars["day"]), by_bar(bars["dated"])
    codes = by_bar(bars["codes"])
    opens = dated.copy()
    opens[1:] = ~dated[:-1] | (dated[1:] & (day[1:] != day[:-1]))
    accounts = _Accounts(fits * symbols * thresholds)
    left = {d: np.ones(fits * symbols * thresholds, bool) for d in grid.deployment}

    def summary(d: int, at: np.ndarray) -> pa.RecordBatch:
        left[d][at] = False
        out = accounts.closed(at)
        n = out.pop("n")
        fit, threshold = np.divmod(at, thresholds)
        fit, symbol = np.divmod(fit, symbols)
        return pa.record_batch(
            {
                "stockName": names.take(pa.array(symbol)),
                "deployment": np.full(len(at), d, np.int32),
                "training": np.array(grid.training, np.int32)[fit],
                "threshold": np.array(grid.thresholds, np.float64)[threshold],
            }
            | {c: pa.array(v, mask=n < {"meanReturn": 1, "sdReturn": 2}[c]) if c in ("meanReturn", "sdReturn") else v for c, v in out.items()}
        )

    present = at_bar(here, 0)
    for d in grid.deployment:
        left[d] &= present  # a slice without bars gives no row
    for k in range(reach):
        accounts.days += present & (at_bar(opens, k) if k else True)
        following = at_bar(here, k + 1)
        last = present & ~following
        for d in grid.deployment:
            ended = (present if d == k else last) & left[d] if d >= k else None
            if ended is not None and ended.any():
                yield summary(d, np.flatnonzero(ended))
        code = np.stack([codes[t - start + k, :, i * thresholds : (i + 1) * thresholds] for i, t in enumerate(grid.training)]).ravel()
        at = np.flatnonzero((code > 0) & present & following & at_bar(dated, k + 1))
        accounts.trade(at, code[at] + np.int8(1), at_bar(price, k)[at], at_bar(known, k)[at])
        present = following


def summarise_grid(bars: DataFrame, grid: Grid) -> DataFrame:
    """``summarise`` of ``mark_trades`` of all slices of a grid, without selling at day end, from bars that are given once.

    bars: stockName, bar_no, day, lastPrice and ``predictions``, the codes of all training lengths and thresholds, a byte each,
    below 0 for none. The bars of a symbol come together, as many as the grid reaches at most, and are traded in all slices at
    once, bar by bar, where rows of slices would be multiplied and sorted.
    """
    columns = [F.col("lastPrice").cast("double").alias("price"), F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day")]
    wanted = bars.filter(F.col("bar_no").between(min(grid.training), grid.last_bar)).select("stockName", "bar_no", *columns, "predictions")
    # the window brings a task its symbols whole, each in order
    together = wanted.withColumn("_at", F.row_number().over(Window.partitionBy("stockName").orderBy("bar_no")))
    codes = len(grid.training) * len(grid.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def traded(last: bool) -> Iterator[pa.RecordBatch]:
            """Trades all symbols held, but the last one unless no more bars follow."""
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            names = pc.dictionary_encode(whole["stockName"].combine_chunks(), null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.diff(names, prepend=-1) != 0)
            if not last:
                held.extend(whole.slice(first[-1]).to_batches())
                whole, first = whole.slice(0, first[-1]), first[:-1]
            for i in range(0, len(first), _SYMBOLS):
                some = first[i : i + _SYMBOLS]
                until = first[i + _SYMBOLS] if i + _SYMBOLS < len(first) else len(whole)
                part = whole.slice(some[0], until - some[0]).combine_chunks()
                column = lambda c: part[c].combine_chunks()
                packed = column("predictions")
                _, ends, data = packed.buffers()
                begin = int(np.frombuffer(ends, np.int32)[packed.offset])
                yield from _traded(
                    column("stockName").take(pa.array(some - some[0])), some - some[0],
                    {
                        "bar_no": column("bar_no").to_numpy(),
                        "price": pc.fill_null(column("price"), 0.0).to_numpy(),
                        "known": column("price").is_valid().to_numpy(zero_copy_only=False),
                        "day": pc.fill_null(column("day"), 0).to_numpy(),
                        "dated": column("day").is_valid().to_numpy(zero_copy_only=False),
                        "codes": np.frombuffer(data, np.int8, len(part) * codes, begin).reshape(len(part), codes),
                    },
                    grid,
                )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= _SYMBOLS * (grid.last_bar - min(grid.training) + 1):
                yield from traded(False)
        if held:
            yield from traded(True)

    schema = "stockName string, deployment int, training int, threshold double, days long, transactions long, totalReturn double, meanReturn double, sdReturn double, averageDailyReturn double"
    return together.mapInArrow(run, schema)


def sweep_wide(results: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """One row per symbol and slice with Period, Return, Transactions for every threshold.

    Rows that lack a threshold are dropped. Training periods are also given in days.
    """
    cells = results.groupBy("stockName", "deployment", "training").pivot("threshold", list(thresholds)).agg(
        F.first("training").alias("Period"),
        F.first("averageDailyReturn").alias("Return"),
        F.first("transactions").alias("Transactions"),
    )
    named = []
    for i, threshold in enumerate(thresholds):
        suffix = "" if i == 0 else str(i + 1)
        for field in ("Period", "Return", "Transactions"):
            named.append(F.col(f"`{threshold}_{field}`").alias(field + suffix))
    return cells.select(
        "stockName", "deployment", "training", *named, (F.col("training") / DAY_BARS).alias("trainingDays")
    ).dropna("any")


def sweep_stats(results: DataFrame) -> DataFrame:
    """Sum, maximum and minimum of the daily return per deployment period and threshold."""
    return results.groupBy("stockName", "deployment", "threshold").agg(
        F.sum("averageDailyReturn").alias("sumReturn"),
        F.max("averageDailyReturn").alias("maxReturn"),
        F.min("averageDailyReturn").alias("minReturn"),
        F.sum("transactions").alias("sumTransactions"),
        F.sum("training").alias("sumPeriod"),
    )


def scale_transactions(results: DataFrame) -> DataFrame:
    """Transactions scaled to 0..1 and as a share of the maximum, within a deployment period."""
    bounds = results.groupBy("stockName", "deployment").agg(
        F.max("transactions").alias("_most"), F.min("transactions").alias("_least")
    )
    n = F.col("transactions")
    return results.join(bounds, ["stockName", "deployment"]).select(
        *SLICE_KEYS,
        "transactions",
        F.try_divide(n - F.col("_least"), F.col("_most") - F.col("_least")).alias("scaled"),
        F.try_divide(n, F.col("_most")).alias("shareOfMost"),
    )


def optimal_return(
    table: DataFrame,
    grid: Grid,
    day: Column | None = None,
    hot: HotSymbols | str | None = MEASURE,
    warmup: int = WARMUP_BARS,
) -> DataFrame:
    """The best a threshold could do: the labels themselves are traded, selling at day end.

    Slices are counted from the bar after each symbol's first ``warmup`` ones.
    """
    slices = labelled_slices(table, grid, day, hot, warmup=warmup)
    return summarise(mark_trades(slices, F.col("responseVariable"), sell_at_day_end=True))
