"""Technical indicators as staged column expressions.

An indicator is a list of stages, each a dict of new columns over the columns made by the
stages before it. Even stages are plain projections and odd stages are window functions,
so stage k of every indicator can be evaluated in one ``withColumns``: all eight together
need one shuffle, one sort and three Window nodes instead of a self-join per indicator.

A moving frame of n preceding rows plus the current one has n + 1 rows. The lag of a
symbol's first bar is 0, not NULL. Codes: signal 1 buy, 2 sell, 0 hold; direction 1 up,
-1 down, 0 undetermined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.functions.columns import code, ratio, rnd, settle, share, typical_price, zero_if_undefined

c = F.col


class Frames:
    """Row frames over the bars of one symbol (or of one segment of its history)."""

    def __init__(self, keys: Sequence[str] = ("stockName",), order: str = "stockTime"):
        self._w = Window.partitionBy(*keys).orderBy(order)

    def last(self, n: int):
        """The current row and the n before it."""
        return self._w.rowsBetween(-n, 0)

    def avg(self, x: str, n: int) -> Column:
        return F.avg(x).over(self.last(n))

    def lag(self, x: str, k: int = 1) -> Column:
        return F.lag(x, k, 0.0).over(self._w)


Stage = Callable[[Frames, "int | None"], "dict[str, Column]"]


@dataclass(frozen=True)
class Indicator:
    name: str
    lookback: int  # bars before the current one that can matter
    stages: tuple[Stage, ...]
    outputs: tuple[str, ...]


def _nothing(f: Frames, q: int | None) -> dict[str, Column]:
    return {}


# --- moving average crossover -------------------------------------------------------------

SMA = Indicator(
    "sma_crossover",
    101,
    (
        _nothing,
        lambda f, q: {"_mean11": f.avg("lastPrice", 10), "_mean101": f.avg("lastPrice", 100)},
        lambda f, q: {"SMA10": rnd("_mean11", 4), "SMA100": rnd("_mean101", 4)},
        lambda f, q: {"_SMA10_before": f.lag("SMA10"), "_SMA100_before": f.lag("SMA100")},
        lambda f, q: {
            "SMA_signal": code(
                ((c("_SMA10_before") < c("_SMA100_before")) & (c("SMA10") > c("SMA100")), 1),
                ((c("_SMA10_before") >= c("_SMA100_before")) & (c("SMA10") < c("SMA100")), 2),
            ),
            "SMA_direction": code(
                (c("_SMA10_before") < c("lastPrice"), 1),
                (c("_SMA10_before") >= c("lastPrice"), -1),
            ),
        },
    ),
    ("SMA10", "SMA100", "SMA_signal", "SMA_direction"),
)

# --- Bollinger bands ----------------------------------------------------------------------

BOLLINGER = Indicator(
    "bollinger",
    21,
    (
        _nothing,
        lambda f, q: {
            "_mean21": f.avg("lastPrice", 20),
            "_sd21": F.stddev_samp("lastPrice").over(f.last(20)),
            "_close_before": f.lag("lastPrice"),
        },
        lambda f, q: {
            "BB_middleBand": zero_if_undefined(rnd("_mean21", 3)),
            "_upper": zero_if_undefined(rnd("_mean21", 3) + F.lit(2.0) * c("_sd21")),
            "_lower": zero_if_undefined(rnd("_mean21", 3) - F.lit(2.0) * c("_sd21")),
        },
        _nothing,
        lambda f, q: {"BB_upperBound": settle("_upper", q), "BB_lowerBound": settle("_lower", q)},
        lambda f, q: {"_upper_before": f.lag("BB_upperBound"), "_lower_before": f.lag("BB_lowerBound")},
        lambda f, q: {
            "lastPriceLag": rnd("_close_before", 2),
            "BB_signal": code(
                ((c("_close_before") <= c("_upper_before")) & (c("lastPrice") > c("BB_upperBound")), 1),
                ((c("_close_before") >= c("_lower_before")) & (c("lastPrice") < c("BB_lowerBound")), 2),
            ),
            "BB_direction": code(
                (c("lastPrice") < c("BB_lowerBound"), 1),
                ((c("lastPrice") < c("BB_upperBound")) & (c("lastPrice") > c("BB_middleBand")), 1),
                (c("lastPrice") >= c("BB_upperBound"), -1),
                ((c("lastPrice") <= c("BB_middleBand")) & (c("lastPrice") >= c("BB_lowerBound")), -1),
            ),
        },
    ),
    ("lastPriceLag", "BB_lowerBound", "BB_upperBound", "BB_middleBand", "BB_signal", "BB_direction"),
)

# --- commodity channel index --------------------------------------------------------------

CCI = Indicator(
    "cci",
    26,
    (
        lambda f, q: {"_typical": typical_price()},
        lambda f, q: {"_typical_mean": f.avg("_typical", 20)},
        lambda f, q: {"_off_mean": settle(c("_typical") - c("_typical_mean"), q), },
        lambda f, q: {"_mean_deviation": F.avg(F.abs(c("_off_mean"))).over(f.last(5))},
        lambda f, q: {
            "CCI": zero_if_undefined(settle(F.lit(66.6666666667) * ratio(c("_off_mean"), c("_mean_deviation")), q))
        },
        lambda f, q: {"_CCI_before": f.lag("CCI")},
        lambda f, q: {
            "CCI_signal": code(
                ((c("_CCI_before") >= -100) & (c("CCI") < -100), 1),
                ((c("_CCI_before") <= 100) & (c("CCI") > 100), 2),
            ),
            "CCI_direction": code(
                (c("CCI") <= -200, 1),
                ((c("CCI") > c("_CCI_before")) & (c("CCI") < 200) & (c("CCI") > -200), 1),
                (c("CCI") >= 200, -1),
                ((c("CCI") <= c("_CCI_before")) & (c("CCI") < 200) & (c("CCI") > -200), -1),
            ),
        },
    ),
    ("CCI", "CCI_signal", "CCI_direction"),
)

# --- stochastic oscillator ----------------------------------------------------------------

STOCHASTIC = Indicator(
    "stochastic",
    16,
    (
        _nothing,
        lambda f, q: {"_low14": F.min("low").over(f.last(13)), "_high14": F.max("high").over(f.last(13))},
        lambda f, q: {
            "_K": settle(F.lit(100.0) * ratio(c("lastPrice") - c("_low14"), c("_high14") - c("_low14")), q)
        },
        lambda f, q: {"_K_mean": f.avg("_K", 2)},
        lambda f, q: {"D": settle("_K_mean", q)},
        lambda f, q: {"_D_before": f.lag("D")},
        lambda f, q: {
            "stoch_signal": code(
                ((c("_D_before") >= 20) & (c("D") < 20), 1),
                ((c("_D_before") <= 80) & (c("D") > 80), 2),
            ),
            "stoch_direction": code((c("_D_before") < c("D"), 1), (c("_D_before") >= c("D"), -1)),
        },
    ),
    ("D", "stoch_signal", "stoch_direction"),
)

# --- relative strength --------------------------------------------------------------------

_gain_and_loss: tuple[Stage, ...] = (
    _nothing,
    lambda f, q: {"_close_before": f.lag("lastPrice")},
    lambda f, q: {"_change": rnd(c("lastPrice") - c("_close_before"), 6)},
    lambda f, q: {
        "_gain": F.avg(F.when(c("_change") > 0, c("_change")).otherwise(0.0)).over(f.last(13)),
        "_loss": F.avg(F.when(c("_change") < 0, -c("_change")).otherwise(0.0)).over(f.last(13)),
    },
)

RSI = Indicator(
    "rsi",
    15,
    (
        *_gain_and_loss,
        lambda f, q: {"_strength": settle(share(c("_gain"), c("_loss")), q)},
        lambda f, q: {"_strength_before": f.lag("_strength")},
        lambda f, q: {
            "RSI": rnd("_strength", 2),
            "RSI_signal": code(
                ((c("_strength") < 20) & (c("_strength") > 0) & (c("_strength") < c("_strength_before")), 1),
                ((c("_strength") > 80) & (c("_strength") < 100) & (c("_strength") > c("_strength_before")), 2),
            ),
            "RSI_direction": code(
                (c("_strength") <= 30, 1),
                ((c("_strength") >= c("_strength_before")) & (c("_strength") > 30) & (c("_strength") < 70), 1),
                (c("_strength") >= 70, -1),
                ((c("_strength") <= c("_strength_before")) & (c("_strength") > 30) & (c("_strength") < 70), -1),
            ),
        },
    ),
    ("RSI", "RSI_signal", "RSI_direction"),
)

RELATIVE_STRENGTH = Indicator(
    "relative_strength_capped",
    15,
    (
        *_gain_and_loss,
        lambda f, q: {
            "RS": F.when((c("_loss") == 0) & (c("_gain") > 0), F.lit(1.0))
            .when(ratio(c("_gain"), c("_loss")) > 100, F.lit(1.0))
            .otherwise(settle(ratio(c("_gain"), c("_loss")), q))
        },
        lambda f, q: {"RSlag": f.lag("RS")},
    ),
    ("RS", "RSlag"),
)

# --- money flow index ---------------------------------------------------------------------

MFI = Indicator(
    "mfi",
    15,
    (
        lambda f, q: {"_typical": typical_price(), "_flow": rnd(typical_price() * c("volume"), 6)},
        lambda f, q: {"_typical_before": f.lag("_typical")},
        lambda f, q: {"_typical_change": rnd(c("_typical") - c("_typical_before"), 6)},
        lambda f, q: {
            "_inflow": F.avg(F.when(c("_typical_change") > 0, c("_flow")).otherwise(0.0)).over(f.last(13)),
            "_outflow": F.avg(F.when(c("_typical_change") < 0, c("_flow")).otherwise(0.0)).over(f.last(13)),
        },
        lambda f, q: {"moneyFlowIndex": settle(share(c("_inflow"), c("_outflow")), q)},
        lambda f, q: {"_MFI_before": f.lag("moneyFlowIndex")},
        lambda f, q: {
            "MFI_signal": code((c("moneyFlowIndex") < 20, 1), (c("moneyFlowIndex") > 80, 2)),
            "moneyFlowIndex_direction": code(
                (c("moneyFlowIndex") <= 20, 1),
                (
                    (c("moneyFlowIndex") > c("_MFI_before"))
                    & (c("moneyFlowIndex") > 20)
                    & (c("moneyFlowIndex") < 80),
                    1,
                ),
                (c("moneyFlowIndex") >= 80, -1),
                (
                    (c("moneyFlowIndex") <= c("_MFI_before"))
                    & (c("moneyFlowIndex") > 20)
                    & (c("moneyFlowIndex") < 80),
                    -1,
                ),
            ),
        },
    ),
    ("moneyFlowIndex", "MFI_signal", "moneyFlowIndex_direction"),
)

# --- Chaikin oscillator -------------------------------------------------------------------


def _flow_volume() -> Column:
    spread = c("high") - c("low")
    multiplier = ratio((c("lastPrice") - c("low")) - (c("high") - c("lastPrice")), spread)
    return F.when(spread > 0, multiplier * c("volume")).otherwise(0.0)


def _finer(q: int | None) -> int | None:
    return None if q is None else 9


CHAIKIN = Indicator(
    "chaikin",
    32,
    (
        lambda f, q: {"_flow_volume": _flow_volume()},
        lambda f, q: {
            "_flow_sum": F.sum("_flow_volume").over(f.last(21)),
            "_volume_sum": F.sum("volume").over(f.last(21)),
        },
        lambda f, q: {"_money_flow": settle(ratio(c("_flow_sum"), c("_volume_sum")), _finer(q))},
        lambda f, q: {"_flow_mean11": f.avg("_money_flow", 10), "_flow_mean4": f.avg("_money_flow", 3)},
        lambda f, q: {"chaikin": settle(c("_flow_mean4") - c("_flow_mean11"), q)},
        lambda f, q: {"_chaikin_before": f.lag("chaikin")},
        lambda f, q: {
            "chaikin_signal": code(
                ((c("_chaikin_before") <= 0) & (c("chaikin") > 0), 1),
                ((c("_chaikin_before") >= 0) & (c("chaikin") < 0), 2),
            ),
            "chaikin_direction": code((c("chaikin") > 0, 1), (c("chaikin") <= 0, -1)),
        },
    ),
    ("chaikin", "chaikin_signal", "chaikin_direction"),
)

# --- Williams %R --------------------------------------------------------------------------

WILLIAMS_R = Indicator(
    "williams_r",
    15,
    (
        _nothing,
        lambda f, q: {"_low15": F.min("low").over(f.last(14)), "_high15": F.max("high").over(f.last(14))},
        lambda f, q: {
            "williamsR": settle(
                ratio(F.lit(-100.0) * (c("_high15") - c("lastPrice")), c("_high15") - c("_low15")), q
            )
        },
        lambda f, q: {"_R_before": f.lag("williamsR")},
        lambda f, q: {
            "willR_signal": code(
                ((c("_R_before") >= -80) & (c("williamsR") < -80), 1),
                ((c("_R_before") <= -20) & (c("williamsR") > -20), 2),
            ),
            "williamsR_direction": code(
                (c("_R_before") < c("williamsR"), 1), (c("_R_before") >= c("williamsR"), -1)
            ),
        },
    ),
    ("williamsR", "willR_signal", "williamsR_direction"),
)

# --- weighted moving average --------------------------------------------------------------


def _weighted_mean(weights: int = 10) -> Column:
    total = F.lit(float(weights)) * c("lastPrice")
    for k in range(1, weights):
        total = total + F.lit(float(weights - k)) * c(f"_close_{k}")
    return total / F.lit(weights * (weights + 1) / 2.0)


WMA = Indicator(
    "wma10",
    9,
    (
        _nothing,
        lambda f, q: {f"_raw_close_{k}": f.lag("lastPrice", k) for k in range(1, 10)},
        lambda f, q: {f"_close_{k}": rnd(f"_raw_close_{k}", 4) for k in range(1, 10)},
        _nothing,
        lambda f, q: {"_wma": _weighted_mean()},
        _nothing,
        lambda f, q: {"WMA10": settle("_wma", q)},
    ),
    ("WMA10",),
)

BASE_INDICATORS = (SMA, BOLLINGER, CCI, STOCHASTIC, RSI, MFI, CHAIKIN, WILLIAMS_R)
ALL_INDICATORS = (*BASE_INDICATORS, RELATIVE_STRENGTH, WMA)


def add_indicators(
    bars: DataFrame,
    indicators: Iterable[Indicator],
    frames: Frames | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Append the stages of all indicators, level by level."""
    frames = frames or Frames()
    indicators = tuple(indicators)
    out = bars
    for level in range(max(len(i.stages) for i in indicators)):
        new: dict[str, Column] = {}
        for indicator in indicators:
            if level < len(indicator.stages):
                new.update(indicator.stages[level](frames, digits))
        if new:
            out = out.withColumns(new)
    return out
