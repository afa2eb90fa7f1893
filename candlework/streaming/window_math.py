"""The indicators of one symbol's recent bars, vectorised with numpy.

Structured Streaming has no row frames, so the live path evaluates them inside the state
function. The formulas are those of ``operators.indicators``; a test holds the two equal.
Missing values are NaN here and NULL there.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd

_BLOCK = 8192


def _frames(x: np.ndarray, n: int, fn) -> np.ndarray:
    """fn over every row and the n before it; frames at the start are shorter (NaN-padded)."""
    padded = np.concatenate([np.full(n, np.nan), x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, n + 1)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # frames without any value give NaN
        return np.concatenate([fn(windows[i : i + _BLOCK]) for i in range(0, len(windows), _BLOCK)])


def _mean(x, n):
    return _frames(x, n, lambda w: np.nanmean(w, axis=1))


def _sum(x, n):
    return np.where(_frames(x, n, lambda w: np.isfinite(w).sum(axis=1)) > 0, _frames(x, n, lambda w: np.nansum(w, axis=1)), np.nan)


def _low(x, n):
    return _frames(x, n, lambda w: np.nanmin(w, axis=1))


def _high(x, n):
    return _frames(x, n, lambda w: np.nanmax(w, axis=1))


def _sd(x, n):
    return _frames(x, n, lambda w: np.nanstd(w, axis=1, ddof=1))


def _lag(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], x[:-1]])


def _rnd(x: np.ndarray, digits: int) -> np.ndarray:
    unit = float(10**digits)
    size = np.abs(x) + 5.0e-10 if digits < 9 else np.abs(x)
    return np.rint(size * unit) / unit * np.sign(x) + 0.0


def _ratio(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / np.where(b == 0, np.nan, b))


def _code(*branches) -> np.ndarray:
    return np.select([b for b, _ in branches], [v for _, v in branches], 0).astype("int32")


#: The eight indicators and the columns each one makes.
INDICATOR_COLUMNS = {
    "sma": ["SMA10", "SMA100", "SMA_signal", "SMA_direction"],
    "bollinger": ["lastPriceLag", "BB_lowerBound", "BB_upperBound", "BB_middleBand", "BB_signal", "BB_direction"],
    "cci": ["CCI", "CCI_signal", "CCI_direction"],
    "stochastic": ["D", "stoch_signal", "stoch_direction"],
    "rsi": ["RSI", "RSI_signal", "RSI_direction"],
    "mfi": ["moneyFlowIndex", "MFI_signal", "moneyFlowIndex_direction"],
    "chaikin": ["chaikin", "chaikin_signal", "chaikin_direction"],
    "williams_r": ["williamsR", "willR_signal", "williamsR_direction"],
}


def base_rows(bars: pd.DataFrame, digits: int | None, indicators=tuple(INDICATOR_COLUMNS)) -> pd.DataFrame:
    """The base table's rows for bars in time order, treating the first as the symbol's first; of the indicators named."""
    high, low, last, volume = (bars[c].to_numpy("float64") for c in ("high", "low", "lastPrice", "volume"))

    def settle(x, d=digits):
        return x if digits is None else _rnd(x, d)

    def defined(x):
        return np.where(np.isnan(x), 0.0, x)

    out = {}
    with np.errstate(invalid="ignore"):
        before, typical = _lag(last), (high + low + last) / 3.0
        if "sma" in indicators:
            sma10, sma100 = _rnd(_mean(last, 10), 4), _rnd(_mean(last, 100), 4)
            s0, l0 = _lag(sma10), _lag(sma100)
            out["SMA10"], out["SMA100"] = sma10, sma100
            out["SMA_signal"] = _code(((s0 < l0) & (sma10 > sma100), 1), ((s0 >= l0) & (sma10 < sma100), 2))
            out["SMA_direction"] = _code((s0 < last, 1), (s0 >= last, -1))
        if "bollinger" in indicators:
            mid, sd = _rnd(_mean(last, 20), 3), _sd(last, 20)
            upper, lower, middle = settle(defined(mid + 2.0 * sd)), settle(defined(mid - 2.0 * sd)), defined(mid)
            out["lastPriceLag"] = _rnd(before, 2)
            out["BB_lowerBound"], out["BB_upperBound"], out["BB_middleBand"] = lower, upper, middle
            out["BB_signal"] = _code(
                ((before <= _lag(upper)) & (last > upper), 1), ((before >= _lag(lower)) & (last < lower), 2)
            )
            out["BB_direction"] = _code(
                (last < lower, 1),
                ((last < upper) & (last > middle), 1),
                (last >= upper, -1),
                ((last <= middle) & (last >= lower), -1),
            )
        if "cci" in indicators:
            off = settle(typical - _mean(typical, 20))
            cci = defined(settle(66.6666666667 * _ratio(off, _mean(np.abs(off), 5))))
            cci0 = _lag(cci)
            inner = (cci < 200) & (cci > -200)
            out["CCI"] = cci
            out["CCI_signal"] = _code(((cci0 >= -100) & (cci < -100), 1), ((cci0 <= 100) & (cci > 100), 2))
            out["CCI_direction"] = _code(
                (cci <= -200, 1), ((cci > cci0) & inner, 1), (cci >= 200, -1), ((cci <= cci0) & inner, -1)
            )
        if "stochastic" in indicators:
            lo14, hi14 = _low(low, 13), _high(high, 13)
            d = settle(_mean(settle(100.0 * _ratio(last - lo14, hi14 - lo14)), 2))
            d0 = _lag(d)
            out["D"] = d
            out["stoch_signal"] = _code(((d0 >= 20) & (d < 20), 1), ((d0 <= 80) & (d > 80), 2))
            out["stoch_direction"] = _code((d0 < d, 1), (d0 >= d, -1))
        if "rsi" in indicators:
            change = _rnd(last - before, 6)
            gain, loss = _mean(np.where(change > 0, change, 0.0), 13), _mean(np.where(change < 0, -change, 0.0), 13)
            rsi = settle(_ratio(100.0 * gain, gain + loss))
            rsi0 = _lag(rsi)
            inner = (rsi > 30) & (rsi < 70)
            out["RSI"] = _rnd(rsi, 2)
            out["RSI_signal"] = _code(
                ((rsi < 20) & (rsi > 0) & (rsi < rsi0), 1), ((rsi > 80) & (rsi < 100) & (rsi > rsi0), 2)
            )
            out["RSI_direction"] = _code(
                (rsi <= 30, 1), ((rsi >= rsi0) & inner, 1), (rsi >= 70, -1), ((rsi <= rsi0) & inner, -1)
            )
        if "mfi" in indicators:
            flow = _rnd(typical * volume, 6)
            change = _rnd(typical - _lag(typical), 6)
            inflow, outflow = _mean(np.where(change > 0, flow, 0.0), 13), _mean(np.where(change < 0, flow, 0.0), 13)
            mfi = settle(_ratio(100.0 * inflow, inflow + outflow))
            mfi0 = _lag(mfi)
            inner = (mfi > 20) & (mfi < 80)
            out["moneyFlowIndex"] = mfi
            out["MFI_signal"] = _code((mfi < 20, 1), (mfi > 80, 2))
            out["moneyFlowIndex_direction"] = _code(
                (mfi <= 20, 1), ((mfi > mfi0) & inner, 1), (mfi >= 80, -1), ((mfi <= mfi0) & inner, -1)
            )
        if "chaikin" in indicators:
            spread = high - low
            pushed = np.where(spread > 0, _ratio((last - low) - (high - last), spread) * volume, 0.0)
            money = settle(_ratio(_sum(pushed, 21), _sum(volume, 21)), 9)
            chaikin = settle(_mean(money, 3) - _mean(money, 10))
            chaikin0 = _lag(chaikin)
            out["chaikin"] = chaikin
            out["chaikin_signal"] = _code(((chaikin0 <= 0) & (chaikin > 0), 1), ((chaikin0 >= 0) & (chaikin < 0), 2))
            out["chaikin_direction"] = _code((chaikin > 0, 1), (chaikin <= 0, -1))
        if "williams_r" in indicators:
            lo15, hi15 = _low(low, 14), _high(high, 14)
            r = settle(_ratio(-100.0 * (hi15 - last), hi15 - lo15))
            r0 = _lag(r)
            out["williamsR"] = r
            out["willR_signal"] = _code(((r0 >= -80) & (r < -80), 1), ((r0 <= -20) & (r > -20), 2))
            out["williamsR_direction"] = _code((r0 < r, 1), (r0 >= r, -1))

    table = pd.DataFrame(out)
    for key in ("stockTime", "stockName", "lastPrice"):
        table[key] = bars[key].to_numpy()
    return table
