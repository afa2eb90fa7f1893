"""Schemas, column lists and codes."""

from __future__ import annotations

KEY = ["stockTime", "stockName"]

BAR_COLUMNS = ["stockName", "stockTime", "priceOpen", "high", "low", "lastPrice", "number", "volume"]
TIE_COLUMNS = ["lastPrice", "high", "low", "volume"]  # of copies of a bar, the smallest by these is kept
BAR_SCHEMA = (
    "stockName string, stockTime timestamp, priceOpen double, high double, low double, "
    "lastPrice double, number double, volume double"
)

# The columns of the wide table, in order.
FEATURE_COLUMNS = [
    "SMA10", "SMA100", "SMA_signal", "SMA_direction",
    "BB_lowerBound", "BB_upperBound", "BB_middleBand", "BB_signal", "BB_direction",
    "CCI", "CCI_signal", "CCI_direction",
    "D", "stoch_signal", "stoch_direction",
    "RSI", "RSI_signal", "RSI_direction",
    "moneyFlowIndex", "MFI_signal", "moneyFlowIndex_direction",
    "chaikin", "chaikin_signal", "chaikin_direction",
    "williamsR", "willR_signal", "williamsR_direction",
]

CODE_COLUMNS = [c for c in FEATURE_COLUMNS if c.endswith(("_signal", "_direction"))]
SIGNAL_COLUMNS = [c for c in FEATURE_COLUMNS if c.endswith("_signal")]

BASE_COLUMNS = ["stockTime", "stockName", "lastPrice", "lastPriceLag", *FEATURE_COLUMNS]
BASE_SCHEMA = ", ".join(
    f"{c} "
    + ("timestamp" if c == "stockTime" else "string" if c == "stockName" else "int" if c in CODE_COLUMNS else "double")
    for c in BASE_COLUMNS
)

# The names under which the analysis script addresses the wide table.
ANALYSIS_NAMES = {
    "stockTime": "dateTime",
    "stockName": "name",
    "BB_lowerBound": "BB_lowerbound",
    "BB_upperBound": "BB_upperbound",
    "BB_middleBand": "BB_middleband",
    "D": "stoch",
    "moneyFlowIndex": "MFI",
    "williamsR": "willR",
}

MODEL_COLUMNS = ["lastPrice", *FEATURE_COLUMNS]  # predictors of the forest, label aside

LABELLED_SIGNALS_SCHEMA = (
    "_1 timestamp, _2 string, _3 double, _4 double, "
    + ", ".join(f"_{i} int" for i in range(5, 14))
)

HOLD, BUY, SELL = 0, 1, 2  # signal and label codes
POSITION_HOLD, POSITION_BUY, POSITION_SELL = 1, 2, 3  # label + 1

WARMUP_BARS = 100
DAY_BARS = 389

# The sweep of the analysis script, in bars.
THRESHOLDS = [0.01, 0.1, 0.2, 0.5]


def sweep_lengths(day_bars: int) -> tuple[list[int], list[int]]:
    """Training and deployment lengths in bars, for days of ``day_bars`` bars."""
    week = 5 * day_bars
    month = round(4.5 * week)  # half-even, as in the analysis: 8752 of 389
    training = sorted([week, 2 * week, 3 * week, month, 5 * week, 6 * week, 7 * week, 2 * month, 10 * week, 3 * month])
    return training, [day_bars, week, 2 * week, month, 2 * month, 3 * month]


TRAINING_PERIODS, DEPLOYMENT_PERIODS = sweep_lengths(DAY_BARS)
