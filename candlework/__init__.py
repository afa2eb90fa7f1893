"""Technical indicators, signals, labels, models and backtests for market bars, on Spark."""
