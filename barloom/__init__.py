"""Bar-data, signal and backtest jobs on Spark."""
