"""Panel, strategy, backtest and analysis operators."""
