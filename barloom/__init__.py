"""Daily-bar equity analytics and backtesting as Spark plans."""
