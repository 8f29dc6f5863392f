"""Analytics over time-stamped text and events, expressed as Spark DataFrames."""
