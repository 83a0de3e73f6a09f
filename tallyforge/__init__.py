"""Analytics over source trees, version history, assistant usage logs and a daily log, on Spark."""
