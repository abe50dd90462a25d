"""Spark-native analytics for time-ordered OHLCV bars.

Every operator is a function from DataFrame(s) to DataFrame; Catalyst plans
the whole chain.  See README.md for the map of operators to modules.
"""

__version__ = "0.1.0"
