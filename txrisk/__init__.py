"""txrisk: transaction-risk analytics on Spark DataFrames.

Every operator is a function ``(DataFrame, params) -> DataFrame`` built from
Spark SQL expressions, windows, aggregates and joins; nothing collects rows
except fitted statistics (bounded by the number of columns/categories) and
scalar metrics.
"""

__version__ = "0.1.0"
