"""riskloom: a Spark-native end-of-day derivatives-risk engine.

Every public operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL Column expressions, joins, windows and aggregates.  The only
Python step on the hot path is the Arrow-batched implied-volatility
solver (``riskloom.operators.iv``).
"""

__version__ = "0.1.0"
