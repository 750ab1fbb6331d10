"""netlens: network-traffic analytics on Spark.

Packets -> flow state -> fixed-size traffic windows -> engineered features ->
labels, sampling, models, evaluation and alert views, all as DataFrame /
Spark SQL / Spark ML / Structured Streaming work.
"""

__version__ = "0.1.0"
