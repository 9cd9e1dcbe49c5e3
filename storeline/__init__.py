"""storeline: retail-chain analytics on PySpark.

Domain tables are typed DataFrames (``sources``); the business queries are
DataFrame plans (``plans``); integrity rules and change operators are
distributed joins and aggregations (``operators``); stock deduction also
runs as a stateful Structured Streaming job (``streaming``).
"""

__version__ = "0.1.0"
