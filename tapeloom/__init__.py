"""Spark-native analytics for end-of-day price bars.

Layers
------
``sources``    readers, adapters and sinks for bar tables and dimensions
``functions``  Column helpers and the distributed rank / quantile primitives
``operators``  DataFrame-in, DataFrame-out operators (adjust, score, flow, ...)
``plans``      registered queries: operator composition plus the SQL twin
"""
