"""Preparing, scoring and evaluating hourly load-style time series with Spark DataFrames.

``sources``    reading measurements and load documents, writing and reading datasets
``functions``  column expressions: clock features, seeded noise, column lists
``operators``  DataFrame operators: cleaning, positions, windows, scaling, splits, metrics
``plans``      compositions of operators: evaluation and named scenarios
"""

from loadcast.session import scratch_path, use_utc

__all__ = ["scratch_path", "use_utc"]
