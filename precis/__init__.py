"""precis — a Spark-native engine for preparing, summarizing and scoring text.

Every operator takes and returns Spark DataFrames / Columns; the heavy work
stays inside Catalyst-planned jobs (scans, projections, hash aggregates,
joins, windows) so that it scales with the cluster rather than the driver.
"""

__version__ = "0.1.0"
