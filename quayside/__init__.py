"""quayside: operational and billing analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    table loading, adapter views, document folders, snapshot writes
functions  column expressions (masking, guards, regex helpers, money, vectors)
operators  DataFrame-in / DataFrame-out jobs (billing scan, ledger, chunking,
           retrieval, governance, watchlist, data quality, operations)
plans      the registered queries and their DuckDB oracle SQL
streaming  Structured Streaming jobs (incremental ingest, telemetry drift)
"""

__all__ = ["session"]
