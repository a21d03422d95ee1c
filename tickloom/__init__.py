"""tickloom: market-signal and portfolio analytics expressed as Spark plans.

Everything works on long DataFrames keyed ``(symbol, ts)``; portfolio-level
tables are keyed ``(run_id, ts)``.  See README.md for the layout.
"""

__version__ = "0.1.0"
