"""askwell — Spark-native data work around question-answering over SQL.

Layers:
  sources/    table loaders, the e-commerce adapter views, fixtures, file I/O
  functions/  Column-level helpers (text, exact rounding, vector math)
  plans/      the metric catalogue (DataFrame plans + their DuckDB oracle SQL)
  operators/  bulk operators: similarity search, dedup, token budget,
              prompt assembly, feedback gates, scoring, profiling
  streaming/  Structured Streaming form of the feedback loop
"""

__version__ = "0.1.0"
