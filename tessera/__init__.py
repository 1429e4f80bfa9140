"""tessera: data-parallel numeric and model-scoring jobs on Spark DataFrames.

Sub-packages:
  sources    readers and writers (Parquet, LibSVM, text, Arrow IPC, binary files)
  functions  Column expressions (strings, lists, maps, base64, tensor math)
  operators  aggregates, partitioning, gang (barrier) stages, NumPy layers,
             UDF forms, training and scoring jobs
  plans      the registered queries and their DuckDB oracle SQL
  streaming  scoring over a file stream with Structured Streaming
"""

from tessera.session import local_session, ship_package, shared_dir

__all__ = ["local_session", "ship_package", "shared_dir"]
