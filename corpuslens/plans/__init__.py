"""User-facing pipelines. Each takes and returns DataFrames."""
