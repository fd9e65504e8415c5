"""Behavioural analytics over host-telemetry event streams, on Spark DataFrames."""
