"""Readers for raw event logs, Parquet tables, label files and parser settings; writers for results."""
