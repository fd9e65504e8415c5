"""Operators over event DataFrames: order, lineage, windows, interval labels, metrics and scorers."""
