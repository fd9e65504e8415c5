"""Whole pipelines: features, behaviour, evaluation, and the registered queries."""
