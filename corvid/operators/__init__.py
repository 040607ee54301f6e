"""Operators on DataFrames: dataset preparation, evaluation, results, lineage, registries, training, model calls."""
