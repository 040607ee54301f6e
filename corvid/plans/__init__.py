"""Registered queries, each with its DuckDB form where SQL can express it."""
