"""Operators from DataFrames to DataFrames: search, evaluation, analytics of logs, coverage and operations."""
