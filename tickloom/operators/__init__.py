"""Operators: functions from DataFrames to DataFrames (or to columns)."""
