"""Operators: functions from DataFrames to a DataFrame, on tables and on streams."""
