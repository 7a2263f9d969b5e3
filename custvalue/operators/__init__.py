"""Report operators: functions from DataFrames to a DataFrame."""
