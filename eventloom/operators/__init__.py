"""Event-sequence operators: functions from DataFrames to DataFrames."""
