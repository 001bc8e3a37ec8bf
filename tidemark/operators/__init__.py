"""Operators: DataFrame to DataFrame. Times are parameters, never the clock."""
