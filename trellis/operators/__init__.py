"""Operators from DataFrame to DataFrame. None of them acts on a driver's copy of the data."""
