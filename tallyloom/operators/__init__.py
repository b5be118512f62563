"""Operators from DataFrame to DataFrame, a module for each kind of data."""
