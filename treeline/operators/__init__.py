"""Relational operators on DataFrames whose columns are named by variables."""
