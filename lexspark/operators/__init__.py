"""Operators over DataFrames and compiled rules."""
