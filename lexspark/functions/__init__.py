"""Column helpers and small functions."""
