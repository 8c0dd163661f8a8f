"""The same operators on unbounded input (an addition)."""
