"""Approximate analytics over growing tables, on Spark."""
