"""Queries, their approximate plans, and the maintenance policy."""
