"""Operators on level tables: every one is a DataFrame plan."""
