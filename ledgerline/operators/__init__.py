"""Operators that work on any table."""
