"""Operators of the spread-analytics engine."""
