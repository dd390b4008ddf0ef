"""Streaming of the spread-analytics engine."""
