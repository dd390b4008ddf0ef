"""Functions of the spread-analytics engine."""
