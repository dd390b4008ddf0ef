"""Sources of the spread-analytics engine."""
