"""Plans of the spread-analytics engine."""
