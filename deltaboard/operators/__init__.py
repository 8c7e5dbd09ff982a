"""DataFrame operators: rows in, rows out, clocks and thresholds as arguments."""
