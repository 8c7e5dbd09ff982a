"""Column expressions: text, time, status, geography and JSON."""
